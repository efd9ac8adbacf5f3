"""Byte-pair encoding over arrays, and the pre-tokens of two public tokenizers.

``merge`` holds a batch of pre-tokens as one ragged array of symbols and applies, to all
sequences at once, each sequence's lowest-rank pair until none is left. ``Splitter``
finds the pre-tokens of a batch of texts on their UTF-8 bytes.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np

from tidemill.llm._text import group_ranges, runs

NONE = np.int64(np.iinfo(np.int64).max)


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    letters = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
    return [letters[b] for b in range(256)]


class Merges:
    """Ranks and results of merges, by pair of symbols, in a table of open addresses."""

    def __init__(self, model: dict):
        vocab = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        symbols = byte_symbols()
        self.first = np.array([vocab[c] for c in symbols], np.int64)
        self.last = np.array([vocab[c + self.suffix] for c in symbols], np.int64) if self.suffix else self.first
        pairs = [(vocab[a], vocab[b], vocab[a + b]) for a, b in (m if isinstance(m, list) else m.split(" ") for m in model["merges"])]
        self.base = np.int64(len(vocab) + 1)
        keys = np.array([a * int(self.base) + b for a, b, _ in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.results = np.array([c for _, _, c in pairs], np.int64)
        bits = 20
        self.mask = np.uint64((1 << bits) - 1)
        self.slots = np.zeros((1 << bits) + 64, np.int64) - 1
        self.slot_rank = np.zeros((1 << bits) + 64, np.int64)
        for key, rank in zip(self.keys.tolist(), self.ranks.tolist(), strict=True):
            at = int(self._slot(np.array([key]))[0])
            while self.slots[at] >= 0:
                at += 1
            self.slots[at], self.slot_rank[at] = key, rank

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(40)) & self.mask

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, NONE where the pair is no merge."""
        keys = left * self.base + right
        out = np.full(len(keys), NONE)
        at = self._slot(keys).astype(np.int64)
        open_ = np.arange(len(keys))
        while len(open_):
            found = self.slots[at]
            same = found == keys[open_]
            out[open_[same]] = self.slot_rank[at[same]]
            go = ~same & (found >= 0)
            open_, at = open_[go], at[go] + 1
        return out


@lru_cache(maxsize=4)
def merges(path: str) -> Merges:
    with open(path, encoding="utf-8") as f:
        return Merges(json.load(f)["model"])


def merge(table: Merges, data: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Symbols left of each byte sequence, and how many: ``data`` holds the bytes one after the other.

    All occurrences of a sequence's lowest-rank pair are merged together, from the left,
    unless one of them makes a pair of still lower rank: then only the leftmost is merged
    in this round, as one-at-a-time encoders do.
    """
    lengths = lengths.astype(np.int64)
    symbols = table.first[data]
    ends = np.cumsum(lengths)
    full = lengths > 0
    symbols[ends[full] - 1] = table.last[data[ends[full] - 1]]
    out_counts = lengths.copy()
    done_symbols: list[np.ndarray] = []
    done_seq: list[np.ndarray] = []
    seq = np.repeat(np.arange(len(lengths)), lengths)
    ranks = np.full(len(symbols), NONE)
    if len(symbols) > 1:
        inner = seq[1:] == seq[:-1]
        ranks[:-1][inner] = table.rank(symbols[:-1][inner], symbols[1:][inner])
    while len(symbols):
        begins = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
        sizes = np.diff(np.append(begins, len(seq)))
        lowest = np.minimum.reduceat(ranks, begins)
        alive = lowest < NONE
        if not alive.all():
            keep = np.repeat(alive, sizes)
            done_symbols.append(symbols[~keep])
            done_seq.append(seq[~keep])
            symbols, seq, ranks = symbols[keep], seq[keep], ranks[keep]
            if not len(symbols):
                break
            begins = np.flatnonzero(np.concatenate([[True], seq[1:] != seq[:-1]]))
            sizes, lowest = sizes[alive], lowest[alive]
        of = np.repeat(np.arange(len(begins)), sizes)
        hit = np.flatnonzero(ranks == lowest[of])
        # a a a: hits at neighbouring places overlap; take every other one of such a chain
        chain = np.flatnonzero(np.concatenate([[True], np.diff(hit) != 1]))
        hit = hit[group_ranges(np.diff(np.append(chain, len(hit)))) % 2 == 0]
        first = np.concatenate([[True], of[hit][1:] != of[hit][:-1]])
        while True:
            new_symbols, new_seq, new_ranks, made = _apply(table, symbols, seq, ranks, hit)
            if first.all():
                break
            lower = made < lowest[of[hit]]
            if not lower.any():
                break
            early = np.zeros(len(begins), bool)
            early[of[hit[lower]]] = True
            keep = first | ~early[of[hit]]
            if keep.all():
                break
            hit, first = hit[keep], first[keep]
        symbols, seq, ranks = new_symbols, new_seq, new_ranks
    if done_seq:
        symbols, seq = np.concatenate(done_symbols), np.concatenate(done_seq)
        order = np.argsort(seq, kind="stable")
        symbols, seq = symbols[order], seq[order]
        out_counts = np.bincount(seq, minlength=len(lengths))
    return symbols, out_counts


def _apply(table: Merges, symbols: np.ndarray, seq: np.ndarray, ranks: np.ndarray, hit: np.ndarray):
    """Merge at ``hit`` and rank the new neighbours; also the lowest new rank beside each hit."""
    keep = np.ones(len(symbols), bool)
    keep[hit + 1] = False
    symbols = symbols.copy()
    symbols[hit] = table.results[ranks[hit]]
    symbols, seq, ranks = symbols[keep], seq[keep], ranks[keep]
    at = hit - np.arange(len(hit))
    dirty = np.unique(np.concatenate([at, at[at > 0] - 1]))
    fresh = np.full(len(dirty), NONE)
    inside = dirty + 1 < len(seq)
    inside[inside] = seq[dirty[inside]] == seq[dirty[inside] + 1]
    fresh[inside] = table.rank(symbols[dirty[inside]], symbols[dirty[inside] + 1])
    ranks[dirty] = fresh
    made = ranks[at].copy()
    left = at > 0
    made[left] = np.minimum(made[left], ranks[at[left] - 1])
    return symbols, seq, ranks, made


# Classes of characters in pre-token patterns.
LETTER, NUMBER, OTHER, WHITE = 1, 2, 3, 4
#: From this code point on, texts are split by the library itself.
LATIN_END = 0x250


@lru_cache(maxsize=1)
def _latin() -> tuple[np.ndarray, np.ndarray]:
    """Class of each character below LATIN_END, and its lower case (0: not one such character)."""
    import unicodedata

    kind = np.full(LATIN_END, OTHER, np.uint8)
    lower = np.arange(LATIN_END, dtype=np.int64)
    for c in range(LATIN_END):
        name = unicodedata.category(chr(c))
        if name[0] == "L":
            kind[c] = LETTER
        elif name[0] == "N":
            kind[c] = NUMBER
        elif c in (9, 10, 11, 12, 13, 32, 0x85, 0xA0):
            kind[c] = WHITE
        low = chr(c).lower()
        lower[c] = ord(low) if len(low) == 1 and ord(low) < LATIN_END else 0
    return kind, lower


class Splitter:
    """Pre-tokens of texts below LATIN_END; ``spaced``: one space may lead a pre-token."""

    def __init__(self, spaced: bool, lower: bool, single_numbers: bool):
        self.spaced, self.lower, self.single = spaced, lower, single_numbers

    def hard(self, buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Rows that the library has to split: other scripts, special strings, odd lower case."""
        bad = buf > 0xC9
        lead = np.flatnonzero(buf == 0xC9)
        bad[lead[buf[np.minimum(lead + 1, len(buf) - 1)] > 0x8F]] = True
        mark = np.flatnonzero(buf[:-1] == 60)
        bad[mark[buf[mark + 1] == 124]] = True
        if self.lower:
            kind, lower = _latin()
            two = np.flatnonzero(buf >= 0xC2)
            two = two[(buf[two] <= 0xC9) & (two + 1 < len(buf))]
            code = ((buf[two].astype(np.int64) & 31) << 6) | (buf[two + 1] & 63)
            bad[two[lower[np.minimum(code, LATIN_END - 1)] == 0]] = True
        sums = np.concatenate([[0], np.cumsum(bad)])
        return sums[offsets[1:]] > sums[offsets[:-1]]

    def split(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes after lower-casing, starts and ends of the pre-tokens of rows that are not hard."""
        kinds, lowers = _latin()
        n = len(buf)
        if not n:
            return buf, np.empty(0, np.int64), np.empty(0, np.int64)
        table = np.full(256, OTHER, np.uint8)
        table[:128] = kinds[:128]
        kind = table[buf]
        two = np.flatnonzero(buf >= 0xC2)
        two = two[(two + 1 < n)]
        if len(two):
            code = np.minimum(((buf[two].astype(np.int64) & 31) << 6) | (buf[two + 1] & 63), LATIN_END - 1)
            kind[two] = kind[two + 1] = kinds[code]
        if self.lower:
            fold = np.arange(256, dtype=np.uint8)
            fold[65:91] += 32
            buf = fold[buf]
            if len(two):
                low = lowers[code]
                ok = low >= 128
                buf[two[ok]] = 0xC0 | (low[ok] >> 6)
                buf[two[ok] + 1] = 0x80 | (low[ok] & 63)
        cont = (buf & 0xC0) == 0x80
        border = np.zeros(n + 1, bool)
        border[offsets] = True
        start = np.ones(n, bool)
        start[1:] = kind[1:] != kind[:-1]
        if self.single:
            start |= (kind == NUMBER) & ~cont
        start |= border[:-1]
        apostrophe = np.flatnonzero((buf == 39) & start)
        apostrophe = apostrophe[apostrophe + 1 < n]
        apostrophe = apostrophe[(kind[apostrophe + 1] == LETTER) & ~border[apostrophe + 1]]
        if self.spaced:
            led = (apostrophe > 0) & (buf[apostrophe - 1] == 32) & ~border[apostrophe]
            apostrophe = apostrophe[~led]
        white_end = np.empty(0, np.int64)
        if self.spaced:
            # the last white character before a word is apart from the others; a space leads the word
            last = np.flatnonzero(kind == WHITE)
            last = last[last + 1 < n]
            last = last[(kind[last + 1] != WHITE) & ~border[last + 1]]
            lead = last.copy()
            step = cont[lead] & (lead > 0)
            lead[step] -= 1
            start[lead] = True
            spaces = last[buf[last] == 32]
            start[spaces + 1] = False
        if len(apostrophe):
            one = buf[np.minimum(apostrophe + 1, n - 1)]
            inside = (apostrophe + 2 < n) & (kind[np.minimum(apostrophe + 2, n - 1)] == LETTER) & ~border[np.minimum(apostrophe + 2, n)]
            two_ = np.where(inside, buf[np.minimum(apostrophe + 2, n - 1)], 0)
            short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
            long_ = ((one == 114) & (two_ == 101)) | ((one == 118) & (two_ == 101)) | ((one == 108) & (two_ == 108))
            for chosen, size in ((short, 2), (long_ & ~short, 3)):
                p = apostrophe[chosen]
                start[p + 1] = False
                after = p[p + size < n] + size
                start[after] |= kind[after] == LETTER
        starts = np.flatnonzero(start)
        ends = np.append(starts[1:], n)
        if not self.spaced:
            words = kind[starts] != WHITE
            starts, ends = starts[words], ends[words]
        return buf, starts, ends
