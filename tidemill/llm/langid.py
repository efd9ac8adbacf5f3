"""Language identification by cross-parsing entropy.

For each language, a suffix automaton of a bounded sample of labelled text. A text is
parsed against it into the longest phrases that occur in the sample; a language whose
sample explains the text needs few phrases. The language with the fewest phrases per
letter wins.

All texts are parsed whole. The blocks of a batch, ``BLOCK`` characters each, step through
dense transition arrays side by side in all languages, every one as if a phrase began with
it. Then the phrase that is open at the end of a block is carried into the next one, beside
the parse that began there, until both stand in the same state: counts are those of one
parse over the whole text, whatever the size of a block.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm._spark import releasing, require, table, with_columns

#: Characters of a block, a matter of speed alone: phrases run on over its borders.
BLOCK = 512
#: Blocks that are parsed side by side.
SIDE_BY_SIDE = 2048
#: Labelled text that is learned: whole texts of each language, at most so many and of at
#: most so many characters together; texts within the share come before longer ones.
SAMPLE_DOCS = 256
SAMPLE_CHARS = 40_000
SHARE = 1 / 8
#: Letters that have a column in the dense table; rarer ones are looked up among the arcs.
DENSE = 120
PAD, SPACE, UNKNOWN = 0, 1, 2


class Model(NamedTuple):
    """``steps[state + symbol]``: twice the next state's row, plus 1 where a phrase ended before the symbol.

    States are row offsets of ``steps``. Letters beyond the dense columns step by ``arcs``:
    sorted ``state * len(symbols) + symbol`` and, in ``targets``, the next row.
    """

    languages: tuple[str, ...]
    roots: np.ndarray
    steps: np.ndarray
    width: int
    symbols: dict[str, int]
    arcs: np.ndarray
    targets: np.ndarray

    def rare(self, state: np.ndarray, root: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """What ``steps`` would hold for symbols beyond the dense columns."""
        n = len(self.symbols) + 3
        to = self._arc(state * n + symbol)
        anew = self._arc(root * n + symbol)
        return np.where(to >= 0, 2 * to, 2 * np.where(anew >= 0, anew, root) + 1)

    def _arc(self, key: np.ndarray) -> np.ndarray:
        if not len(self.arcs):
            return np.full(len(key), -1, np.int64)
        at = np.minimum(np.searchsorted(self.arcs, key), len(self.arcs) - 1)
        return np.where(self.arcs[at] == key, self.targets[at], -1)


def suffix_automaton(text: np.ndarray) -> tuple[list[dict[int, int]], int]:
    """Transitions of the suffix automaton of a sequence; state 0 is the empty phrase."""
    follow: list[dict[int, int]] = [{}]
    link, length, last = [-1], [0], 0
    for c in text.tolist():
        now = len(follow)
        follow.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in follow[p]:
            follow[p][c] = now
            p = link[p]
        if p >= 0:
            q = follow[p][c]
            if length[q] == length[p] + 1:
                link[now] = q
            else:
                copy = len(follow)
                follow.append(dict(follow[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and follow[p].get(c) == q:
                    follow[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    return follow, len(follow)


def normal(text: str) -> str:
    """Letters in lower case, everything else as single spaces."""
    return "".join(_fold(c) for c in text)


def _fold(c: str) -> str:
    return c.lower()[0] if c.isalpha() else " "


def fit(samples: dict[str, list[str]]) -> Model:
    """The model of some labelled texts: language -> texts, all of them learned whole."""
    texts = {name: " ".join(p for p in (" ".join(normal(t).split()) for t in samples[name]) if p) for name in sorted(samples)}
    counts: dict[str, int] = {}
    for text in texts.values():
        for c in text.replace(" ", ""):
            counts[c] = counts.get(c, 0) + 1
    symbols = {c: 3 + i for i, c in enumerate(sorted(counts, key=lambda c: (-counts[c], c)))}
    width = 3 + min(DENSE, len(symbols))
    roots, tables, arcs, targets, base = [], [], [], [], 0
    for name in texts:
        ids = np.array([SPACE if c == " " else symbols[c] for c in texts[name]], np.int64)
        follow, n = suffix_automaton(ids)
        # rows of this and the earlier languages are numbered together
        step = np.full((n, width), -1, np.int32 if 2 * (base + n) * width < 2**31 else np.int64)
        for s, out in enumerate(follow):
            for c, to in out.items():
                if c < width:
                    step[s, c] = to
                else:
                    arcs.append((base + s) * width * (len(symbols) + 3) + c)
                    targets.append((base + to) * width)
        first = np.where(step[0] >= 0, step[0], 0)
        out = np.where(step >= 0, step * 2, first[None, :] * 2 + 1)
        out[:, PAD] = np.arange(n) * 2
        # rows are addressed by state * width, over the tables of all languages
        out += 2 * base
        tables.append(((out >> 1) * (2 * width) + (out & 1)).reshape(-1))
        roots.append(base * width)
        base += n
    steps = np.concatenate(tables) if tables else np.zeros(width, np.int32)
    order = np.argsort(np.array(arcs, np.int64))
    return Model(tuple(texts), np.array(roots, np.int64), steps, width, symbols, np.array(arcs, np.int64)[order], np.array(targets, np.int64)[order])


@lru_cache(maxsize=1)
def _alphabetic() -> np.ndarray:
    """For each code point, that of its folded letter, 0 for anything else."""
    out = np.zeros(0x110000, np.int32)
    for c in range(0x110000):
        if chr(c).isalpha():
            out[c] = ord(chr(c).lower()[0])
    return out


def phrases(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Phrases of each text by each language, and the letters in each text."""
    lut = _lut(model)
    n_languages = len(model.languages)
    counts = np.zeros((len(texts), n_languages), np.int64)
    letters = np.zeros(len(texts), np.int64)
    blocks: list[np.ndarray] = []
    owner: list[int] = []
    # which blocks begin and end their text; the states at the end of what was parsed before
    begins: list[bool] = []
    closes: list[bool] = []
    before = model.roots

    def flush() -> None:
        nonlocal before
        n = len(blocks)
        grid = np.zeros((BLOCK, n), np.int32)
        for i, block in enumerate(blocks):
            grid[: len(block), i] = block
        root = np.repeat(model.roots, n)
        ends, fresh = _parse(model, grid, root)
        state = fresh.copy()
        first = np.tile(begins, n_languages)
        extra = np.zeros(len(root), np.int64)
        lead = np.arange(n_languages) * n
        todo = np.flatnonzero(~first)
        while len(todo):
            came = state[todo - 1]
            at = todo % n == 0
            came[at] = before[todo[at] // n]
            extra[todo], end = _carry(model, grid, todo, came, root[todo], fresh[todo])
            moved = todo[end != state[todo]]
            state[todo] = end
            # parses that did not meet in their block: the blocks behind it came from elsewhere
            todo = np.setdiff1d(moved + 1, lead)
            todo = todo[todo < len(root)]
            todo = todo[~first[todo]]
        ends += extra + (np.tile(closes, n_languages) & (state != root))
        np.add.at(counts, np.array(owner), ends.reshape(n_languages, n).T)
        before = state[lead + n - 1]
        for kept in (blocks, owner, begins, closes):
            kept.clear()

    for r, text in enumerate(texts):
        if not text:
            continue
        ids = lut[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]
        letters[r] = (ids >= UNKNOWN).sum()
        ids[1:][(ids[1:] == SPACE) & (ids[:-1] == SPACE)] = PAD
        for a in range(0, len(ids), BLOCK):
            blocks.append(ids[a : a + BLOCK])
            owner.append(r)
            begins.append(a == 0)
            closes.append(a + BLOCK >= len(ids))
            if len(blocks) == SIDE_BY_SIDE:
                flush()
    if blocks:
        flush()
    return counts, letters


def _step(model: Model, state: np.ndarray, root: np.ndarray, symbol: np.ndarray, rare: bool) -> np.ndarray:
    """``steps`` of states by symbols, also of those beyond the dense columns where there are any."""
    to = model.steps[state + (np.where(symbol < model.width, symbol, UNKNOWN) if rare else symbol)]
    if rare:
        some = np.flatnonzero(symbol >= model.width)
        to[some] = model.rare(state[some], root[some], symbol[some])
    return to


def _parse(model: Model, grid: np.ndarray, root: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phrases that end in each block by each language, and the state at its end, from the root on."""
    state, n = root, grid.shape[1]
    ends = np.zeros(len(root), np.int64)
    has_rare = (grid >= model.width).any(1).tolist()
    for column, rare in zip(grid, has_rare, strict=True):
        to = _step(model, state, root, np.tile(column, len(root) // n), rare)
        ends += to & 1
        state = to >> 1
    return ends, state


def _carry(model: Model, grid: np.ndarray, at: np.ndarray, came: np.ndarray, root: np.ndarray, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks ``at`` entered in the states ``came``: phrases more than from the root on, and the state at the end.

    Both parses step along until they meet; ``fresh`` is where the one from the root (or
    any that met it) ends.
    """
    block = at % grid.shape[1]
    more = np.zeros(len(at), np.int64)
    end = fresh.copy()
    live = np.flatnonzero(came != root)
    one, two = came[live], root[live]
    for t in range(len(grid)):
        if t % 8 == 0:
            apart = one != two
            live, one, two = live[apart], one[apart], two[apart]
            if not len(live):
                return more, end
        symbol = grid[t, block[live]]
        rare = bool((symbol >= model.width).any())
        one, two = (_step(model, s, root[live], symbol, rare) for s in (one, two))
        more[live] += (one & 1).astype(np.int64) - (two & 1)
        one, two = one >> 1, two >> 1
    end[live] = one
    return more, end


_LUTS: dict[tuple, np.ndarray] = {}


def _lut(model: Model) -> np.ndarray:
    key = tuple(model.symbols)
    if key not in _LUTS:
        _LUTS.clear()
        fold = _alphabetic()
        symbol = np.full(0x110000, UNKNOWN, np.int32)
        symbol[0] = SPACE
        for c, s in model.symbols.items():
            symbol[ord(c)] = s
        _LUTS[key] = symbol[fold]
    return _LUTS[key]


def predict(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language of each text and a score: how far the second language is behind, 0 to 1.

    ``und`` and 0 where there is no letter, or nothing was learned. Ties go to the
    language that comes first by name.
    """
    if not model.languages:
        return ["und"] * len(texts), np.zeros(len(texts))
    counts, letters = phrases(model, texts)
    best = counts.argmin(1)
    low = counts[np.arange(len(texts)), best].astype(float)
    if len(model.languages) > 1:
        second = np.partition(counts, 1, axis=1)[:, 1].astype(float)
        score = np.where(second > 0, (second - low) / np.maximum(second, 1), 0.0)
    else:
        score = np.ones(len(texts))
    score[letters == 0] = 0.0
    return [model.languages[b] if n else "und" for b, n in zip(best.tolist(), letters.tolist(), strict=True)], score


def held_out() -> Column:
    """Rows that are never learned from: crc32 of doc_id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS) -> Model:
    """A model of a bounded sample: of each language the whole texts whose ids hash lowest.

    Every language with a letter in ``docs`` is learned: texts of at most ``SHARE`` of
    ``sample_chars`` characters first, then longer ones, each in the order of their ids'
    hashes, as long as they are at most ``sample_docs`` and within ``sample_chars``. Only a
    language whose first text alone is longer gives a window of it, from a place that its
    id decides. Rows whose label, text or id is null, that hold no letter, or that are held
    out, are not learned from, also where their id repeats; texts under one id and label
    are rows of their own, and rows that repeat all of them count once.
    """
    require(docs, ("doc_id", "text", "lang"))
    rows = docs.select(F.col("doc_id"), F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    labelled = rows.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & F.col("doc_id").isNotNull() & ~held_out()).withColumn("h", F.xxhash64("doc_id"))
    labelled = labelled.withColumn("key", F.xxhash64("text"))
    # ranked in parts of a language first, so that no task sees all of a common one
    keys = ["lang", "h", "doc_id", "key"]
    chosen = labelled.groupBy(*keys).agg(F.max(F.length("text")).alias("size")).withColumn("part", F.pmod(F.xxhash64("h", "key"), F.lit(64)))
    order = [F.col("size") > sample_chars * SHARE, F.col("h"), F.col("doc_id"), F.col("key")]
    for group in (("lang", "part"), ("lang",)):
        nth = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
        chosen = chosen.withColumn("nth", nth).where(F.col("nth") <= sample_docs)
    # sample_docs rows a language
    total = F.sum("size").over(Window.partitionBy("lang").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    chosen = chosen.withColumn("total", total).where((F.col("total") <= sample_chars) | (F.col("nth") == 1))
    chosen = chosen.select(*keys, F.least("size", F.lit(sample_chars)).alias("size"))
    at = F.pmod("h", F.greatest(F.lit(1), F.length("text") - F.col("size") + 1))
    picked = labelled.join(F.broadcast(chosen), keys)
    # rows that repeat a chosen one are as good as it: at most sample_docs texts a language reach the driver
    picked = picked.select(*keys, F.substring("text", (at + 1).cast("int"), F.col("size").cast("int")).alias("part")).groupBy(*keys).agg(F.min("part").alias("part"))
    samples: dict[str, list[tuple[int, int, int, str]]] = {}
    for r in picked.collect():
        samples.setdefault(r["lang"], []).append((r["h"], r["doc_id"], r["key"], r["part"]))
    return fit({k: [v[-1] for v in sorted(rows)] for k, rows in samples.items()})


def identify(docs: DataFrame, model: Model, predicted: str = "lang_pred", scored: str = "score") -> DataFrame:
    """``docs`` with the columns ``predicted`` and ``scored``. Only ``text`` is read; null and empty texts are ``und``.

    Rows are not grouped: repeated rows give repeated results, an empty table none.
    Columns that are named like the results are replaced.
    """
    require(docs, ("text",))
    kept = docs.drop(predicted, scored).withColumn("text", F.col("text").cast("string"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the sample

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("text")
            names: list[str] = []
            scores: list[np.ndarray] = []
            for a in range(0, batch.num_rows, 1024):
                got, s = predict(shared.value, column.slice(a, 1024).to_pylist())
                names += got
                scores.append(s)
            scores = np.concatenate(scores) if scores else np.empty(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores)], names=[*batch.schema.names, predicted, scored])

    return kept.mapInArrow(releasing(score), with_columns(kept, f"`{predicted}` string, `{scored}` double"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = identify(docs.select("doc_id", "text"), learn(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def brute_force(samples: dict[str, str], text: str) -> dict[str, int]:
    """Phrases of a text by each normalised sample, by searching for ever longer phrases."""
    out = {}
    for name, sample in samples.items():
        n, phrase, previous = 0, "", ""
        for c in normal(text):
            if c == " " and previous == " ":
                continue
            previous = c
            if phrase + c in sample:
                phrase += c
            else:
                n += 1
                phrase = c if c in sample else ""
        n += bool(phrase)
        out[name] = n
    return out
