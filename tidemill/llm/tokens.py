"""Token counts and token ids of whole texts.

Texts are split on their bytes (``bpe.Splitter``); each distinct pre-token that a bounded
cache does not hold is encoded once by rank-synchronous array merging (``bpe.merge``).
Rows with other scripts than Latin, or with a special string, are split by the tokenizer
library, so that its Unicode tables and its treatment of special strings apply.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm import bpe
from tidemill.llm._spark import releasing, require, table
from tidemill.llm._text import byte_values, group_ranges, hashes, passes, utf8

CACHE_BITS = 19
#: Ids that the cache holds at most; beyond that it starts anew.
CACHE_IDS = 4 << 20
#: Text that is split and looked up in one go: its temporaries are some fifty times as large.
TOKEN_BYTES = 1 << 19
#: A pre-token is merged with others in one go up to so many bytes.
MERGE_BYTES = 2 << 20


class WordCache:
    """A direct-mapped cache from a pre-token to its ids: bounded, any entry may be replaced."""

    def __init__(self, path: str, spaced: bool, lower: bool, single_numbers: bool, keep_ids: bool):
        self.merges = bpe.merges(path)
        self.path = path
        self.splitter = bpe.Splitter(spaced, lower, single_numbers)
        self.keep_ids = keep_ids
        self.values = byte_values()
        size = 1 << CACHE_BITS
        self.key = np.zeros(size, np.uint64)
        self.check = np.zeros(size, np.uint64)
        self.count = np.zeros(size, np.int64)
        self.at = np.zeros(size, np.int64)
        self.ids = np.empty(1 << 16, np.uint32)
        self.used = 0

    def _encode(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, counts = [], []
        sizes = ends - starts
        for i, j in passes(np.concatenate([[0], np.cumsum(sizes)]), MERGE_BYTES):
            take = np.repeat(starts[i:j], sizes[i:j]) + group_ranges(sizes[i:j])
            got, n = bpe.merge(self.merges, buf[take], sizes[i:j])
            ids.append(got.astype(np.uint32))
            counts.append(n)
        return np.concatenate(ids), np.concatenate(counts)

    def lookup(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """How many ids each pre-token has and, if wanted, all their ids one after the other."""
        n = len(starts)
        if not n:
            return np.empty(0, np.int64), np.empty(0, np.uint32)
        h = hashes(buf, starts, ends, self.values)
        size = ends - starts
        check = size.astype(np.uint64)
        for i in range(3):
            check = (check << np.uint64(16)) ^ (buf[np.minimum(starts + i, ends - 1)].astype(np.uint64) << np.uint64(8)) ^ buf[np.maximum(ends - 1 - i, starts)]
        slot = (h >> np.uint64(64 - CACHE_BITS)).astype(np.int64)
        miss = np.flatnonzero((self.key[slot] != h) | (self.check[slot] != check))
        count, at = self.count[slot], self.at[slot]
        extra = np.empty(0, np.uint32)
        if len(miss):
            _, first, inverse = np.unique(h[miss], return_index=True, return_inverse=True)
            fresh = miss[first]
            ids, n_ids = self._encode(buf, starts[fresh], ends[fresh])
            count[miss] = n_ids[inverse]
            if self.keep_ids:
                # ids of this batch's misses stand after the cache's own, whether or not they are kept
                place = np.cumsum(n_ids) - n_ids
                at[miss] = self.used + place[inverse]
                extra = ids
            room = self.used + len(ids) <= CACHE_IDS
            if not self.keep_ids or room:
                s = slot[fresh]
                self.key[s], self.check[s], self.count[s] = h[fresh], check[fresh], n_ids
                if self.keep_ids:
                    self.at[s] = self.used + place
                    if len(self.ids) < self.used + len(ids):
                        self.ids = np.concatenate([self.ids, np.empty(max(len(self.ids), len(ids)), np.uint32)])
                    self.ids[self.used : self.used + len(ids)] = ids
        if not self.keep_ids:
            return count, None
        if len(miss) and room:
            source, self.used = self.ids, self.used + len(extra)
        elif len(miss):
            source = np.concatenate([self.ids[: self.used], extra])
        else:
            source = self.ids
        out = source[np.repeat(at, count) + group_ranges(count)]
        if len(miss) and not room:
            self.key[:] = 0
            self.check[:] = 0
            self.used = 0
        return count, out

    def rows(self, column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
        """For ranges of rows in turn: ids in each row and, if wanted, their ids."""
        buf, offsets = utf8(column)
        for i, j in passes(offsets, TOKEN_BYTES):
            part, off = buf[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
            hard = self.splitter.hard(part, off) if len(part) else np.zeros(j - i, bool)
            low, starts, ends = self.splitter.split(part, off)
            first = np.searchsorted(starts, off)
            if hard.any():
                easy = ~np.repeat(hard, np.diff(first))
                starts, ends = starts[easy], ends[easy]
                first = np.searchsorted(starts, off)
            count, ids = self.lookup(low, starts, ends)
            sums = np.concatenate([[0], np.cumsum(count)])
            per_row = sums[first[1:]] - sums[first[:-1]]
            if hard.any():
                pieces, at = [], 0
                for r in np.flatnonzero(hard).tolist():
                    got = self._hard(bytes(part[off[r] : off[r + 1]]).decode("utf-8", "replace"))
                    if ids is not None:
                        pieces += [ids[at : sums[first[r]]], got]
                        at = sums[first[r]]
                    per_row[r] = len(got)
                if ids is not None:
                    ids = np.concatenate([*pieces, ids[at:]])
            yield per_row, ids

    @cached_property
    def library(self):
        """Loaded when the first hard row comes: it takes more memory than all else here."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _hard(self, text: str) -> np.ndarray:
        if not self.keep_ids and "<|" not in text:
            pieces = [x for x, _ in self.library.pre_tokenizer.pre_tokenize_str(text)]
            back = _bytes_of_symbols()
            data = [bytes(back[c] for c in x) for x in pieces]
            if not data:
                return np.empty(0, np.uint32)
            ends = np.cumsum([len(x) for x in data])
            starts = ends - [len(x) for x in data]
            ids, _ = self._encode(np.frombuffer(b"".join(data), np.uint8), starts, ends)
            return ids
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


@lru_cache(maxsize=1)
def _bytes_of_symbols() -> dict[str, int]:
    return {c: b for b, c in enumerate(bpe.byte_symbols())}


@lru_cache(maxsize=4)
def word_cache(path: str, spaced: bool, lower: bool, single_numbers: bool, keep_ids: bool) -> WordCache:
    """One cache in each Python worker."""
    return WordCache(path, spaced, lower, single_numbers, keep_ids)


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 512, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """id, n_bytes, n_tokens, over_limit of every row, by a byte-level BPE vocabulary file.

    Null texts count as empty: no bytes, no tokens. Rows are not grouped, so repeated
    ids stay repeated rows; columns other than the two named are ignored.
    """
    require(docs, (id_column, text_column))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_cache(vocabulary, True, False, False, False)
        for batch in batches:
            _, offsets = utf8(batch.column(1))
            parts = [n for n, _ in cache.rows(batch.column(1))]
            n_tokens = np.concatenate(parts) if parts else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(n_tokens.astype(np.int64))], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    counted = rows.mapInArrow(releasing(count), "doc_id long, n_bytes long, n_tokens long")
    return counted.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
