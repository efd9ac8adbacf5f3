"""Best-fit packing of token sequences into bins of fixed capacity.

Lengths are whole numbers up to the capacity, so the packing is planned on their
histogram, not on the documents: large items (above a third of the capacity, at most two
to a bin) are matched greedily, each with the largest partner that fits; smaller items
fill the tightest gap that holds them. The plan is a list of rules "items of this length,
from this rank on, go to these bins at this place"; its size depends on the capacity
alone. Items get their rank within their length from counts by scan partition, and their
bin from the rule that holds the rank. No length, however frequent, is gathered anywhere.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm._spark import releasing, require, table, written
from tidemill.llm._text import passes, utf8
from tidemill.llm.tokens import word_cache

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, part long, local_rank long"


class Rule(NamedTuple):
    """``count`` items of ``length`` from rank ``rank`` on; ``each`` to a bin, from bin ``bin`` on, at ``offset``."""

    length: int
    rank: int
    count: int
    bin: int
    each: int
    offset: int


def plan(histogram: dict[int, int], capacity: int) -> tuple[list[Rule], int]:
    """Rules for ``histogram`` (items by length) and the number of bins."""
    left = {n: c for n, c in sorted(histogram.items()) if c and n > 0}
    if left and max(left) > capacity:
        raise ValueError("an item is longer than the capacity")
    used = dict.fromkeys(left, 0)
    rules: list[Rule] = []
    gaps: dict[int, list[tuple[int, int]]] = {}
    order: list[int] = []
    bins = 0

    def put(length: int, count: int, first_bin: int, each: int, offset: int) -> None:
        rules.append(Rule(length, used[length], count, first_bin, each, offset))
        used[length] += count
        left[length] -= count

    def leave(gap: int, first_bin: int, count: int) -> None:
        if gap and count:
            if gap not in gaps:
                gaps[gap] = []
                insort(order, gap)
            gaps[gap].append((first_bin, count))

    large = [n for n in left if 3 * n > capacity]
    for n in reversed(large):
        while left[n]:
            at = bisect_left(large, capacity - n + 1)
            partner = next((m for m in reversed(large[:at]) if left[m] > (m == n)), None)
            if partner is None:
                count = left[n]
                put(n, count, bins, 1, 0)
                leave(capacity - n, bins, count)
            else:
                count = left[n] // 2 if partner == n else min(left[n], left[partner])
                put(n, count, bins, 1, 0)
                put(partner, count, bins, 1, n)
                leave(capacity - n - partner, bins, count)
            bins += count
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        while left[n]:
            at = bisect_left(order, n)
            if at < len(order):
                gap = order[at]
                first, there = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    order.pop(at)
                count = min(left[n], there)
                put(n, count, first, 1, capacity - gap)
                leave(gap - n, first, count)
                leave(gap, first + count, there - count)
            else:
                each = capacity // n
                full, rest = divmod(left[n], each)
                if full:
                    put(n, full * each, bins, each, 0)
                    leave(capacity - each * n, bins, full)
                    bins += full
                if rest:
                    put(n, rest, bins, rest, 0)
                    leave(capacity - rest * n, bins, 1)
                    bins += 1
    return rules, bins


def token_pieces(docs: DataFrame, vocabulary: str, capacity: int, end_id: int, with_ids: bool = False) -> DataFrame:
    """Pieces of at most ``capacity`` ids of each document's ids and ``end_id``.

    ``part`` and ``local_rank`` number the pieces of each length within the scan's
    partition; write the result before use, so that they stay as they are.
    """
    schema = PIECES + (", ids binary" if with_ids else "")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = word_cache(vocabulary, False, True, True, True)
        part = TaskContext.get().partitionId()
        seen = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            column = batch.column(1)
            _, offsets = utf8(column)
            done = 0
            for i, j in passes(offsets):
                out: dict[str, list] = {"piece": [], "start": [], "length": [], "crc": [], "ids": []}
                rows: list[int] = []
                for counts, ids in cache.rows(column.slice(i, j - i)):
                    ends = np.cumsum(counts)
                    for r, (a, b) in enumerate(zip((ends - counts).tolist(), ends.tolist(), strict=True)):
                        whole = ids[a:b].astype("<u4").tobytes() + end_id.to_bytes(4, "little")
                        for k, at in enumerate(range(0, len(whole), 4 * capacity)):
                            piece = whole[at : at + 4 * capacity]
                            rows.append(done + r)
                            out["piece"].append(k)
                            out["start"].append(at // 4)
                            out["length"].append(len(piece) // 4)
                            out["crc"].append(zlib.crc32(piece))
                            if with_ids:
                                out["ids"].append(piece)
                    done += len(counts)
                length = np.array(out["length"], np.int64)
                order = np.argsort(length, kind="stable")
                begins = np.flatnonzero(np.concatenate([[True], np.diff(length[order]) != 0])) if len(order) else np.empty(0, np.int64)
                sizes = np.diff(np.append(begins, len(order)))
                rank = np.empty(len(order), np.int64)
                rank[order] = np.arange(len(order)) - np.repeat(begins, sizes)
                rank += seen[length]
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(out["piece"], pa.int32()), pa.array(out["start"], pa.int64()), pa.array(length), pa.array(out["crc"], pa.int64()), pa.array(np.full(len(rank), part, np.int64)), pa.array(rank)] + ([pa.array(out["ids"], pa.binary())] if with_ids else []),
                    names=[x.split(" ")[0] for x in schema.split(", ")],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(releasing(cut), schema)


def pack(docs: DataFrame, vocabulary: str, capacity: int = 2048, end_id: int = 0, with_ids: bool = False) -> DataFrame:
    """One row per piece of each row of ``docs`` (doc_id, text) with its sequence and place there.

    Null texts are empty: their only id is ``end_id``. Repeated rows are packed each; an
    empty table gives no rows; other columns are ignored.
    """
    require(docs, ("doc_id", "text"))
    pieces = written(token_pieces(docs, vocabulary, capacity, end_id, with_ids), "packing-pieces")
    counts = pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n"))
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    rules, _ = plan(histogram, capacity)
    rules.sort()
    by_length: dict[int, np.ndarray] = {}
    for length in {r.length for r in rules}:
        by_length[length] = np.array([r[1:] for r in rules if r.length == length], np.int64)
    shared = docs.sparkSession.sparkContext.broadcast(by_length)  # at most one entry a rule: bounded by the capacity

    before = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("length", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    ranked = pieces.join(starts, ["length", "part"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("before").to_numpy(zero_copy_only=False) + batch.column("local_rank").to_numpy(zero_copy_only=False)
            bin_, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length).tolist():
                mine = np.flatnonzero(length == n)
                r = shared.value[n]
                rule = r[np.searchsorted(r[:, 0], rank[mine], "right") - 1]
                within = rank[mine] - rule[:, 0]
                bin_[mine] = rule[:, 2] + within // rule[:, 3]
                offset[mine] = rule[:, 4] + within % rule[:, 3] * n
            names = [x for x in batch.schema.names if x not in ("part", "local_rank", "before")]
            yield pa.RecordBatch.from_arrays([*(batch.column(x) for x in names), pa.array(bin_), pa.array(offset)], names=[*names, "sequence_id", "offset"])

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids binary" if with_ids else "")
    names = [x.split(" ")[0] for x in schema.split(", ")]
    return ranked.select(*names, "part", "local_rank", "before").mapInArrow(releasing(place), schema + ", sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """The packed sequences: their ids, and the documents in them, in order (needs ``with_ids``)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "piece", "ids")))
    grouped = packed.groupBy("sequence_id").agg(parts.alias("parts"))
    ids = F.aggregate("parts", F.lit(b""), lambda a, p: F.concat(a, p["ids"]))
    return grouped.select("sequence_id", F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"), ids.alias("ids"))


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
