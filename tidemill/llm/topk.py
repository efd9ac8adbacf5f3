"""Exact top-k search by distributed histogram selection.

Every query is scored against every candidate, in blocks of queries that go to the
executors by broadcast (``QUERY_BLOCK`` rows of the vectors' dimension: bounded). A pass
over the candidates adds up, for each query, a histogram of its scores over the interval
that must hold its k-th highest score; the bin that does becomes the next interval, until
it is one whole score. A last pass keeps what reaches that score, at most k rows a query
from each partition, and ties go to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from operator import mul

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm._spark import require, table, written

QUERY_BLOCK = 2048
BINS = 512
#: Scores that one step of a pass holds.
SCORES = 1 << 21
#: Quantised components from which a vector is scored in Python's whole numbers.
LARGE = 2.0**23


def quantised(vectors: DataFrame, scale: int = 256) -> DataFrame:
    """vec_id, x (array of floor(scale * component), as doubles) of the rows that take part.

    Rows whose id or vector is null, or whose vector holds a null or non-finite
    component, take no part.
    """
    require(vectors, ("vec_id", "embedding"))
    scaled = lambda v: F.lit(float(scale)) * v.cast("double")
    # doubles from 2^52 are whole; floor gives a long
    x = F.transform("embedding", lambda v: F.when(F.abs(scaled(v)) < F.lit(2.0**52), F.floor(scaled(v)).cast("double")).otherwise(scaled(v)))
    sound = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    rows = vectors.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(F.coalesce(sound, F.lit(False)))
    return rows.select(F.col("vec_id").cast("long").alias("vec_id"), x.alias("x"))


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat components and lengths of a list column."""
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]].astype(np.float64), np.diff(offsets)


class Block:
    """A block of queries: ids and vectors, by dimension."""

    def __init__(self, rows: list[tuple[int, list[int]]]):
        self.ids = np.array([i for i, _ in rows], np.int64)
        self.dims = np.array([len(x) for _, x in rows], np.int64)
        self.groups = {d: np.flatnonzero(self.dims == d) for d in np.unique(self.dims).tolist()}
        self.vectors = {d: np.array([rows[i][1] for i in at], np.float64).reshape(len(at), d).T.copy() for d, at in self.groups.items()}
        self.bound = np.array([np.abs(np.array(x, np.float64)).sum() for _, x in rows])

    def scores(self, batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Queries, candidate ids and whole scores (exact in doubles below 2^53), in bounded steps."""
        ids = batch.column(0).to_numpy()
        flat, lengths = _matrix(batch.column(1))
        begins = np.cumsum(lengths) - lengths
        for d, at in self.groups.items():
            mine = np.flatnonzero(lengths == d)
            step = max(1, SCORES // len(at))
            for a in range(0, len(mine), step):
                rows = mine[a : a + step]
                x = flat[begins[rows][:, None] + np.arange(d)]
                yield at, ids[rows], (x @ self.vectors[d]).T


def _histograms(candidates: DataFrame, shared, low: np.ndarray, width: np.ndarray) -> np.ndarray:
    """For each query: scores above its interval, and scores in each bin of it."""
    n = len(low)
    session = candidates.sparkSession
    edges = session.sparkContext.broadcast((low, width))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, (low, width) = shared.value, edges.value
        total = np.zeros((n, BINS + 1), np.int64)
        for batch in batches:
            for at, ids, scores in block.scores(batch):
                place = np.floor_divide(scores - low[at][:, None], width[at][:, None])
                np.clip(place, -1, BINS, out=place)
                place[ids[None, :] == block.ids[at][:, None]] = -1
                place = place.astype(np.int64) + 1
                flat = np.bincount((place + np.arange(len(at))[:, None] * (BINS + 2)).ravel(), minlength=len(at) * (BINS + 2))
                total[at] += flat.reshape(len(at), BINS + 2)[:, 1:]
        q, b = np.nonzero(total)
        for a in range(0, len(q), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(q[a : a + (1 << 16)]), pa.array(b[a : a + (1 << 16)]), pa.array(total[q[a : a + (1 << 16)], b[a : a + (1 << 16)]])], names=["q", "b", "n"])

    counts = candidates.mapInArrow(count, "q long, b long, n long").groupBy("q", "b").agg(F.sum("n").alias("n"))
    above = Window.partitionBy("q").orderBy(F.col("b").desc())
    running = counts.withColumn("upto", F.sum("n").over(above))
    return running


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, scale: int = 256) -> DataFrame:
    """query_id, rank, vec_id, score of each query's ``k`` highest scores; all, if fewer.

    Candidates are all rows but those with the query's own id and those of another
    dimension. Query rows that repeat both id and vector count once; candidates that
    repeat an id each take a rank, in any order. An empty table gives no rows, other
    columns are ignored. A score beyond 64 bits among the results is an error.
    """
    rows = written(quantised(vectors, scale), "topk-vectors")
    queries = rows.where(is_query).dropDuplicates()
    is_large = F.exists("x", lambda v: F.abs(v) >= F.lit(LARGE))
    small, large = rows.where(~is_large), rows.where(is_large)
    largest = small.agg(F.max(F.array_max(F.transform("x", lambda v: F.abs(v))))).first()[0] or 0
    large = large if large.limit(1).collect() else None
    queries = written(queries.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-queries.count() // QUERY_BLOCK))))), "topk-queries")
    parts = None
    for (number,) in sorted(queries.select("block").distinct().collect()):
        mine = [(r["vec_id"], r["x"]) for r in queries.where(F.col("block") == number).select("vec_id", "x").orderBy("vec_id", "x").collect()]
        for a in range(0, len(mine), QUERY_BLOCK):
            some = mine[a : a + QUERY_BLOCK]
            # a score is exact in doubles if no sum of its products' sizes reaches 2^53
            sure = [max(map(abs, x), default=0) < LARGE and sum(map(abs, x)) * largest < 2.0**53 for _, x in some]
            fast, slow = [q for q, yes in zip(some, sure, strict=True) if yes], [q for q, yes in zip(some, sure, strict=True) if not yes]
            found = [_ranked(_exact(rows, slow, k), k)] if slow else []
            if fast:
                kept = _answers(small, Block(fast), k, float(largest))
                if large is not None:
                    kept = kept.withColumn("score", F.col("score").cast("decimal(38,0)")).unionByName(_exact(large, fast, k))
                found.append(_ranked(kept, k))
            for part in found:
                parts = part if parts is None else parts.unionByName(part)
    if parts is None:
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).cast("int").alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).where(F.lit(False))
    return parts


def _answers(rows: DataFrame, block: Block, k: int, largest: float) -> DataFrame:
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(block)
    n = len(block.ids)
    low = -np.floor(block.bound * largest) - 1
    width = np.maximum(1, np.ceil((1 - 2 * low) / BINS))
    want = np.full(n, k, np.int64)
    kth = np.full(n, -np.inf)
    open_ = np.ones(n, bool)
    while open_.any():
        # the highest bin down to which there are at least as many scores as are wanted
        running = _histograms(rows, shared, low, width)
        wanted = spark.createDataFrame([(i, int(w)) for i, w in enumerate(want) if open_[i]], "q long, want long")
        reached = running.join(F.broadcast(wanted), "q").where(F.col("upto") >= F.col("want"))
        found = {r["q"]: (r["b"], r["upto"]) for r in reached.groupBy("q").agg(F.max_by(F.struct("b", "upto"), "b").alias("s")).select("q", "s.*").collect()}
        for i in np.flatnonzero(open_).tolist():
            if i not in found:
                open_[i] = False  # fewer candidates than wanted: all of them
                continue
            b, _ = found[i]
            if b == BINS:
                raise AssertionError("scores beyond their bound")
            low[i] += b * width[i]
            if width[i] == 1:
                kth[i], open_[i] = low[i], False
            else:
                width[i] = max(1, np.ceil(width[i] / BINS))
    cut = spark.sparkContext.broadcast(kth)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, kth = shared.value, cut.value
        best: dict[int, list[tuple[float, int]]] = {}
        for batch in batches:
            for at, ids, scores in block.scores(batch):
                reach = (scores >= kth[at][:, None]) & (ids[None, :] != block.ids[at][:, None])
                q, c = np.nonzero(reach)
                order = np.lexsort((ids[c], -scores[q, c], q))
                q, c = q[order], c[order]
                begins = np.flatnonzero(np.concatenate([[True], np.diff(q) != 0])) if len(q) else np.empty(0, np.int64)
                nth = np.arange(len(q)) - np.repeat(begins, np.diff(np.append(begins, len(q))))
                for i, j in zip(q[nth < k].tolist(), c[nth < k].tolist(), strict=True):
                    best.setdefault(int(at[i]), []).append((-float(scores[i, j]), int(ids[j])))
            for i in best:
                best[i] = sorted(best[i])[:k]
        out = [(int(block.ids[i]), i, v, int(-s)) for i, have in best.items() for s, v in have]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], pa.int64()) for i in range(4)], names=["query_id", "q", "vec_id", "score"])

    return rows.mapInArrow(keep, "query_id long, q long, vec_id long, score long")


def _exact(rows: DataFrame, queries: list[tuple[int, list[float]]], k: int) -> DataFrame:
    """The k best of each partition for each query, scored in Python's whole numbers."""
    shared = rows.sparkSession.sparkContext.broadcast(queries)
    most = 10**38 - 1

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = [(q, i, [int(v) for v in x]) for q, (i, x) in enumerate(shared.value)]
        best: list[list[tuple[int, int]]] = [[] for _ in whole]
        for batch in batches:
            for vec_id, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x = [int(v) for v in x]
                for q, i, y in whole:
                    if i != vec_id and len(y) == len(x):
                        have = best[q]
                        have.append((-sum(map(mul, x, y)), vec_id))
                        if len(have) >= k + 64:
                            have.sort()
                            del have[k:]
        out = [(i, q, v, Decimal(max(-most, min(most, -s)))) for q, i, _ in whole for s, v in sorted(best[q])[:k]]
        types = [pa.int64(), pa.int64(), pa.int64(), pa.decimal128(38, 0)]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], t) for i, t in enumerate(types)], names=["query_id", "q", "vec_id", "score"])

    return rows.mapInArrow(keep, "query_id long, q long, vec_id long, score decimal(38,0)")


def _ranked(kept: DataFrame, k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id"))
    kept = kept.withColumn("rank", rank).where(F.col("rank") <= k)
    fits = F.col("score").between(F.lit(-(2**63 - 1)), F.lit(2**63 - 1))
    score = F.when(fits, F.col("score").cast("long")).otherwise(F.raise_error(F.lit("a score is beyond 64 bits")).cast("long"))
    return kept.select("query_id", "rank", "vec_id", score.alias("score") if dict(kept.dtypes)["score"] != "bigint" else "score")


def op10_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


OP10_SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda e: floor(256 * CAST(e AS DOUBLE))) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda e: e IS NULL OR NOT isfinite(e))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id
  WHERE q.vec_id % 50 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score
FROM s QUALIFY rank <= 5
"""
