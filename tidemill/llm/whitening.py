"""Whitening of embeddings: pivoted Cholesky of the centred scatter, one-sided Jacobi on its factor.

Three passes over the vectors add up, per task and then by key, what the fit needs: exact
sums; products of centred vectors; and, with the components known, the products of
whitened vectors, which tell how far their covariance is from the identity. The driver
gets d sums and d(d + 1)/2 products whatever the number of rows, factors the d x d scatter
and turns the columns of the factor until they are orthogonal. A fourth pass projects.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm._spark import require, table

SCALE, SHIFT = 64, 1_000_000
#: Scaled entries from which doubles are no longer whole numbers with certainty.
LARGEST = 2.0**52


@dataclass
class Whitening:
    """A fit over n vectors: exact sums, and components by falling eigenvalue."""

    n: int
    sums: list[int]
    values: np.ndarray
    #: Unit eigenvectors, one a column.
    components: np.ndarray
    trace: float
    identity_error: float = 0.0

    @property
    def centre(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean as whole numbers and what is left of it, below one half."""
        whole = [(2 * s + self.n) // (2 * self.n) for s in self.sums]
        return np.array(whole, np.int64), np.array([(s - w * self.n) / self.n for s, w in zip(self.sums, whole, strict=True)])

    @property
    def explained(self) -> np.ndarray:
        return self.values / self.trace if self.trace else self.values


def sound(vectors: DataFrame) -> DataFrame:
    """vec_id, embedding (array of double) of the rows that have a vector.

    Rows go whose vector is null or empty or holds a null or non-finite entry; rows with a
    null vec_id stay.
    """
    require(vectors, ("vec_id", "embedding"))
    ok = F.forall("embedding", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v.cast("double")) < F.lit(float("inf"))))
    rows = vectors.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(F.coalesce(ok, F.lit(False)))
    return rows.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"))


def _whole(batch: pa.RecordBatch, d: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows of a batch and their x = floor(64 c) + 1000000, by dimension."""
    column = batch.column(1)
    offsets = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    lengths = np.diff(offsets)
    for size in np.unique(lengths).tolist():
        rows = np.flatnonzero(lengths == size)
        if d is not None and size != d:
            raise ValueError(f"vectors of {d} and of {size} entries")
        scaled = np.floor(SCALE * flat[offsets[rows][:, None] + np.arange(size)])
        if np.abs(scaled).max(initial=0) >= LARGEST:
            raise ValueError("an entry is too large to be a whole number in 52 bits")
        yield rows, scaled.astype(np.int64) + SHIFT


def _sums(rows: DataFrame) -> tuple[int, list[int]]:
    """n and the exact sum of each dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            for at, x in _whole(batch):
                d = x.shape[1]
                n, have = total.get(d, (0, [0] * d))
                # 2^52 times a batch of rows may need more than 64 bits: halves apart
                high, low = (x >> 26).sum(axis=0).tolist(), (x & ((1 << 26) - 1)).sum(axis=0).tolist()
                total[d] = n + len(at), [a + (h << 26) + b for a, h, b in zip(have, high, low, strict=True)]
        for d, (n, have) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([d] * d, pa.int32()), pa.array(range(d), pa.int32()), pa.array([n] * d, pa.int64()), pa.array([Decimal(s) for s in have], pa.decimal128(38, 0))], names=["d", "j", "n", "s"])

    found = rows.mapInArrow(add, "d int, j int, n long, s decimal(38,0)").groupBy("d", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    # a row a dimension
    got = sorted(found.collect())
    sizes = sorted({r["d"] for r in got})
    if len(sizes) > 1:
        raise ValueError(f"vectors of {' and of '.join(map(str, sizes))} entries")
    return (got[0]["n"], [int(r["s"]) for r in got]) if got else (0, [])


def _products(rows: DataFrame, d: int, project) -> np.ndarray:
    """Sum of products z z' (d x d) and of z (last row) over all rows, where z = project(x)."""
    upper = np.triu_indices(d)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, total, seen = np.zeros((d, d)), np.zeros(d), False
        for batch in batches:
            for _, x in _whole(batch):
                z = project(x)
                gram += z.T @ z
                total += z.sum(axis=0)
                seen = True
        if seen:
            i, j = np.concatenate([upper[0], np.full(d, d)]), np.concatenate([upper[1], np.arange(d)])
            v = np.concatenate([gram[upper], total])
            for a in range(0, len(v), 1 << 16):
                yield pa.RecordBatch.from_arrays([pa.array(x[a : a + (1 << 16)].astype(t)) for x, t in ((i, np.int32), (j, np.int32), (v, np.float64))], names=["i", "j", "v"])

    out = np.zeros((d + 1, d))
    # d(d + 3) / 2 rows
    for r in rows.mapInArrow(add, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        out[r["i"], r["j"]] = r["v"]
        if r["i"] < d:
            out[r["j"], r["i"]] = r["v"]
    return out


def pivoted_cholesky(scatter: np.ndarray, cut: float) -> tuple[np.ndarray, np.ndarray]:
    """order, L with scatter[order][:, order] = L L'; L has a column for each pivot above ``cut``."""
    rest = scatter.astype(float).copy()
    d = len(rest)
    order = np.arange(d)
    factor = np.zeros((d, d))
    for k in range(d):
        best = k + int(np.argmax(np.diag(rest)[k:]))
        if rest[best, best] <= cut:
            return order, factor[:, :k]
        swap = [k, best]
        order[swap] = order[swap[::-1]]
        factor[swap] = factor[swap[::-1]]
        rest[swap] = rest[swap[::-1]]
        rest[:, swap] = rest[:, swap[::-1]]
        factor[k, k] = np.sqrt(rest[k, k])
        factor[k + 1 :, k] = rest[k + 1 :, k] / factor[k, k]
        rest[k + 1 :, k + 1 :] -= np.outer(factor[k + 1 :, k], factor[k + 1 :, k])
    return order, factor


def orthogonal_columns(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The columns of ``factor`` turned in pairs (one-sided Jacobi) until all are orthogonal.

    A round turns disjoint pairs at once; the rounds of a sweep meet every pair once.
    """
    d, r = factor.shape
    g = np.zeros((d, r + r % 2))
    g[:, :r] = factor
    half = g.shape[1] // 2
    ring = np.arange(g.shape[1])
    tiny = np.finfo(float).eps
    for _ in range(sweeps):
        turned = False
        for _ in range(2 * half - 1):
            p, q = ring[:half], ring[half:][::-1]
            a, b = (g[:, p] ** 2).sum(axis=0), (g[:, q] ** 2).sum(axis=0)
            c = (g[:, p] * g[:, q]).sum(axis=0)
            far = np.abs(c) > tiny * np.sqrt(a * b)
            if far.any():
                turned = True
                p, q, a, b, c = p[far], q[far], a[far], b[far], c[far]
                zeta = (b - a) / (2 * c)
                t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
                cos = 1 / np.hypot(1.0, t)
                left, right = g[:, p].copy(), g[:, q].copy()
                g[:, p], g[:, q] = cos * left - cos * t * right, cos * t * left + cos * right
            ring = np.concatenate([ring[:1], ring[-1:], ring[1:-1]])
        if not turned:
            break
    return g[:, :r]


def fit(vectors: DataFrame, components: int = 32) -> Whitening:
    """Means and the leading eigenvectors of the covariance of all vectors that ``sound`` keeps.

    At most ``components``; directions without variance (below 10 d eps of the largest)
    give none. Repeated rows count each, ties among eigenvalues come in any order, an
    empty table gives an empty fit. Vectors of unlike lengths are an error, as is an entry
    of 2^46 or more.
    """
    rows = sound(vectors)
    n, sums = _sums(rows)
    d = len(sums)
    model = Whitening(n, sums, np.empty(0), np.empty((d, 0)), 0.0)
    if not n:
        return model
    whole, part = model.centre
    found = _products(rows, d, lambda x: (x - whole) - part)
    scatter, left = found[:d] / n, found[d] / n
    tiny = 10 * d * np.finfo(float).eps
    order, factor = pivoted_cholesky(scatter, tiny * max(np.diag(scatter).max(initial=0), 0.0))
    turned = orthogonal_columns(factor)
    norms = (turned**2).sum(axis=0)
    top = np.argsort(-norms, kind="stable")
    top = top[norms[top] > tiny * norms.max(initial=0)][:components]
    model.values, model.trace = norms[top], float(np.trace(scatter))
    model.components = np.empty((d, len(top)))
    model.components[order] = turned[:, top] / np.sqrt(norms[top])
    if len(top):
        turn = model.components / np.sqrt(model.values)
        off = left @ turn
        got = _products(rows, len(top), lambda x: ((x - whole) - part) @ turn - off)[: len(top)]
        model.identity_error = float(np.abs(got / n - np.eye(len(top))).max())
    return model


def whiten(vectors: DataFrame, model: Whitening) -> DataFrame:
    """vec_id, deviation (decimal), whitened (array of double) of all rows that ``sound`` keeps.

    ``deviation`` is the sum of (n x - S)^2 over the dimensions, exact; ``whitened`` has an
    entry for each component. Other columns are ignored.
    """
    n, d = model.n, len(model.sums)
    whole, part = model.centre if n else (np.empty(0, np.int64), np.empty(0))
    turn = model.components / np.sqrt(model.values)
    rest = [s - w * n for s, w in zip(model.sums, whole.tolist(), strict=True)]
    square = sum(r * r for r in rest)
    rows = sound(vectors)
    kind = rows.schema["vec_id"].dataType.simpleString()

    def deviations(x: np.ndarray) -> Iterable[int]:
        # (n (x - w) - r)^2 = n^2 (x - w)^2 - 2 n (x - w) r + r^2
        y = x - whole
        most = int(np.abs(y).max(initial=0))
        small = max(most * most, most * max(map(abs, rest), default=0)) * d < 2**63
        y, r = (y, np.array(rest, np.int64)) if small else (y.astype(object), np.array(rest, object))
        return [n * n * int(a) - 2 * n * int(b) + square for a, b in zip((y * y).sum(axis=1), (y * r).sum(axis=1), strict=True)]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, x in _whole(batch, d):
                w = ((x - whole) - part) @ turn
                ids = batch.column(0).take(pa.array(at))
                ends = np.arange(len(at) + 1, dtype=np.int32) * w.shape[1]
                yield pa.RecordBatch.from_arrays([ids, pa.array([Decimal(v) for v in deviations(x)], pa.decimal128(38, 0)), pa.ListArray.from_arrays(pa.array(ends), pa.array(w.ravel()))], names=["vec_id", "deviation", "whitened"])

    return rows.mapInArrow(project, f"vec_id {kind}, deviation decimal(38,0), whitened array<double>")


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    model = fit(vectors)
    rows = whiten(vectors, model).select("vec_id", F.col("deviation").cast("long").alias("deviation"), F.posexplode("whitened").alias("at", "whitened"))
    explained = F.array(*(F.lit(float(v)) for v in model.explained)) if len(model.values) else F.array().cast("array<double>")
    return rows.select("vec_id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "whitened", F.get(explained, F.col("at")).alias("explained"), F.lit(model.identity_error).alias("identity_error"))
