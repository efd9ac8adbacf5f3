"""Positions and rank sums over whole tables, without one task that sees all rows.

Rows are dealt by ranges of the order and written, each with the number of its range. What
stands before a range is a sum over ranges, a few rows; what stands before a row inside
its range is a window over that range.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.functions.special import normal_p
from tidemill.operators import window_statistics
from tidemill.operators.walk_forward import CHANNELS, LEVEL, RELAXED, panel
from tidemill.plans.flow import Flow
from tidemill.plans.scratch import stored


def preceding(df: DataFrame, by: list[str], weight: Column | None = None, within: list[str] | None = None, name: str = "before") -> DataFrame:
    """``df`` with the sum of ``weight`` (1) over the rows that come before in the order ``by`` of the group ``within`` (all rows).

    ``by`` must tell rows apart. Null weights count nothing. Column names with a leading
    underscore followed by ``range`` are taken.
    """
    within = within or []
    rows = df.withColumn("_range_weight", F.coalesce(F.lit(1) if weight is None else weight, F.lit(0)))
    rows = stored(rows.repartitionByRange(*within, *by).withColumn("_range", F.spark_partition_id()), "ranges")
    sums = rows.groupBy("_range", *within).agg(F.sum("_range_weight").alias("_range_sum"))
    # a row a range and group
    earlier = F.sum("_range_sum").over(Window.partitionBy(*within).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))
    starts = sums.select("_range", *within, F.coalesce(earlier, F.lit(0)).alias("_range_start"))
    inside = F.sum("_range_weight").over(Window.partitionBy("_range", *within).orderBy(*by).rowsBetween(Window.unboundedPreceding, -1))
    joined = rows.withColumn("_range_inside", F.coalesce(inside, F.lit(0))).join(starts, ["_range", *within])
    return joined.withColumn(name, F.col("_range_start") + F.col("_range_inside")).select(*df.columns, name)


def rank_sums(rows: DataFrame, feature: str = "feature", value: str = "value", label: str = "label") -> DataFrame:
    """Mann-Whitney's U of each feature: feature, n, n_up, u (of the rows with label 1), ties.

    ``ties`` is the sum of t^3 - t over groups of equal values. Equal values are counted
    before they are dealt, so a value that a third of all rows share is one row. Rows with
    a null value or label are left out.
    """
    counts = rows.where(F.col(value).isNotNull() & F.col(label).isNotNull()).groupBy(feature, value).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col(label).cast("long")).alias("up"))
    placed = preceding(counts, [value], F.col("n"), [feature])
    rank = F.col("before") + (F.col("n") + 1) / 2
    n = F.col("n").cast("double")
    return placed.groupBy(feature).agg(F.sum("n").alias("n"), F.sum("up").alias("n_up"), F.sum(F.col("up") * rank).alias("_ranks"), F.sum(n * n * n - n).alias("ties")).select(feature, "n", "n_up", (F.col("_ranks") - F.col("n_up") * (F.col("n_up") + 1) / 2).alias("u"), "ties")


def relevance(rows: DataFrame, level: float = LEVEL, relaxed: float = RELAXED) -> DataFrame:
    """feature, n, n_up, u, p, selected: two-sided p with corrections for ties and continuity, and Benjamini-Hochberg's step-up.

    With nothing selected at ``level`` the ``relaxed`` level holds. A constant feature, or
    a label without both values, has no p and is not selected.
    """
    return _tested(rank_sums(rows), level, relaxed)


def _tested(tests: DataFrame, level: float = LEVEL, relaxed: float = RELAXED) -> DataFrame:
    """The same from the rank sums."""
    n, up = F.col("n").cast("double"), F.col("n_up").cast("double")
    variance = F.when(n > 1, up * (n - up) / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = F.when(variance > 1e-9, F.greatest(F.abs(F.col("u") - up * (n - up) / 2) - 0.5, F.lit(0.0)) / F.sqrt(variance))
    tests = stored(tests.withColumn("p", normal_p(z)), "relevance")
    # from here on a row a feature
    up_to = Window.orderBy(F.col("p").asc_nulls_last(), "feature")
    steps = tests.withColumn("i", F.row_number().over(up_to)).withColumn("m", F.count("p").over(Window.partitionBy()))
    last = lambda q: F.coalesce(F.max(F.when(F.col("p") <= q * F.col("i") / F.col("m"), F.col("i"))).over(Window.partitionBy()), F.lit(0))
    steps = steps.withColumn("strict", last(level)).withColumn("loose", last(relaxed))
    return steps.select("feature", "n", "n_up", "u", "p", (F.col("p").isNotNull() & (F.col("i") <= F.when(F.col("strict") > 0, F.col("strict")).otherwise(F.col("loose")))).alias("selected"))


#: Rows that a task packs at once, rows of a feature that a range holds about, and codes from which the ranges' limits are read.
PACK, RANGE, LOOKED_AT = 1 << 17, 1 << 20, 200
_PIECE = "feature int, part int, value binary, n binary, up binary"
_RANGE_SUMS = "feature int, part int, n long, up long, inside double, ties double"


def _counted(value: np.ndarray, n: np.ndarray, up: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct values in order, with the sums of n and up."""
    order = np.argsort(value)
    value, n, up = value[order], n[order], up[order]
    at = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])[: len(value)]
    return (value[at], np.add.reduceat(n, at), np.add.reduceat(up, at)) if len(value) else (value, n, up)


def _packed(names: list[str], channels: tuple[str, ...], limits: dict[int, np.ndarray]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Columns of many rows (channel, label and ``names``) as pieces of the order of each feature, equal values counted, cut at its ``limits``."""

    def pieces(rows: pa.Table) -> pa.RecordBatch:
        label, out = rows["label"].to_numpy().astype(np.int64), []
        of = [np.array(rows["channel"].to_pylist(), object) == c for c in channels]
        for j, name in enumerate(names):
            x = rows[name].to_numpy().astype(float)
            for i, mine in enumerate(of):
                feature, mine = i * len(names) + j, mine & ~np.isnan(x)
                value, n, up = _counted(x[mine], np.ones(mine.sum(), np.int64), label[mine])
                at = [0, *np.searchsorted(value, limits.get(feature, []), side="left"), len(value)]
                out += [(feature, k, value[a:z].tobytes(), n[a:z].astype(np.uint32).tobytes(), up[a:z].astype(np.uint32).tobytes()) for k, (a, z) in enumerate(pairwise(at)) if z > a]
        types = (pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
        return pa.record_batch([pa.array([r[k] for r in out], t) for k, t in enumerate(types)], ["feature", "part", "value", "n", "up"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) >= PACK:
                yield pieces(pa.Table.from_batches(held))
                held = []
        if held:
            yield pieces(pa.Table.from_batches(held))

    return pack


def _range_sums(pieces: pa.Table) -> pa.Table:
    """Of one range of one feature: rows, rows with label 1, their ranks inside the range, ties."""
    read = lambda name, kind: np.frombuffer(b"".join(pieces[name].to_pylist()), kind)
    _, n, up = _counted(read("value", np.float64), read("n", np.uint32).astype(np.int64), read("up", np.uint32).astype(np.int64))
    rank, size = np.cumsum(n) - n + (n + 1) / 2, n.astype(float)
    found = {"feature": pieces["feature"][0].as_py(), "part": pieces["part"][0].as_py(), "n": int(n.sum()), "up": int(up.sum()), "inside": float((up * rank).sum()), "ties": float((size**3 - size).sum())}
    types = (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
    return pa.table({k: pa.array([v], t) for (k, v), t in zip(found.items(), types, strict=True)})


def packed_rank_sums(rows: DataFrame, names: list[str], channels: tuple[str, ...], limits: dict[int, np.ndarray]) -> DataFrame:
    """``rank_sums`` of wide rows (channel, label, a column a name): feature is the channel and the name.

    Values are sorted and counted in packs, which are dealt by feature and range of values.
    The limits of ranges, which equal values never straddle, decide only who does what.
    """
    sums = rows.where("label IS NOT NULL").mapInArrow(_packed(names, channels, limits), _PIECE).groupBy("feature", "part").applyInArrow(_range_sums, _RANGE_SUMS)
    # from here on a row a range
    before = F.coalesce(F.sum("n").over(Window.partitionBy("feature").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = sums.withColumn("ranks", F.col("inside") + F.col("up") * before)
    found = placed.groupBy("feature").agg(F.sum("n").alias("n"), F.sum("up").alias("n_up"), F.sum("ranks").alias("_ranks"), F.sum("ties").alias("ties"))
    labels = F.array(*(F.lit(f"{c}__{n}") for c in channels for n in names))
    return found.select(F.element_at(labels, F.col("feature") + 1).alias("feature"), "n", "n_up", (F.col("_ranks") - F.col("n_up") * (F.col("n_up") + 1) / 2).alias("u"), "ties")


def range_limits(rows: DataFrame, names: list[str], channels: tuple[str, ...], parts: int) -> dict[int, np.ndarray]:
    """Values between ``parts`` ranges of each feature about as large as one another, as these rows have them."""
    if parts < 2:
        return {}
    shares = [k / parts for k in range(1, parts)]
    found = rows.where("label IS NOT NULL").groupBy("channel").agg(*(F.percentile_approx(n, shares, 1000).alias(n) for n in names)).collect()
    return {channels.index(r["channel"]) * len(names) + j: np.unique(np.array(r[n], float)) for r in found for j, n in enumerate(names) if r[n]}


def _relevance_query(flow: Flow) -> Callable[[SparkSession, str], DataFrame]:
    wide, codes = panel(flow, CHANNELS), flow.run("SELECT l_suppkey AS code, count(*) AS n FROM {lineitem} GROUP BY l_suppkey")
    schema, names = window_statistics.SCHEMA.replace("channel", "label int, channel", 1), list(window_statistics.NAMES)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = wide(spark, sf_dir)
        known = lambda found: found.groupBy("code").applyInArrow(lambda x: window_statistics.windows_of(x, ("label",)), schema).where("ts IS NOT NULL")
        # a line is half a bar at least
        n_codes, n_lines = codes(spark, sf_dir).agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
        looked_at = rows.where(F.pmod(F.xxhash64("code"), F.lit(max(1, n_codes // LOOKED_AT))) == 0)
        limits = range_limits(known(looked_at), names, CHANNELS, -(-n_lines // RANGE))
        found = _tested(packed_rank_sums(known(rows).drop("code", "ts"), names, CHANNELS, limits))
        return found.select("feature", "n", "n_up", F.round("u", 1).alias("u"), F.round("p", 6).alias("p"), "selected")

    return query


_RELEVANCE_SQL = f"""
    facts AS (SELECT channel || '__' || statistic AS feature, value, label FROM (SELECT s.*, CASE WHEN a.fwd > 0 THEN 1 ELSE 0 END AS label FROM rounded s JOIN ahead a USING (code, ts) WHERE a.fwd IS NOT NULL) UNPIVOT (value FOR statistic IN ({", ".join(window_statistics.NAMES)}))),
    placed AS (SELECT feature, label, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2 AS r, count(*) OVER (PARTITION BY feature, value) AS t FROM facts),
    summed AS (SELECT feature, count(*) AS n, sum(label)::BIGINT AS n_up, sum(r) FILTER (WHERE label = 1) - sum(label) * (sum(label) + 1) / 2 AS u, sum(t::DOUBLE * t - 1) AS ties FROM placed GROUP BY feature),
    scored AS (SELECT *, greatest(abs(u - n_up::DOUBLE * (n - n_up) / 2) - 0.5, 0) / sqrt(nullif(greatest(n_up::DOUBLE * (n - n_up) / 12 * (n + 1 - ties / (n::DOUBLE * (n - 1))), 1e-9), 1e-9)) / sqrt(2) AS x FROM summed),
    tested AS (SELECT feature, n, n_up, u, CASE WHEN x IS NULL THEN NULL WHEN x = 0 THEN 1 WHEN x > 6 THEN 0 ELSE 1 - 2 / sqrt(pi()) * list_sum([exp(-x * x + 2 * j * ln(2) + (2 * j + 1) * ln(x) - lgamma(2 * j + 2) + lgamma(j + 1)) FOR j IN range(200)]) END AS p FROM scored),
    stepped AS (SELECT *, row_number() OVER (ORDER BY p NULLS LAST, feature) AS i, (SELECT count(p) FROM tested) AS m FROM tested),
    cut AS (SELECT coalesce(max(i) FILTER (WHERE p <= {LEVEL} * i / m), 0) AS strict, coalesce(max(i) FILTER (WHERE p <= {RELAXED} * i / m), 0) AS loose FROM stepped)
    SELECT feature, n, n_up, round(u, 1) AS u, round(CASE WHEN p < 0 THEN 0 ELSE p END, 6) + 0 AS p, p IS NOT NULL AND i <= CASE WHEN strict > 0 THEN strict ELSE loose END AS selected FROM stepped, cut"""


def _proxy_query(flow: Flow, clusters: int = 20) -> Callable[[SparkSession, str], DataFrame]:
    """Clusters of equal size by the order of (mean return of the code, code, date) over all rows."""
    means = flow.run("SELECT code, mean_ret, n FROM code_means WHERE mean_ret IS NOT NULL")
    rows = flow.run("SELECT code, ts, row_number() OVER (PARTITION BY code ORDER BY ts) AS nth FROM bars")

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        codes = preceding(means(spark, sf_dir), ["mean_ret", "code"], F.col("n")).select("code", "before", "n")
        total = codes.agg(F.sum("n").alias("total"))  # one row
        placed = rows(spark, sf_dir).join(codes.drop("n"), "code").crossJoin(F.broadcast(total))
        return placed.select("code", "ts", F.greatest(F.ceil((F.col("before") + F.col("nth") - 1) / (F.col("total") - 1.0) * clusters - 1e-9), F.lit(1)).cast("int").alias("proxy"))

    return query


def _chunks_query(flow: Flow, size: int = 25) -> Callable[[SparkSession, str], DataFrame]:
    codes = flow.run("SELECT code FROM master")
    return lambda spark, sf_dir: preceding(codes(spark, sf_dir), ["code"]).select("code", F.floor(F.col("before") / size).cast("int").alias("chunk"))


def registered(flow: Flow) -> tuple[dict[str, Callable], dict[str, str]]:
    flow.oracles["feature_relevance"] = " ".join(f"WITH {window_statistics.duckdb_tables()}, rounded AS (SELECT * FROM ({flow.oracles['window_statistics'][flow.oracles['window_statistics'].rindex(' SELECT code, ts, channel, '):]})), {_RELEVANCE_SQL} ".split())
    sql = {"feature_relevance": _with_ahead(flow), "industry_proxy": flow.oracle("industry_proxy"), "fetch_chunks": flow.duckdb(flow.queries["fetch_chunks"])}
    return {"feature_relevance": _relevance_query(flow), "industry_proxy": _proxy_query(flow), "fetch_chunks": _chunks_query(flow)}, sql


def _with_ahead(flow: Flow) -> str:
    """The oracle's own text after the shared tables, the step ``ahead`` among them."""
    head = flow.duckdb("SELECT 1 AS x FROM channel_values JOIN ahead")
    own = flow.oracles["feature_relevance"].removeprefix("WITH ")
    return f"{head[: head.rindex('SELECT 1 AS x')].rstrip()}, {own}"
