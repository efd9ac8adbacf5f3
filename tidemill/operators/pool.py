"""A pool of factors: gate, de-correlation, combination; formula search in rounds on residuals."""

from __future__ import annotations

import json
import random
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.functions.exprs import average_rank, correlation
from tidemill.operators import learning
from tidemill.plans.flow import Flow
from tidemill.plans.scratch import scratch
from tidemill.sources.store import Config

CONFIG = Config()
#: Last day of the rows that a factor is chosen on; later ones test it.
SPLIT = "1997-12-31"
NAMES = ("momentum", "size", "rho", "distance")


def add(flow: Flow) -> None:
    flow.step(
        pool_daily=f"SELECT factor, ts, ic, ts > date '{SPLIT}' AS late FROM tested_daily WHERE h = 5 AND ic IS NOT NULL",
        pool_rows=f"SELECT code, ts, f AS momentum, ln(1 + size) AS size, rho, distance FROM (SELECT f.code, f.ts, f.f, f.size, e.rho, e.distance FROM factors f JOIN eigen e ON e.code = f.code) x WHERE f IS NOT NULL",
        pool_measured="""SELECT factor, avg(CASE WHEN NOT late THEN ic END) AS train_ic, avg(CASE WHEN NOT late THEN ic END) / nullif(stddev_samp(CASE WHEN NOT late THEN ic END), 0) AS train_icir, avg(CASE WHEN late THEN ic END) AS test_ic, avg(CASE WHEN late THEN ic END) / nullif(stddev_samp(CASE WHEN late THEN ic END), 0) AS test_icir FROM pool_daily GROUP BY factor""",
        pool_months="SELECT code, cast(date_trunc('month', ts) AS date) AS month, " + ", ".join(f"avg({n}) AS {n}" for n in NAMES) + " FROM pool_rows GROUP BY code, cast(date_trunc('month', ts) AS date)",
        pool_long="SELECT code, ts, factor, round(value, 9) AS value FROM (SELECT code, ts, stack(4, " + ", ".join(f"'{n}', {n}" for n in NAMES) + ") AS (factor, value) FROM pool_rows) x WHERE value IS NOT NULL",
        # mean daily position by month; a month and the one before over the codes of both
        pool_positions="SELECT factor, code, month, avg(nth) AS r FROM (SELECT factor, code, cast(date_trunc('month', ts) AS date) AS month, row_number() OVER (PARTITION BY factor, ts ORDER BY value, code) AS nth FROM pool_long) x GROUP BY factor, code, month",
        pool_turnover=f"""SELECT factor, avg(turnover) AS turnover FROM (SELECT factor, month, 1 - {correlation('a', 'b')} AS turnover FROM (SELECT factor, month, {average_rank('r', 'factor, month')} AS a, {average_rank('p', 'factor, month')} AS b FROM (
            SELECT n.factor, n.month, n.r, o.r AS p FROM pool_positions n JOIN month_order m ON n.month = m.month JOIN pool_positions o ON o.month = m.before AND o.factor = n.factor AND o.code = n.code) x) y GROUP BY factor, month HAVING count(*) >= 30) z GROUP BY factor""",
        pool_month_ranks="SELECT month, " + ", ".join(f"{average_rank(f'round({n}, 9)', 'month')} AS {n}" for n in NAMES) + " FROM pool_months",
        pool_pairs=" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, month, count(*) AS n, {correlation(a, b)} AS rho FROM pool_month_ranks GROUP BY month HAVING count(*) >= 8" for i, a in enumerate(NAMES) for b in NAMES[i + 1 :]),
        pool_weights="SELECT " + ", ".join(f"CASE WHEN coalesce(sum(test_ic), 0) = 0 THEN 0.25e0 ELSE sum(CASE WHEN factor = '{n}' THEN test_ic END) / sum(test_ic) END AS w_{n}" for n in NAMES) + " FROM pool_measured WHERE factor IN ('momentum', 'size', 'rho', 'distance')",
        pool_z="SELECT code, ts, " + ", ".join(f"({n} - avg({n}) OVER (PARTITION BY ts)) / (coalesce(stddev_samp({n}) OVER (PARTITION BY ts), 0) + 1e-9) AS {n}" for n in NAMES) + " FROM pool_rows",
        pool_runs="SELECT CASE WHEN ts > date '1999-12-31' THEN 'run_2' ELSE 'run_1' END AS run, factor, count(*) AS n, avg(ic) AS ic FROM (SELECT factor, ts, ic FROM pool_daily) x GROUP BY CASE WHEN ts > date '1999-12-31' THEN 'run_2' ELSE 'run_1' END, factor",
    )
    gate = f"train_icir >= {CONFIG.icir_train} AND abs(test_ic) >= {CONFIG.ic_gate} AND test_icir >= {CONFIG.icir_test} AND coalesce(turnover <= {CONFIG.turnover_most}, true)"
    total = " + ".join(f"w_{n} * coalesce({n}, 0)" for n in NAMES)
    flow.pair(
        factor_pool_gate=(
            f"SELECT m.factor, round(train_ic, 7) AS train_ic, round(train_icir, 6) AS train_icir, round(test_ic, 7) AS test_ic, round(test_icir, 6) AS test_icir, round(turnover, 6) AS turnover, coalesce({gate}, false) AS passes FROM pool_measured m LEFT JOIN pool_turnover t ON t.factor = m.factor",
            f"""WITH t AS (SELECT factor, avg(ic) FILTER (WHERE NOT late) AS a, stddev_samp(ic) FILTER (WHERE NOT late) AS sa, avg(ic) FILTER (WHERE late) AS b, stddev_samp(ic) FILTER (WHERE late) AS sb FROM pool_daily GROUP BY ALL),
                u AS (UNPIVOT (SELECT code, ts, round(momentum, 9) AS momentum, round(size, 9) AS size, round(rho, 9) AS rho, round(distance, 9) AS distance FROM pool_rows) ON momentum, size, rho, distance INTO NAME factor VALUE v),
                p AS (SELECT factor, code, date_trunc('month', ts) AS month, avg(k) AS r FROM (SELECT *, row_number() OVER (PARTITION BY factor, ts ORDER BY v, code) AS k FROM u) GROUP BY ALL),
                c AS (SELECT n.factor, n.month, n.code, n.r, o.r AS q FROM p n ASOF JOIN (SELECT DISTINCT date_trunc('month', ts) AS before FROM pool_rows) k ON n.month > k.before JOIN p o ON o.month = k.before AND o.code = n.code AND o.factor = n.factor),
                w AS (SELECT factor, month, 1 - corr(x, y) AS turnover FROM (SELECT factor, month, rank() OVER (PARTITION BY factor, month ORDER BY r) + (count(*) OVER (PARTITION BY factor, month, r) - 1) / 2 AS x, rank() OVER (PARTITION BY factor, month ORDER BY q) + (count(*) OVER (PARTITION BY factor, month, q) - 1) / 2 AS y FROM c) GROUP BY ALL HAVING count(*) >= 30)
              SELECT factor, round(a, 7) AS train_ic, round(a / nullif(sa, 0), 6) AS train_icir, round(b, 7) AS test_ic, round(b / nullif(sb, 0), 6) AS test_icir, round(turnover, 6) AS turnover, coalesce(a / nullif(sa, 0) >= {CONFIG.icir_train} AND abs(b) >= {CONFIG.ic_gate} AND b / nullif(sb, 0) >= {CONFIG.icir_test} AND NOT coalesce(turnover > {CONFIG.turnover_most}, false), false) AS passes
              FROM t LEFT JOIN (SELECT factor, avg(turnover) AS turnover FROM w GROUP BY factor) USING (factor)""",
        ),
        factor_pool_correlations=(
            "SELECT a, b, count(rho) AS n_months, round(avg(rho), 6) AS rho FROM pool_pairs GROUP BY a, b",
            "WITH u AS (UNPIVOT (SELECT * FROM pool_months) ON momentum, size, rho, distance INTO NAME factor VALUE v), r AS (SELECT *, rank() OVER (PARTITION BY factor, month ORDER BY round(v, 9)) + (count(*) OVER (PARTITION BY factor, month, round(v, 9)) - 1) / 2 AS k FROM u), "
            + "c AS (SELECT x.factor AS a, y.factor AS b, x.month, corr(x.k, y.k) AS rho FROM r x JOIN r y USING (month, code) WHERE list_position(['momentum', 'size', 'rho', 'distance'], x.factor) < list_position(['momentum', 'size', 'rho', 'distance'], y.factor) GROUP BY ALL HAVING count(*) >= 8) SELECT a, b, count(rho) AS n_months, round(avg(rho), 6) AS rho FROM c WHERE NOT isnan(rho) GROUP BY ALL",
        ),
        composite_ic_weighted=(
            f"SELECT code, ts, round({total}, 6) AS composite FROM pool_rows CROSS JOIN pool_weights",
            "WITH w AS (SELECT CASE WHEN coalesce(sum(test_ic), 0) = 0 THEN map_from_entries(list((factor, 1))) ELSE map_from_entries(list((factor, test_ic))) END AS m, CASE WHEN coalesce(sum(test_ic), 0) = 0 THEN 4 ELSE sum(test_ic) END AS s FROM pool_measured) SELECT code, ts, round((" + " + ".join(f"m['{n}'] * coalesce({n}, 0)" for n in NAMES) + ") / nullif(s, 0), 6) AS composite FROM pool_rows, w",
        ),
        composite_equal=(
            "SELECT code, ts, round((" + " + ".join(f"coalesce({n}, 0)" for n in NAMES) + ") / nullif(" + " + ".join(f"CASE WHEN {n} IS NULL THEN 0 ELSE 1 END" for n in NAMES) + ", 0), 6) AS composite FROM pool_rows",
            f"SELECT code, ts, round(list_avg([{', '.join(NAMES)}]), 6) AS composite FROM pool_rows",
        ),
        composite_zscore=(
            "SELECT code, ts, round((" + " + ".join(f"coalesce({n}, 0)" for n in NAMES) + ") / nullif(" + " + ".join(f"CASE WHEN {n} IS NULL THEN 0 ELSE 1 END" for n in NAMES) + ", 0), 5) + 0e0 AS composite FROM pool_z",
            "WITH s AS (SELECT ts, " + ", ".join(f"avg({n}) AS m_{n}, coalesce(stddev_samp({n}), 0) + 1e-9 AS s_{n}" for n in NAMES) + " FROM pool_rows GROUP BY ts) SELECT code, ts, round(list_avg([" + ", ".join(f"({n} - m_{n}) / s_{n}" for n in NAMES) + "]), 5) + 0 AS composite FROM pool_rows JOIN s USING (ts)",
        ),
        pool_panel=(
            "SELECT p.code, p.ts, round(p.momentum, 8) AS momentum, round(d.drawdown, 8) AS drawdown, round(v.v_ratio, 8) AS v_ratio, round(f.y5, 8) AS label FROM pool_rows p JOIN forward f ON f.code = p.code AND f.ts = p.ts LEFT JOIN (SELECT code, ts, close / max(close) OVER (PARTITION BY code ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS drawdown FROM bars WHERE volume > 30) d ON d.code = p.code AND d.ts = p.ts"
            + " LEFT JOIN (SELECT code, ts, volume / nullif(avg(volume) OVER (PARTITION BY code ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0) AS v_ratio FROM bars WHERE volume < 80) v ON v.code = p.code AND v.ts = p.ts",
            """WITH b AS (SELECT code, ts, 'd' AS k, close / max(close) OVER (PARTITION BY code ORDER BY ts ROWS UNBOUNDED PRECEDING) - 1 AS v FROM bars WHERE volume > 30 UNION ALL SELECT code, ts, 'v', volume / nullif(avg(volume) OVER (PARTITION BY code ORDER BY ts ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0) FROM bars WHERE volume < 80),
                w AS (SELECT code, ts, any_value(v) FILTER (WHERE k = 'd') AS d, any_value(v) FILTER (WHERE k = 'v') AS v FROM b GROUP BY ALL) SELECT code, ts, round(p.momentum, 8) AS momentum, round(w.d, 8) AS drawdown, round(w.v, 8) AS v_ratio, round(f.y5, 8) AS label FROM pool_rows p JOIN forward f USING (code, ts) LEFT JOIN w USING (code, ts)""",
        ),
        pool_append=(
            "SELECT run, factor, n, round(ic, 7) AS ic FROM (SELECT o.run, o.factor, o.n, o.ic FROM pool_runs o LEFT ANTI JOIN (SELECT DISTINCT run FROM pool_runs WHERE run = 'run_2') r ON r.run = o.run UNION ALL SELECT run, factor, n + 1, ic FROM pool_runs WHERE run = 'run_2') x",
            "SELECT run, factor, n + (run = 'run_2')::INT AS n, round(ic, 7) AS ic FROM pool_runs",
        ),
        terminal_selection=(
            "SELECT column_name, n_known, n_known > 100 AS kept FROM (SELECT stack(4, 'cs_momentum', count(momentum), 'cs_size', count(size), 'cs_rho', count(rho), 'cs_none', count(nothing)) AS (column_name, n_known) FROM (SELECT p.momentum, p.size, p.rho, cast(NULL AS double) AS nothing FROM pool_rows p JOIN forward f ON f.code = p.code AND f.ts = p.ts WHERE f.y5 IS NOT NULL AND coalesce(p.momentum, p.size, p.rho) IS NOT NULL) x) y",
            "WITH x AS (SELECT p.* FROM pool_rows p JOIN forward f USING (code, ts) WHERE f.y5 IS NOT NULL AND NOT (p.momentum IS NULL AND p.size IS NULL AND p.rho IS NULL)) SELECT 'cs_momentum' AS column_name, count(momentum) AS n_known, count(momentum) > 100 AS kept FROM x UNION ALL SELECT 'cs_size', count(size), count(size) > 100 FROM x UNION ALL SELECT 'cs_rho', count(rho), count(rho) > 100 FROM x UNION ALL SELECT 'cs_none', 0, false",
        ),
        train_test_windows=(
            f"SELECT CASE WHEN ts <= date '{SPLIT}' THEN 'train' ELSE 'test' END AS part, count(*) AS n, count(DISTINCT ts) AS n_dates, min(ts) AS first_ts, max(ts) AS last_ts FROM pool_rows GROUP BY CASE WHEN ts <= date '{SPLIT}' THEN 'train' ELSE 'test' END",
            f"SELECT if(ts > DATE '{SPLIT}', 'test', 'train') AS part, count(*) AS n, count(DISTINCT ts) AS n_dates, min(ts) AS first_ts, max(ts) AS last_ts FROM pool_rows GROUP BY ALL",
        ),
        seeded_sample=(
            "SELECT code, ts FROM pool_keys WHERE (SELECT count(*) FROM pool_keys) <= 50000 OR (code * 7919 + datediff(ts, date '1970-01-01') * 104729 + 42) % 1000 < 300",
            "SELECT code, ts FROM pool_keys WHERE (SELECT count(*) FROM pool_keys) <= 50000 OR (code * 7919 + date_diff('day', DATE '1970-01-01', ts) * 104729 + 42) % 1000 < 300",
        ),
    )
    flow.step(pool_keys="SELECT code, ts FROM pool_rows")


def factor_pool(flow: Flow, most: float = CONFIG.correlation_most) -> Callable[[SparkSession, str], DataFrame]:
    """Factors by the size of their test IC, each kept unless its mean monthly correlation with a kept one is above ``most``.

    All correlations come from one job; the loop is over the factors' names.
    """
    pairs = flow.run("SELECT a, b, avg(rho) AS rho FROM pool_pairs GROUP BY a, b")
    measured = flow.run("SELECT factor, coalesce(abs(test_ic), 0) AS ic FROM pool_measured")

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rho = {frozenset((r["a"], r["b"])): abs(r["rho"] or 0.0) for r in pairs(spark, sf_dir).collect()}
        kept, out = [], []
        for r in sorted(measured(spark, sf_dir).collect(), key=lambda r: (-r["ic"], r["factor"])):
            near = max(((rho.get(frozenset((r["factor"], k)), 0.0), k) for k in kept), default=(0.0, None))
            ok = near[0] <= most
            kept += [r["factor"]] * ok
            out.append((r["factor"], float(r["ic"]), float(near[0]), near[1], ok))
        return spark.createDataFrame(out, "factor string, ic double, most_alike double, alike_to string, kept boolean")

    return query


# Formula search. Formulas are scored on a bounded sample, each task some of them; the best ones on all rows.

ARRAYS: dict[str, Callable[..., np.ndarray]] = {
    "add": np.add, "sub": np.subtract, "mul": np.multiply, "maximum": np.maximum, "minimum": np.minimum, "sign": np.sign, "neg": np.negative, "abs": np.abs,
    "div": lambda a, b: np.where(np.abs(b) > 1e-6, a / np.where(np.abs(b) > 1e-6, b, 1.0), 1.0), "log": lambda a: np.log(np.abs(a) + 1e-6), "root": lambda a: np.sqrt(np.abs(a)),
}


def evaluate(tree: learning.Tree, columns: dict[str, np.ndarray]) -> np.ndarray:
    return columns[tree] if isinstance(tree, str) else ARRAYS[tree[0]](*(evaluate(t, columns) for t in tree[1:]))


def ranks(x: np.ndarray) -> np.ndarray:
    """Average ranks."""
    _, inverse, counts = np.unique(x, return_inverse=True, return_counts=True)
    return (np.cumsum(counts) - (counts - 1) / 2)[inverse]


def spearman(x: np.ndarray, y_ranks: np.ndarray) -> float:
    if not np.isfinite(x).all():
        return 0.0
    r = ranks(x)
    spread = r.std() * y_ranks.std()
    return float(abs(((r - r.mean()) * (y_ranks - y_ranks.mean())).mean() / spread)) if spread > 0 else 0.0


def _tuples(x):
    return tuple(_tuples(i) for i in x) if isinstance(x, list) else x


def scored(spark: SparkSession, sample, trees: list[learning.Tree], tasks: int) -> list[float]:
    """|Spearman| of each formula with the target over the broadcast sample; tasks share the formulas."""

    def run(batches):
        columns, y = sample.value
        for frame in batches:
            with np.errstate(all="ignore"):
                yield pd.DataFrame({"i": frame.i, "fitness": [spearman(evaluate(_tuples(json.loads(t)), columns), y) for t in frame.tree]})

    rows = spark.createDataFrame([(i, json.dumps(t)) for i, t in enumerate(trees)], "i int, tree string").repartition(tasks)
    found = {r["i"]: r["fitness"] for r in rows.mapInPandas(run, "i int, fitness double").collect()}
    return [found[i] for i in range(len(trees))]


def evolve(spark: SparkSession, rows: DataFrame, target: str, names: tuple[str, ...], population: int, generations: int, seed: int, sample_rows: int = CONFIG.sample_rows) -> list[tuple[float, learning.Tree]]:
    """The formulas found, best first. At most some ``sample_rows`` rows, chosen by hash, are scored on."""
    rng = random.Random(seed)
    n = rows.count()
    picked = rows if n <= sample_rows else rows.where(F.pmod(F.xxhash64("code", "ts", F.lit(seed)), F.lit(n)) < sample_rows)
    frame = picked.select(target, *names).toPandas()  # bounded by sample_rows
    with np.errstate(all="ignore"):
        sample = spark.sparkContext.broadcast(({c: frame[c].to_numpy(float) for c in names}, ranks(frame[target].to_numpy(float))))
    tasks = spark.sparkContext.defaultParallelism
    known: dict[learning.Tree, float] = {}
    trees = [*names, *(learning.grow(rng, names, rng.randint(1, 3)) for _ in range(population - len(names)))]
    for _ in range(generations):
        fresh = [t for t in dict.fromkeys(trees) if t not in known]
        known |= dict(zip(fresh, scored(spark, sample, fresh, tasks), strict=True)) if fresh else {}
        by_fitness = sorted(set(trees), key=lambda t: (-known[t], len(str(t)), str(t)))
        draw = lambda: min(rng.randrange(len(by_fitness)) for _ in range(20))  # noqa: E731  tournament
        trees = [*by_fitness[: max(1, population // 50)], *(learning.mutate(rng, by_fitness[draw()], by_fitness[draw()], names) for _ in range(population - max(1, population // 50)))]
        trees = [t if _depth(t) <= 6 else rng.choice(names) for t in trees]
    sample.unpersist()
    return sorted(((v, t) for t, v in known.items()), key=lambda x: (-x[0], len(str(x[1])), str(x[1])))


def _depth(tree: learning.Tree) -> int:
    return 0 if isinstance(tree, str) else 1 + max(_depth(t) for t in tree[1:])


def _panel(flow: Flow) -> Callable[[SparkSession, str], DataFrame]:
    rows = learning.feature_panel(flow)
    return lambda spark, sf_dir: rows(spark, sf_dir).where("fwd IS NOT NULL").select("code", "ts", "fwd", *learning.FEATURES)


def formula_search(flow: Flow, population: int = CONFIG.population, generations: int = CONFIG.generations, top: int = 10, seed: int = CONFIG.seed) -> Callable[[SparkSession, str], DataFrame]:
    """The best formulas of a search, with the mean daily rank correlation over all rows."""
    panel = _panel(flow)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = panel(spark, sf_dir)
        best = evolve(spark, rows, "fwd", learning.FEATURES, population, generations, seed)[:top]
        daily = learning.fitness(rows, [t for _, t in best], "fwd")
        out = [(i + 1, learning.to_sql(t), json.dumps(t), float(v), float(d)) for i, ((v, t), d) in enumerate(zip(best, daily, strict=True))]
        return spark.createDataFrame(out, "rank int, formula string, program string, fitness double, daily_ic double")

    return query


def formula_rounds(flow: Flow, rounds: int = 3, population: int = 200, generations: int = 5, least: float = 0.01, seed: int = CONFIG.seed) -> Callable[[SparkSession, str], DataFrame]:
    """Search in rounds, each on what the formulas before leave unexplained, until a round adds too little.

    A round's run is saved: formulas with the configuration as JSON, factor values as
    Parquet; the rows of the last table are read back from there.
    """
    panel = _panel(flow)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = panel(spark, sf_dir).withColumn("target", F.col("fwd"))
        folder, out = scratch(spark, "formula-run"), []
        for k in range(rounds):
            v, tree = evolve(spark, rows, "target", learning.FEATURES, population, generations, seed + k)[0]
            value = F.expr(learning.to_sql(tree)).cast("double")
            made = rows.withColumn("factor", F.when(F.abs(value) < 1e12, value))
            stats = made.agg(F.avg("factor").alias("m"), F.avg("target").alias("t"), F.covar_pop("factor", "target").alias("c"), F.var_pop("factor").alias("v")).first()
            daily = learning.fitness(made, ["factor"], "fwd")[0]
            out.append((k + 1, learning.to_sql(tree), float(v), float(daily)))
            spark.createDataFrame([(k + 1, json.dumps(tree), json.dumps({"population": population, "generations": generations, "seed": seed + k}))], "round int, program string, config string").coalesce(1).write.json(f"{folder}/formulas-{k}")
            if v < least or not stats["v"]:
                break
            made = made.withColumn("target", F.col("target") - F.lit(stats["t"]) - F.lit(stats["c"] / stats["v"]) * (F.coalesce("factor", F.lit(stats["m"])) - F.lit(stats["m"])))
            # the round's values are the next one's input
            made.write.parquet(f"{folder}/values-{k}")
            rows = spark.read.schema(made.schema).parquet(f"{folder}/values-{k}").drop("factor")
        return spark.createDataFrame(out, "round int, formula string, fitness double, daily_ic double")

    return query


def registered(flow: Flow) -> tuple[dict[str, Callable], dict[str, str]]:
    return {f.__name__: f(flow) for f in (factor_pool, formula_search, formula_rounds)}, {}
