"""Model-based operators: significance, selection of features, classifiers, formula search."""

from __future__ import annotations

import random
from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.functions.exprs import ROWS, average_rank, correlation
from tidemill.functions.special import two_sided_p
from tidemill.plans.flow import Flow
from tidemill.plans.scratch import stored

FEATURES = ("ret_1", "ret_5", "ma_gap", "vol_ratio", "range", "sd_20")
_FEATURES_SQL = f"""SELECT code, ts, ret_1, ret_5, ma_gap, vol_ratio, range_, sd_20, CASE WHEN fwd IS NULL THEN NULL WHEN fwd > 0 THEN 1e0 ELSE 0e0 END AS label, fwd, n, total FROM (
    SELECT code, ts, close / nullif(lag(close) OVER ({ROWS}), 0) - 1 AS ret_1, close / nullif(lag(close, 5) OVER ({ROWS}), 0) - 1 AS ret_5,
      close / nullif(ma_20, 0) - 1 AS ma_gap, volume / nullif(avg(volume) OVER ({ROWS} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW), 0) AS vol_ratio, (high - low) / nullif(close, 0) AS range_, std_20 / nullif(ma_20, 0) AS sd_20,
      lead(close, 5) OVER ({ROWS}) / nullif(close, 0) - 1 AS fwd, row_number() OVER ({ROWS}) AS n, count(*) OVER (PARTITION BY code) AS total FROM averaged) x"""


def feature_panel(flow: Flow) -> Callable[[SparkSession, str], DataFrame]:
    rows = flow.run(_FEATURES_SQL)
    return lambda spark, sf_dir: rows(spark, sf_dir).withColumnRenamed("range_", "range").dropna(subset=list(FEATURES))


def feature_selection(flow: Flow, level: float = 0.05, relaxed: float = 0.20) -> Callable[[SparkSession, str], DataFrame]:
    """Benjamini-Hochberg over Spearman tests of each feature against the label's return.

    Ranks and correlations are within codes; the test is of their mean. With none selected
    at ``level`` the ``relaxed`` level holds.
    """
    panel = feature_panel(flow)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = panel(spark, sf_dir).where("fwd IS NOT NULL")
        per = rows.select("code", "fwd", F.explode(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in FEATURES))).alias("pair")).select("code", "fwd", "pair.*")
        ranked = per.select("code", "feature", F.expr(average_rank("value", "code, feature")).alias("a"), F.expr(average_rank("fwd", "code, feature")).alias("b"))
        tests = ranked.groupBy("code", "feature").agg(F.expr(correlation("a", "b")).alias("rho"), F.count(F.lit(1)).alias("n")).where("n >= 30")
        pooled = tests.groupBy("feature").agg(F.avg("rho").alias("rho"), F.count(F.lit(1)).alias("n"), (F.avg("rho") / F.nullif(F.stddev_samp("rho") / F.sqrt(F.count(F.lit(1))), F.lit(0))).alias("t"))
        pooled = pooled.withColumn("p", two_sided_p(F.col("t"), F.col("n") - 1))
        order = Window.orderBy(F.col("p").asc_nulls_last(), "feature")  # one row a feature
        up = pooled.withColumn("i", F.row_number().over(order)).withColumn("m", F.lit(len(FEATURES)))
        hit = lambda q: F.coalesce(F.max(F.when(F.col("p") <= F.col("i") / F.col("m") * q, F.col("i"))).over(Window.partitionBy()), F.lit(0))
        up = up.withColumn("strict", hit(level)).withColumn("loose", hit(relaxed))
        return up.select("feature", "rho", "p", (F.col("i") <= F.when(F.col("strict") > 0, F.col("strict")).otherwise(F.col("loose"))).alias("selected"))

    return query


def classifier(flow: Flow) -> Callable[[SparkSession, str], DataFrame]:
    """Balanced logistic regression on standardised features: 70 % by time trains, the rest is scored."""
    panel = feature_panel(flow)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import StandardScaler, VectorAssembler
        from pyspark.ml.functions import vector_to_array

        # read several times below: written once
        rows = stored(panel(spark, sf_dir).where("label IS NOT NULL"), "classifier-panel").withColumn("train", F.col("n") <= F.floor(0.7 * F.col("total")))
        share = rows.where("train").agg(F.avg("label")).first()[0]
        rows = rows.withColumn("weight", F.when(F.col("label") == 1, F.lit(0.5 / max(share, 1e-9))).otherwise(F.lit(0.5 / max(1 - share, 1e-9))))
        wide = VectorAssembler(inputCols=list(FEATURES), outputCol="raw").transform(rows)
        scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(wide.where("train"))
        wide = scaler.transform(wide)
        train = wide.where("train")
        model = LogisticRegression(labelCol="label", weightCol="weight", regParam=1 / (0.5 * max(1, train.count())), maxIter=50).fit(train)
        scored = model.transform(wide.where("NOT train"))
        return scored.select("code", "ts", "label", vector_to_array("probability")[1].alias("probability"))

    return query


def placebo(flow: Flow, seed: int = 42) -> Callable[[SparkSession, str], DataFrame]:
    """Fit of each pair with its regressors permuted column by column, per code in numpy."""
    rows = flow.run("SELECT code, ts, y, x1, x2 FROM stacked")

    def fit(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["ts", "x1", "x2", "y"])
        rng = np.random.default_rng(seed)
        x = np.column_stack([rng.permutation(frame.x1.to_numpy()), rng.permutation(frame.x2.to_numpy())])
        y = frame.y.to_numpy()
        theta, *_ = np.linalg.lstsq(x, y, rcond=None)
        total = float(((y - y.mean()) ** 2).sum())
        r2 = 1 - float(((y - x @ theta) ** 2).sum()) / total if total > 1e-12 else np.nan
        return pd.DataFrame({"code": [frame.code.iloc[0]], "k_placebo": [theta[0]], "c_placebo": [theta[1]], "r2_placebo": [r2]})

    return lambda spark, sf_dir: rows(spark, sf_dir).groupBy("code").applyInPandas(fit, "code long, k_placebo double, c_placebo double, r2_placebo double")


# Formula search: trees over named columns, scored as Catalyst expressions.

#: The function set: name -> SQL of its arguments.
FUNCTIONS: dict[str, tuple[int, Callable[..., str]]] = {
    "add": (2, lambda a, b: f"({a} + {b})"),
    "sub": (2, lambda a, b: f"({a} - {b})"),
    "mul": (2, lambda a, b: f"({a} * {b})"),
    "div": (2, lambda a, b: f"(CASE WHEN abs({b}) > 1e-6 THEN {a} / {b} ELSE 1.0D END)"),
    "maximum": (2, lambda a, b: f"greatest({a}, {b})"),
    "minimum": (2, lambda a, b: f"least({a}, {b})"),
    "log": (1, lambda a: f"ln(abs({a}) + 1e-6)"),
    "root": (1, lambda a: f"sqrt(abs({a}))"),
    "sign": (1, lambda a: f"signum({a})"),
    "neg": (1, lambda a: f"(-{a})"),
    "abs": (1, lambda a: f"abs({a})"),
}
Tree = str | tuple


def to_sql(tree: Tree) -> str:
    return f"`{tree}`" if isinstance(tree, str) else FUNCTIONS[tree[0]][1](*(to_sql(t) for t in tree[1:]))


def grow(rng: random.Random, names: tuple[str, ...], depth: int) -> Tree:
    if depth == 0 or rng.random() < 0.25:
        return rng.choice(names)
    name = rng.choice(sorted(FUNCTIONS))
    return (name, *(grow(rng, names, depth - 1) for _ in range(FUNCTIONS[name][0])))


def mutate(rng: random.Random, tree: Tree, other: Tree, names: tuple[str, ...]) -> Tree:
    """A copy with one branch taken from ``other`` or grown anew."""
    if isinstance(tree, str) or rng.random() < 0.3:
        return grow(rng, names, 2) if isinstance(other, str) or rng.random() < 0.5 else rng.choice(other[1:])
    i = rng.randrange(1, len(tree))
    return (*tree[:i], mutate(rng, tree[i], other, names), *tree[i + 1 :])


def fitness(rows: DataFrame, trees: list[Tree], target: str) -> list[float]:
    """|mean daily rank correlation| of each formula with the target, all in one pass by date."""
    made = rows.select("ts", F.col(target).alias("y"), *(F.expr(to_sql(t)).cast("double").alias(f"f{i}") for i, t in enumerate(trees)))
    ranks = [F.expr(average_rank(f"f{i}", "ts")).alias(f"f{i}") for i in range(len(trees))]
    ranked = made.select("ts", F.expr(average_rank("y", "ts")).alias("y"), *ranks)
    daily = ranked.groupBy("ts").agg(*(F.expr(correlation(f"f{i}", "y")).alias(f"f{i}") for i in range(len(trees))), F.count(F.lit(1)).alias("n")).where("n >= 4")
    means = daily.agg(*(F.avg(F.nanvl(f"f{i}", F.lit(None).cast("double"))).alias(f"f{i}") for i in range(len(trees)))).first()
    return [abs(v) if v is not None and np.isfinite(v) else 0.0 for v in means]


def factor_gate(flow: Flow, least: float = 0.04, most: float = 0.7) -> Callable[[SparkSession, str], DataFrame]:
    """Features by |IC|, each dropped if its mean daily rank correlation with a kept one is above ``most``."""
    panel = feature_panel(flow)

    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = panel(spark, sf_dir).where("fwd IS NOT NULL")
        ranked = rows.select("ts", *(F.expr(average_rank(c, "ts")).alias(c) for c in (*FEATURES, "fwd")))
        pairs = [(a, b) for i, a in enumerate(FEATURES) for b in (*FEATURES[i + 1 :], "fwd")]
        daily = ranked.groupBy("ts").agg(*(F.expr(correlation(a, b)).alias(f"{a}|{b}") for a, b in pairs))
        mean = daily.agg(*(F.avg(F.nanvl(f"`{a}|{b}`", F.lit(None).cast("double"))).alias(f"{a}|{b}") for a, b in pairs)).first().asDict()
        value = lambda a, b: abs(mean.get(f"{a}|{b}") or mean.get(f"{b}|{a}") or 0.0)
        kept: list[str] = []
        out = []
        for f in sorted(FEATURES, key=lambda f: (-value(f, "fwd"), f)):
            ok = value(f, "fwd") >= least and all(value(f, k) <= most for k in kept)
            kept += [f] * ok
            out.append((f, float(value(f, "fwd")), ok))
        return spark.createDataFrame(out, "feature string, ic double, kept boolean")

    return query


def registered(flow: Flow) -> tuple[dict[str, Callable], dict[str, str]]:
    made = (feature_selection, classifier, placebo, factor_gate)
    return {f.__name__: f(flow) for f in made}, {}
