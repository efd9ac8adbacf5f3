"""Operators on values worked out by hand, and on series whose parameters are known."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill.functions import exprs, special
from tidemill.operators import dynamics, folds, learning, selection
from tidemill.plans.flow import Flow
from tidemill.streaming import quotes


def one(spark, expression):
    return spark.sql(f"SELECT {expression} AS x").first()["x"]


@pytest.mark.parametrize(
    ("k", "c", "label"),
    [(0.0, 0.0, "jordan_drift"), (0.0, 0.5, "marginal_const"), (0.5, 0.9, "stable_oscillatory"), (0.1, 1.0, "stable_overdamped"), (0.25, 1.0, "stable_critical_damping"), (-0.5, 0.2, "anti_restoring"), (6.0, 5.0, "monotonic_divergent"), (6.0, 6.0, "monotonic_divergent"), (1.0, 0.2, "oscillatory_divergent"), (1.0, 2.5, "critical_period2"), (0.5, 0.5, "critical_periodic")],
)
def test_stability_classes(spark, k, c, label):
    made = dynamics.classify(f"cast({k} AS double)", f"cast({c} AS double)")
    assert one(spark, made["class"]) == label
    roots = np.linalg.eigvals(np.array([[1.0, 1.0], [-k, 1 - c]]))
    assert one(spark, made["radius"]) == pytest.approx(abs(roots).max(), abs=1e-7)


@pytest.mark.parametrize(("s", "m", "beta", "left"), [((30, 60), (50, 100), 0.6, (0, 0)), ((40, 50), (50, 100), 0.56, (12, -6)), ((1, 2), (0, 0), 0.0, (1, 2))])
def test_projection_of_a_move(spark, s, m, beta, left):
    flow = Flow()
    dynamics.add(flow)
    rows = spark.createDataFrame([(1, 2.0, *map(float, s), *map(float, m))], "code int, ts double, sx double, sy double, mx double, my double")
    got = spark.sql(flow.steps["movement"].replace("FROM moves", "FROM {rows}"), rows=rows).first()
    assert got["beta"] == pytest.approx(beta)
    assert (s[0] - got["beta"] * m[0], s[1] - got["beta"] * m[1]) == pytest.approx(left)


def test_fit_recovers_parameters(spark):
    flow = Flow()
    dynamics.add(flow)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 2))
    y = x @ [0.5, 0.2] + rng.normal(scale=0.01, size=400)
    rows = spark.createDataFrame(pd.DataFrame({"code": 1, "index_code": "i", "ts": range(400), "y": y, "x1": x[:, 0], "x2": x[:, 1]}))
    made = "WITH gram AS (" + flow.steps["gram"].replace("FROM stacked", "FROM {rows}") + ")" + "".join(f", {n} AS ({flow.steps[n]})" for n in ("solved", "fitted", "kc")) + " SELECT * FROM kc"
    got = spark.sql(made, rows=rows).first()
    assert (got["k"], got["c"]) == pytest.approx((0.5, 0.2), abs=0.01)
    assert got["r2"] > 0.9 and got["identification"] == "well_conditioned" and got["status"] == "ok (restoring, damping)"
    assert got["cond"] == pytest.approx(np.linalg.cond(x), rel=1e-6)


def test_average_rank(spark):
    x = [3.0, 1.0, 2.0, 2.0, 5.0, 2.0]
    rows = spark.createDataFrame([(1, v) for v in x], "g int, x double")
    got = rows.select("x", F.expr(exprs.average_rank("x", "g")).alias("r")).toPandas().sort_values("x").r.tolist()
    assert got == sorted(pd.Series(x).rank().tolist())


def test_correlation_of_a_constant_is_null(spark):
    rows = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double")
    assert rows.agg(F.expr(exprs.correlation("a", "b")).alias("r")).first()["r"] is None


def test_ewm(spark):
    x = np.random.default_rng(1).normal(size=50)
    rows = spark.createDataFrame([(x.tolist(),)], "x array<double>")
    got = rows.select(folds.ewm(F.col("x"), 0.2)).first()[0]
    assert got == pytest.approx(pd.Series(x).ewm(alpha=0.2, adjust=False).mean().tolist())


def test_student_p():
    assert special.student_p(2.0, 10) == pytest.approx(0.07338803, abs=1e-8)
    assert special.student_p(0.0, 5) == pytest.approx(1.0)
    assert special.student_p(-3.5, 30) == pytest.approx(0.00147, abs=1e-5)
    assert math.isnan(special.student_p(float("nan"), 3))


def test_fees(spark):
    assert one(spark, selection.fee("10000.0D", "'SH'", True)) == pytest.approx(10000 * (8.5e-5 + 1e-5 + 5e-4))
    assert one(spark, selection.fee("10000.0D", "'SZ'", False)) == pytest.approx(0.85)


def test_formulas(spark):
    rows = spark.createDataFrame([(2.0, 0.0)], "a double, b double")
    value = lambda tree: rows.select(F.expr(learning.to_sql(tree))).first()[0]
    assert value(("div", "a", "b")) == 1.0
    assert value(("add", ("mul", "a", "a"), ("neg", "b"))) == 4.0
    assert value(("log", "b")) == pytest.approx(math.log(1e-6))


def test_alerts_fire_once(spark, tmp_path):
    rows = [("A", 106.0, 100.0, 1), ("A", 120.0, 100.0, 2), ("B", 101.0, 100.0, 3), ("C", 5.0, -1.0, 4), ("B", 106.0, 100.0, 5), (None, 9.0, 1.0, 6)]
    frame = spark.createDataFrame(rows, "code string, now double, last_close double, n int").withColumn("ts", F.timestamp_seconds("n"))
    frame.repartition(1).write.parquet(str(tmp_path / "q"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "q"))
    got = quotes.drained(quotes.alerts(stream)).collect()
    assert sorted(r["code"] for r in got) == ["A", "B"]


def test_quotes_are_parsed(spark):
    raw = spark.createDataFrame([('{"Code":"X","ErrorId":"0","Now":2.0,"LastClose":1.0}',), ('{"Code":"Y","ErrorId":"7"}',), ("junk",)], "value string").withColumn("ts", F.current_timestamp())
    assert [r["code"] for r in quotes.parse_quotes(raw).where("code is not null").collect()] == ["X"]


def test_flow_rejects_names_twice():
    flow = Flow()
    flow.step(a="SELECT 1")
    with pytest.raises(ValueError):
        flow.step(a="SELECT 2")
