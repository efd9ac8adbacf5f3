"""Models, stores, back-tests and pools on cases with known answers."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidemill.functions import special
from tidemill.operators import backtests, learning, pool, stability, walk_forward
from tidemill.plans import registry
from tidemill.plans.flow import Flow
from tidemill.sources import store


def step(spark, flow, name, **tables):
    """A step over given frames in place of the steps that it names."""
    text = flow.steps[name]
    for t in tables:
        text = text.replace(f"FROM {t}", f"FROM {{{t}}}").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    return spark.sql(text, **tables)


@pytest.mark.parametrize(("t", "df"), [(2.0, 10), (0.3, 1), (-3.5, 30), (1.7, 2), (4.0, 7), (0.0, 5), (2.5, 201)])
def test_p_value_in_sql(spark, t, df):
    got = spark.sql(f"SELECT {special.student_p_sql(f'cast({t} AS double)', str(df))} AS p").first()["p"]
    assert got == pytest.approx(special.student_p(t, df), abs=1e-9)


def test_signals_of_ten_probabilities(spark):
    p = [0.3, 0.6, 0.6, 0.52, 0.58, 0.7, 0.4, 0.45, 0.6, 0.3]
    bars = [(1, t, 10.0, q, q, q is not None) for t, q in enumerate([None, *p[:-1]])]
    flow = Flow()
    backtests.add(flow)
    found = step(spark, flow, "grid_signals", proba_bars=spark.createDataFrame(bars, "code int, ts int, open double, p_basic double, p_ma double, above boolean")).where("strategy = 'p55' AND channel = 'basic'")
    sig = {r["ts"]: r["sig"] for r in found.collect()}
    assert [t for t in range(10) if sig[t] == 1] == [2, 3, 5, 6, 9]
    assert [t for t in range(10) if sig[t] == 0] == [1, 7, 8]
    trades = spark.sql(backtests._trades("{s}", "strategy, channel"), s=found).collect()
    assert [(r["entry_ts"], r["exit_ts"], r["size"]) for r in trades] == [(2, 7, 95000)]


def test_threshold_falls_back(spark):
    flow = Flow()
    stability.enough(flow, "kept", "groups", 20, 10, 3)
    rows = spark.createDataFrame([("a", 25), ("b", 15), ("c", 12), ("d", 5)], "industry string, n int")
    assert sorted(r["industry"] for r in step(spark, flow, "kept", groups=rows).collect()) == ["a", "b", "c"]
    many = spark.createDataFrame([("a", 25), ("b", 20), ("c", 30), ("d", 15)], "industry string, n int")
    assert sorted(r["industry"] for r in step(spark, flow, "kept", groups=many).collect()) == ["a", "b", "c"]
    few = spark.createDataFrame([("a", 2), ("b", 1)], "industry string, n int")
    assert step(spark, flow, "kept", groups=few).count() == 2


def test_rank_test():
    x = np.array([1.0, 2, 3, 4, 5, 6, 7, 8])
    assert walk_forward.rank_test(x, np.array([0, 0, 0, 0, 1, 1, 1, 1])) == pytest.approx(0.030383, abs=1e-5)
    assert walk_forward.rank_test(x, np.zeros(8)) == 1.0
    assert walk_forward.rank_test(np.ones(8), np.array([0, 1] * 4)) == 1.0


def test_step_up():
    p = np.array([0.01, 0.04, 0.03, 0.5])
    assert walk_forward.step_up(p, 0.05).tolist() == [True, False, False, False]
    assert walk_forward.step_up(p, 0.06).tolist() == [True, True, True, False]
    assert not walk_forward.step_up(np.array([0.9, 0.8]), 0.05).any()


def test_logistic_is_the_minimum():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 3)) * [1, 10, 0.1] + [0, 5, 0]
    y = (x[:, 0] + rng.normal(size=300) > 0.5).astype(float)
    model = walk_forward.logistic(x, y)
    p = model(x)
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    # without a penalty on it, the intercept's gradient is zero
    assert (weight * (p - y)).sum() == pytest.approx(0, abs=1e-6)
    assert walk_forward.auc(y, p) > 0.8
    assert walk_forward.logistic(x, np.ones(300))(x[:2]).tolist() == [1.0, 1.0]


def test_walk_forward_does_not_look_ahead():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(160, 4))
    y = (x[:, 1] > 0).astype(float)
    p, keep = walk_forward.walk(x, y, 60, 20)
    assert np.isnan(p[:60]).all() and np.isfinite(p[60:]).all() and keep[1]
    assert ((p[60:] > 0.5) == (y[60:] > 0)).mean() > 0.9
    later = x.copy()
    later[100:] = rng.normal(size=(60, 4))
    again, _ = walk_forward.walk(later, np.concatenate([y[:100], 1 - y[100:]]), 60, 20)
    assert np.array_equal(p[60:100], again[60:100])
    assert np.isnan(walk_forward.walk(x[:50], y[:50], 60, 20)[0]).all()


def test_auc():
    assert walk_forward.auc(np.array([0, 0, 1, 1]), np.array([0.1, 0.4, 0.35, 0.8])) == pytest.approx(0.75)
    assert walk_forward.auc(np.array([0, 1]), np.array([0.5, 0.5])) == 0.5
    assert math.isnan(walk_forward.auc(np.ones(3), np.ones(3)))


def planted(spark, codes=30, days=60, seed=42):
    """A panel whose return ahead is a product of two columns and noise."""
    rng = np.random.default_rng(seed)
    frame = pd.DataFrame({"code": np.repeat(np.arange(codes), days), "ts": np.tile(np.arange(days), codes)})
    for c in ("a", "b", "c"):
        frame[c] = rng.normal(size=len(frame))
    frame["fwd"] = frame.a * frame.b + 0.3 * rng.normal(size=len(frame))
    return spark.createDataFrame(frame)


def test_search_finds_the_planted_formula(spark):
    best = pool.evolve(spark, planted(spark), "fwd", ("a", "b", "c"), 120, 4, 3)
    value, tree = best[0]
    assert value > 0.8 and "mul" in str(tree)
    assert best == pool.evolve(spark, planted(spark), "fwd", ("a", "b", "c"), 120, 4, 3)


def test_arrays_and_sql_agree(spark):
    rows = planted(spark, 3, 10)
    frame = rows.toPandas()
    columns = {c: frame[c].to_numpy() for c in ("a", "b", "c")}
    for tree in (("div", "a", ("sub", "b", "b")), ("log", "a"), ("root", ("neg", "b")), ("maximum", ("sign", "a"), ("mul", "b", "c")), ("minimum", ("abs", "c"), ("add", "a", "b"))):
        got = rows.select("code", "ts", F.expr(learning.to_sql(tree)).alias("v")).toPandas().v.to_numpy()
        assert got == pytest.approx(pool.evaluate(tree, columns))


def test_spearman():
    x, y = np.array([1.0, 2, 2, 5, 9]), np.array([2.0, 1, 4, 4, 7])
    assert pool.spearman(x, pool.ranks(y)) == pytest.approx(abs(np.corrcoef(pool.ranks(x), pool.ranks(y))[0, 1]))
    assert pool.ranks(x).tolist() == [1, 2.5, 2.5, 4, 5]
    assert pool.spearman(np.array([1.0, np.nan]), pool.ranks(np.array([1.0, 2.0]))) == 0.0


def test_windows_are_parsed():
    assert store.parse_windows("60, 120,240,60") == (60, 120, 240)
    for bad in ("", "0", "60,-1"):
        with pytest.raises(ValueError):
            store.parse_windows(bad)


def test_paths():
    assert store.path_of("/r", "stocks", "5m") == "/r/bars/period=5m/kind=stocks"
    assert store.file_tag("000001.SH", "5m") == "000001_SH_5m"
    with pytest.raises(ValueError):
        store.path_of("/r", "bonds")
    with pytest.raises(ValueError):
        store.file_tag("1", "2m")


def test_a_write_replaces_only_its_partitions(spark, tmp_path):
    row = lambda code, kind, period, close: (code, pd.Timestamp("2024-01-02").date(), 1.0, 1.0, 1.0, close, 1.0, 1.0, kind, period)
    root = str(tmp_path)
    store.save_bars(spark.createDataFrame([row("A", "stocks", "daily", 1.0), row("A", "indices", "daily", 2.0), row("B", "indices", "daily", 3.0), row("A", "stocks", "5m", 4.0)], store.BARS), root)
    store.save_bars(spark.createDataFrame([row("A", "stocks", "5m", 5.0)], store.BARS), root)
    assert [(r["code"], r["close"]) for r in store.load_bars(spark, root, "5m").collect()] == [("A", 5.0)]
    assert sorted((r["code"], r["kind"]) for r in store.load_bars(spark, root, "daily").collect()) == [("A", "stocks"), ("B", "indices")]
    assert store.load_bars(spark, root, "daily", "indices").count() == 2


def test_manifest_round_trip(spark, tmp_path):
    path = str(tmp_path / "m")
    entry = "status:string,fetched_at:string"
    assert store.load_manifest(spark, path, entry).count() == 0
    store.save_manifest(spark.createDataFrame([("B", "ok", "d1"), ("A", "failed", "d2")], "code string, status string, fetched_at string"), path)
    assert sorted(map(tuple, store.load_manifest(spark, path, entry).collect())) == [("A", "failed", "d2"), ("B", "ok", "d1")]


def test_cache_keeps_the_newer_row(spark):
    old = spark.createDataFrame([("a", 1, 1), ("b", 1, 1)], "code string, v int, made int")
    new = spark.createDataFrame([("a", 2, 2)], "code string, v int, made int")
    assert sorted(map(tuple, store.appended(old, new, ["code"], "made").collect())) == [("a", 2, 2), ("b", 1, 1)]


def test_aligned(spark):
    rows = spark.createDataFrame([(1.0, None)], "a double, b double")
    assert tuple(store.aligned(rows, ["b", "c", "a"]).first()) == (0.0, 0.0, 1.0)


def test_clean_bars(spark):
    raw = spark.createDataFrame([("x", 1, "1.5", "n/a", "-2", "3", "10"), ("y", 1, "1", "1", "1", "0", "")], "code string, ts int, open string, high string, low string, close string, volume string")
    assert [tuple(r) for r in store.clean_bars(raw).collect()] == [("x", 1, 1.5, None, None, 3.0, 10.0)]


@pytest.mark.parametrize(("name", "scans", "windows"), [("state_distribution", 1, 6), ("ablation_verdict", 0, 0)])
def test_plans_stay_small(spark, sf_dir, name, scans, windows):
    """Scans of the lines and windows in the executed plan of the last step."""
    found = registry.QUERIES[name](spark, sf_dir)
    found.collect()
    plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0]
    assert plan.count("l_shipdate") == 0 or plan.count("FileScan parquet [l_") <= scans
    assert plan.count("- Window [") <= windows


def test_regression_on_known_coefficients(spark, sf_dir):
    made = registry.QUERIES["study_regression"](spark, sf_dir).toPandas()
    # ten codes are too few to have freedom left, not to have columns
    assert len(made) == 7 and made.coefficient.notna().all()
