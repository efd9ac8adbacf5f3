"""Work that must not grow with the number of batches, channels or patterns, and results that showed only on larger tables."""

import datetime as dt

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemill.operators import ranking, walk_forward, window_statistics
from tidemill.plans import registry
from tidemill.sources import ingest


def statements(spark, monkeypatch):
    """The statements that are run from now on."""
    ran, sql = [], type(spark).sql
    monkeypatch.setattr(type(spark), "sql", lambda self, text, *a, **k: (ran.append(text), sql(self, text, *a, **k))[1])
    return ran


def test_ingest_sums_bars_once_for_all_batches(spark, sf_dir, monkeypatch):
    ran = statements(spark, monkeypatch)
    registry.QUERIES["ingest_resumed"](spark, sf_dir).count()
    assert sum("min_by(px, place)" in text for text in ran) == 1


def test_a_batch_is_read_by_its_folder_whatever_its_name(spark, tmp_path):
    root, now = f"file://{tmp_path}/store", "2024-01-02T09:00 [a=1]"
    asked = spark.createDataFrame([(c,) for c in ("a", "b", "gone")], "code string")

    def fetch(mine):
        rows = mine.where("code <> 'gone'").select("code", F.lit(dt.date(2024, 1, 2)).alias("ts"), *(F.lit(1.0).alias(c) for c in ("open", "high", "low", "close", "volume", "amount")))
        return rows, mine.where("code = 'gone'").withColumn("reason", F.lit("not listed"))

    ingest.ingest(asked, fetch, root, now, size=2)
    assert sorted((r["code"], r["status"], r["reason"], r["n_rows"], str(r["first_ts"])) for r in ingest.entries(spark, root).collect()) == [("a", "ok", None, 1, "2024-01-02"), ("b", "ok", None, 1, "2024-01-02"), ("gone", "failed", "not listed", 0, "None")]
    assert ingest.ingested(spark, root).count() == 2


def test_overlay_pairs_keep_the_sign_of_what_is_rounded_to_zero(spark, sf_dir):
    made = registry.flow()
    made.steps["sector_si"] = "SELECT industry, n, cast(k AS double) AS k, cast(c AS double) AS c FROM (VALUES ('A', 3, 12.346, -0.001), ('B', 4, -0.004, 1.5), ('C', 5, 0.004, 0.0), ('D', 6, -0.006, -7.25), ('E', 7, -0.0e0, 0.001)) AS v(industry, n, k, c)"
    got = [(r["nth"], str(r["k"]), str(r["c"]), r["label"]) for r in made.run(made.queries["overlay_pairs"])(spark, sf_dir).collect()]
    want = [(nth, str(k), str(c), label) for nth, k, c, label in duckdb.connect().execute(made.oracle("overlay_pairs")).fetchall()]
    assert sorted(got) == sorted(want) and ("-0.0", "B, n=4") in [(k, label) for _, k, _, label in got]


def shuffles(frame):
    """Shuffles of what is as large as the lines, and scans of these."""
    plan = frame._jdf.queryExecution().executedPlan().toString()
    return plan.count("Exchange hashpartitioning(l_suppkey"), plan.count("Exchange hashpartitioning(code"), plan.count("FileScan parquet [l_")


@pytest.mark.parametrize("name", ["latest_scores", "walk_forward", "fold_metrics", "channel_composition"])
def test_models_shuffle_the_lines_once(spark, sf_dir, name):
    assert shuffles(registry.QUERIES[name](spark, sf_dir)) == (1, 0, 1)


def test_relative_scores_shuffle_the_lines_once_beside_the_benchmark(spark, sf_dir):
    assert shuffles(registry.QUERIES["relative_scores"](spark, sf_dir)) == (1, 0, 1)


def test_statistics_of_models_are_those_of_the_windows(spark, sf_dir):
    made = registry.flow()
    names = [f"{c}__{s}" for c in walk_forward.CHANNELS for s in walk_forward.MODEL]
    columns = ", ".join(f"max(CASE WHEN channel = '{c}' THEN {walk_forward.STATISTICS[s]} END) AS {c}__{s}" for c in walk_forward.CHANNELS for s in walk_forward.MODEL)
    want = made.run(f"SELECT ts, {columns} FROM channel_windows WHERE n = {walk_forward.WINDOW} AND code = 3 GROUP BY ts ORDER BY ts")(spark, sf_dir).toPandas()
    rows, x = walk_forward._known(walk_forward.panel(made, walk_forward.CHANNELS)(spark, sf_dir).where("code = 3").toArrow(), walk_forward.CHANNELS, labelled=False)
    assert rows["ts"].to_pylist() == list(want.ts) and len(want) > 100
    np.testing.assert_allclose(x, want[names].astype(float).ffill().fillna(0.0).to_numpy(), rtol=1e-7, atol=1e-7)


def test_rank_tests_of_columns():
    x = np.column_stack([np.arange(8.0), np.ones(8), [0, 0, 1, 1, 1, 2, 2, 5.0]])
    y = np.array([0, 0, 0, 0, 1, 1, 1, 1])
    assert walk_forward.rank_tests(x, y).tolist() == [walk_forward.rank_test(x[:, j], y) for j in range(3)]
    assert walk_forward.rank_tests(x, y)[1] == 1.0 and walk_forward.rank_tests(x, np.zeros(8)).tolist() == [1.0] * 3


def test_window_statistics_shuffle_the_lines_once_and_interpret_nothing(spark, sf_dir):
    found = registry.QUERIES["window_statistics"](spark, sf_dir)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert shuffles(found) == (1, 0, 1) and "aggregate(" not in plan and "transform(" not in plan


def test_windows_of_a_code_hold_whole_ones_only():
    days = [dt.date(2024, 1, 1) + dt.timedelta(i) for i in range(40)]
    rows = pa.table({"code": pa.array([7] * 40), "ts": pa.array(days[::-1]), **{c: pa.array([float(39 - i) if c == "close" or i < 32 else None for i in range(40)]) for c in walk_forward.CHANNELS}})
    found = window_statistics.windows_of(rows).to_pandas()
    assert found.groupby("channel").size().to_dict() == {c: 11 if c == "close" else 3 for c in walk_forward.CHANNELS}
    first = found[(found.channel == "close") & (found.ts == days[29])].iloc[0]
    assert (first["median"], first.quantile_10, first.trend_intercept, first.trend_r, first.trend_error, first.number_peaks_1, first.longest_strike_above_mean) == (14.5, 2.9, 0.0, 1.0, 0.0, 0.0, 15.0)


def test_candle_patterns_are_told_apart_after_bars_are_summed(spark, sf_dir):
    found = registry.QUERIES["candle_patterns"](spark, sf_dir)
    plan = found._jdf.queryExecution().executedPlan().toString()
    # bars of the same hits are one row before they meet the patterns
    assert shuffles(found) == (1, 0, 1) and plan.index("Join") < plan.index("HashAggregate(keys=[hits")


def test_packed_rank_sums_are_the_plain_ones(spark):
    rng = np.random.default_rng(4)
    names, channels, n = ["few", "many", "none"], ("a", "b"), 3000
    wide = [(("a", "b")[i % 2], int(rng.integers(2)) if i % 50 else None, float(rng.integers(5)) if i % 7 else None, round(float(rng.normal()), 3) + 0.0, None) for i in range(n)]
    rows = spark.createDataFrame(wide, "channel string, label int, few double, many double, none double").repartition(5)
    plain = spark.createDataFrame([(f"{c}__{k}", v, label) for c, label, *values in wide for k, v in zip(names, values, strict=True)], "feature string, value double, label int")
    want = sorted(tuple(r) for r in ranking.rank_sums(plain).select("feature", "n", "n_up", "u", "ties").collect())
    for parts in (1, 4):
        limits = ranking.range_limits(rows, names, channels, parts)
        assert sorted(limits) == ([] if parts == 1 else [0, 1, 3, 4])
        got = sorted(tuple(r) for r in ranking.packed_rank_sums(rows, names, channels, limits).select("feature", "n", "n_up", "u", "ties").collect())
        assert [x[:3] for x in got] == [x[:3] for x in want] and len(got) == 4
        np.testing.assert_allclose([x[3:] for x in got], [x[3:] for x in want], rtol=1e-12)


def test_feature_relevance_deals_packs_not_rows(spark, sf_dir):
    found = registry.QUERIES["feature_relevance"](spark, sf_dir)
    plan = found.select("feature")._jdf.queryExecution().analyzed().toString()
    assert "explode" not in plan and found.count() == len(walk_forward.CHANNELS) * len(window_statistics.NAMES)
