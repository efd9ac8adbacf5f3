"""Streams that stop and resume: alerts fire once, the universe is read anew, debounced state against its batch twin."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tidemill.streaming import quotes

RAW = "value string, ts timestamp"


def quote(code, now, last, at, error="0"):
    return json.dumps({"Code": code, "ErrorId": error, "Now": now, "LastClose": last, "Volume": 1.0}), at


def put(spark, folder, rows):
    df = spark.createDataFrame([(v, float(at)) for v, at in rows], "value string, s double").select("value", F.timestamp_seconds("s").alias("ts"))
    df.coalesce(1).write.mode("append").parquet(folder)


def stream(spark, folder):
    return spark.readStream.schema(RAW).option("maxFilesPerTrigger", 1).parquet(folder)


def test_stop_and_resume_without_a_second_alert(spark, tmp_path):
    raw, out, progress = (f"file://{tmp_path}/{n}" for n in ("raw", "alerts", "progress"))
    universe = {"A.SH", "B.SZ"}
    codes = lambda: spark.createDataFrame([(c,) for c in sorted(universe)], "code string")
    run = lambda: quotes.monitor(stream(spark, raw), codes, out, progress).awaitTermination()
    put(spark, raw, [quote("A.SH", 106.0, 100.0, 5), quote("A.SH", 107.0, 100.0, 3), quote("B.SZ", 101.0, 100.0, 4), quote("C.SH", 200.0, 100.0, 4), quote("A.SH", 1.0, 0.5, 1, "7"), ("no quote", 2), quote(None, 9.0, 1.0, 1)])
    assert quotes.alerted(spark, out) is None
    run()
    assert [(r["code"], r["rise"]) for r in quotes.alerted(spark, out).collect()] == [("A.SH", 7.0)]
    run()  # nothing new
    put(spark, raw, [quote("A.SH", 150.0, 100.0, 20), quote("B.SZ", 110.0, 100.0, 21)])
    put(spark, raw, [quote("B.SZ", 120.0, 100.0, 30), quote("C.SH", 0.02, -1.0, 31)])
    universe.add("C.SH")
    run()
    got = {r["code"]: (r["rise"], r["batch"]) for r in quotes.alerted(spark, out).collect()}
    assert quotes.alerted(spark, out).count() == 3 and got["B.SZ"][0] == 10.0 and got["A.SH"] == (7.0, 0) and got["C.SH"][0] == 100.0


def test_a_repeated_batch_changes_nothing(spark, tmp_path):
    raw, out = f"file://{tmp_path}/raw", f"file://{tmp_path}/alerts"
    put(spark, raw, [quote("A.SH", 106.0, 100.0, 5)])
    put(spark, raw, [quote("B.SH", 106.0, 100.0, 6), quote("A.SH", 109.0, 100.0, 6)])
    codes = lambda: spark.createDataFrame([("A.SH",), ("B.SH",)], "code string")
    for k in range(2):  # the second run has lost its progress and hands over the same batches
        quotes.monitor(stream(spark, raw), codes, out, f"file://{tmp_path}/progress-{k}").awaitTermination()
        assert sorted((r["code"], r["rise"]) for r in quotes.alerted(spark, out).collect()) == [("A.SH", 6.0), ("B.SH", 6.0)]


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(key, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.unset(key)


@pytest.mark.parametrize("late", [None, "100 seconds"])
def test_debounce_equals_its_batch_twin_after_restarts(spark, tmp_path, rocks, late):
    rng = random.Random(3)
    rows = sorted((rng.random() * 400, rng.choice("AB") if k % 3 else "A", float(k)) for k in range(240))
    folder, out, progress = (f"file://{tmp_path}/{n}" for n in ("risen", "out", "progress"))
    for a in range(0, 240, 80):  # a restart after every part
        part = spark.createDataFrame([(c, t, r) for t, c, r in rows[a : a + 80]], "code string, s double, rise double").select("code", F.timestamp_seconds("s").alias("ts"), "rise")
        part.repartition(2).write.mode("append").parquet(folder)
        source = spark.readStream.schema("code string, ts timestamp, rise double").parquet(folder)
        quotes.debounced(source, 10.0, late).writeStream.format("parquet").option("path", out).option("checkpointLocation", progress).trigger(availableNow=True).start().awaitTermination()
    schema = "code string, ts timestamp, rise double"
    got = sorted((r["code"], r["ts"], r["rise"]) for r in spark.read.schema(schema).parquet(out).collect())
    twin = sorted((r["code"], r["ts"], r["rise"]) for r in quotes.apart(spark.read.schema(schema).parquet(folder), 10.0).collect())
    kept = []
    for c in "AB":
        last = None
        for t, code, r in rows:
            if code == c and (last is None or t - last >= 10):
                last = t
                kept.append((c, r))
    assert got == twin and [(c, r) for c, _, r in got] == kept
