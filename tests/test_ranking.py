"""Positions over whole tables, rank sums and selection against brute force."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tidemill.operators import ranking


def test_positions_over_all_rows(spark):
    rng = random.Random(4)
    rows = [(g, round(rng.random(), 2), i, rng.choice([None, 1, 2, 3])) for i, g in enumerate(rng.choices("abc", k=500))]
    df = spark.createDataFrame(rows, "g string, v double, i long, w int").repartition(5)
    got = {r["i"]: r["before"] for r in ranking.preceding(df, ["v", "i"]).collect()}
    order = sorted(rows, key=lambda r: (r[1], r[2]))
    assert [got[r[2]] for r in order] == list(range(500))
    got = {r["i"]: r["before"] for r in ranking.preceding(df, ["v", "i"], F.col("w"), ["g"]).collect()}
    for g in "abc":
        total = 0
        for r in (r for r in order if r[0] == g):
            assert got[r[2]] == total
            total += r[3] or 0
    assert ranking.preceding(df.limit(0), ["v", "i"]).count() == 0


def test_no_task_sees_all_rows(spark):
    df = spark.range(1000).withColumn("v", F.col("id") % 7)
    plan = ranking.preceding(df, ["v", "id"])._jdf.queryExecution().executedPlan().toString()
    # only the sums of the ranges are in one place: an aggregate of the ranges stands right below
    assert plan.count("SinglePartition") == 1 and "HashAggregate" in plan[plan.find("SinglePartition") :].split("\n")[1]


def by_pairs(values):
    up, down = [v for v, y in values if y == 1], [v for v, y in values if y == 0]
    u = sum((a > b) + 0.5 * (a == b) for a in up for b in down)
    n, ties = len(values), sum(list(v for v, _ in values).count(x) ** 3 - list(v for v, _ in values).count(x) for x in {v for v, _ in values})
    variance = len(up) * len(down) / 12 * (n + 1 - ties / (n * (n - 1)))
    p = math.erfc(max(abs(u - len(up) * len(down) / 2) - 0.5, 0) / math.sqrt(variance) / math.sqrt(2)) if variance > 1e-9 else None
    return u, p


def test_relevance_by_pairs(spark):
    rng = random.Random(6)
    made = {}
    for f in range(12):
        labels = [rng.randrange(2) for _ in range(120)]
        made[f"f{f}"] = [((rng.gauss(0, 1) + y * (1.5 if f < 3 else 0)) if f % 2 else float(rng.randrange(4) + y * (f < 3)), y) for y in labels]
    made["constant"] = [(1.0, y) for _, y in made["f0"]]
    made["one label"] = [(v, 1) for v, _ in made["f1"]]
    rows = [(k, v, y) for k, pairs in made.items() for v, y in pairs] + [("f0", None, 1), ("f0", 2.0, None)]
    got = {r["feature"]: r for r in ranking.relevance(spark.createDataFrame(rows, "feature string, value double, label int").repartition(4)).collect()}
    assert set(got) == set(made)
    ps = {}
    for f, pairs in made.items():
        u, p = by_pairs(pairs) if f != "one label" else (0, None)
        assert got[f]["u"] == u and got[f]["n"] == 120 and (got[f]["p"] is None) == (p is None)
        if p is not None:
            assert got[f]["p"] == pytest.approx(p, abs=1e-12)
            ps[f] = p
    order = sorted(ps, key=lambda f: (ps[f], f))
    last = max((i for i, f in enumerate(order, 1) if ps[f] <= 0.05 * i / len(order)), default=0)
    assert {f for f in got if got[f]["selected"]} == set(order[:last]) >= {"f0", "f1", "f2"}


def test_relaxed_level(spark):
    rows = [("a", float(i), int(i % 2 == 0 or i > 16)) for i in range(24)]
    got = ranking.relevance(spark.createDataFrame(rows, "feature string, value double, label int"))
    p = got.first()["p"]
    assert 0.05 < p < 0.2 and got.first()["selected"]
    assert not ranking.relevance(spark.createDataFrame(rows, "feature string, value double, label int"), relaxed=p / 2).first()["selected"]
