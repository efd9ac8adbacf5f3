"""What reaches the driver is bounded, however often rows repeat; what a worker holds is, too."""

import random
import tracemalloc

import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_operators import items, words
from tidemill.llm import _spark, decontaminate, langid, neardup, tokens


def test_repeats_of_one_id_stay_within_the_sample(spark, monkeypatch):
    seen = {}
    monkeypatch.setattr(langid, "fit", lambda samples: seen.update(samples))
    docs = spark.range(20_000).select(F.lit(1).alias("doc_id"), F.when(F.col("id") % 2 == 0, F.lit("the same words " * 40)).otherwise(F.concat(F.lit("other words "), F.col("id").cast("string"))).alias("text"), F.lit("en").alias("lang"))
    langid.learn(docs)
    assert len(seen["en"]) == langid.SAMPLE_DOCS and sum(map(len, seen["en"])) <= langid.SAMPLE_CHARS
    same = docs.where("text LIKE 'the%'")
    langid.learn(same)
    assert len(seen["en"]) == 1


@pytest.mark.parametrize("bound", [400, 2_000])
def test_shards_are_of_one_size(spark, bound):
    rng = random.Random(8)
    made = [(f"i{k}", words(rng, rng.randint(10, 30))) for k in range(200)] + [("same", "a passage that is there three thousand times and more")] * 3000
    df = spark.createDataFrame(made, "item_id string, text string").repartition(5)
    shards = decontaminate._dealt(decontaminate._distinct(df), bound, "shard").groupBy("shard").agg(F.sum(F.octet_length("text")).alias("size"), F.max(F.octet_length("text")).alias("most"), F.count(F.lit(1)).alias("n")).collect()
    assert sum(r["n"] for r in shards) == 201 and all(r["size"] < bound + r["most"] for r in shards)


def test_repeated_items_in_shards(spark):
    rng = random.Random(9)
    base = [(i, t) for i, t in items() if i is not None] * 3
    docs = [(k, f"{words(rng, 20)} {t or ''} {words(rng, 5)}") for k, (_, t) in enumerate(items())]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r["doc_id"]: (r["n_words"], sum(s["last"] - s["first"] + 1 for s in r["spans"]), len(r["items"])) for r in decontaminate.contamination(df, spark.createDataFrame(base, "item_id string, text string"), max_item_bytes=150).collect()}
    assert got == {k: v[:3] for k, v in decontaminate.brute_force(docs, base).items()}


@pytest.mark.parametrize("keep_ids", [True, False])
def test_temporaries_of_a_batch_of_tokens(keep_ids):
    rng = random.Random(10)
    texts = [words(rng, 400) for _ in range(1900)]
    assert sum(map(len, texts)) > 3 << 20
    cache = tokens.WordCache(public_tokenizers.path("word_bpe_49k.json"), False, True, True, keep_ids)
    column = pa.array(texts)
    tracemalloc.start()
    counts = [n for n, _ in cache.rows(column)]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, counts)) == len(texts)
    assert most < 80 << 20


def test_workers_give_memory_back(monkeypatch):
    calls = []
    monkeypatch.setattr(_spark, "released", lambda: calls.append(len(calls)))
    assert list(_spark.releasing(iter)([1, 2])) == [1, 2] and calls == [0]
    stopped = _spark.releasing(iter)([1, 2])
    next(stopped)
    stopped.close()
    assert calls == [0, 1]


def test_heavy_keys_go_to_the_driver_once(spark):
    left = spark.createDataFrame([(1, i) for i in range(500)] + [(k, -k) for k in range(2, 40)] + [(5, -5), (None, 7), (99, 8)], "k long, x long")
    right = spark.createDataFrame([(k, None if k % 3 else f"r{k}", 500 if k == 1 else 1) for k in range(1, 40)] + [(None, "n", 1)], "k long, y string, n long")
    found = _spark.skew_join(left, right, ["k"], F.col("n") > 100)
    assert found._jdf.queryExecution().executedPlan().toString().count("BroadcastExchange") == 1
    assert found.columns == ["k", "x", "y", "n"]
    assert sorted(map(str, found.collect())) == sorted(map(str, left.join(right, "k").collect()))
    none = _spark.skew_join(left, right, ["k"], F.lit(False))
    assert sorted(map(str, none.collect())) == sorted(map(str, left.join(right, "k").collect()))


def test_components_that_are_stars_take_no_round(spark, monkeypatch):
    wrote = []
    monkeypatch.setattr(neardup, "written", lambda df, name: wrote.append(name) or _spark.written(df, name))
    stars = [(0, i) for i in range(1, 50)] + [(i, 100) for i in range(101, 105)] + [(7, 7), (101, 100)]
    found = neardup.components(spark.createDataFrame(stars, "u long, v long"))
    assert {tuple(r) for r in found.collect()} == {(i, 0) for i in range(50)} | {(i, 100) for i in range(100, 105)}
    assert found.count() == 55
    assert wrote == ["components", "components-found"]
    assert neardup.components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_components_of_any_graph(spark, seed):
    rng = random.Random(seed)
    pairs = [(i, i + 1) for i in range(40)] + [(rng.randrange(100, 200), rng.randrange(100, 200)) for _ in range(70)] + [(300, i) for i in range(301, 340)] + [(320, i) for i in range(400, 440)]
    rng.shuffle(pairs)
    forest = neardup.Forest(500)
    forest.join(*(neardup.np.array(x) for x in zip(*pairs, strict=True)))
    nodes = {x for a, b in pairs for x in (a, b) if a != b}
    found = neardup.components(spark.createDataFrame(pairs, "u long, v long")).collect()
    assert sorted(map(tuple, found)) == [(i, forest.find(i)) for i in sorted(nodes)]
