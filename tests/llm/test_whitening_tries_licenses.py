"""Whitening, the prefix trie and the license scan against brute force, SQL and awkward tables."""

import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

from tidemill.llm import conversations, licenses, whitening

VECTORS = "vec_id long, embedding array<double>, whitened string"
TURNS = "conv_id long, turn long, role string, text string, depth int"


# whitening


def vectors(rng, n=300, d=7):
    mix = rng.normal(size=(d, d)) * np.array([9, 5, 3, 1, 0.5, 0.2, 0.05])[:d]
    return [(int(i), [float(v) for v in row]) for i, row in enumerate(rng.normal(size=(n, d)) @ mix.T + 40)]


def by_hand(rows):
    x = np.floor(64 * np.array([v for _, v in rows])).astype(np.int64) + 1_000_000
    n, s = len(x), x.sum(axis=0)
    z = (n * x - s) / n
    values, components = np.linalg.eigh(z.T @ z / n)
    return n, [int(v) for v in ((n * x - s).astype(object) ** 2).sum(axis=1)], values[::-1], z @ components[:, ::-1]


def test_whitening_is_that_of_numpy(spark):
    rows = vectors(np.random.default_rng(3))
    df = spark.createDataFrame([(i, v, "w") for i, v in [*rows, (900, None), (901, [1.0] * 6 + [None]), (902, [float("inf")] * 7), (903, [])]], VECTORS).repartition(5)
    model = whitening.fit(df)
    got = {r["vec_id"]: r for r in whitening.whiten(df, model).collect()}
    n, deviations, values, projected = by_hand(rows)
    assert model.n == n == len(got) and [int(got[i]["deviation"]) for i, _ in rows] == deviations
    assert np.allclose(model.values, values, rtol=1e-12) and model.identity_error < 1e-9 and np.allclose(model.explained, values / values.sum())
    mine = np.array([got[i]["whitened"] for i, _ in rows])
    signs = np.sign((mine * projected).sum(axis=0))
    assert np.allclose(mine * signs, projected / np.sqrt(values), atol=1e-8)
    assert np.allclose(np.cov(mine.T, bias=True), np.eye(7), atol=1e-9)


def test_components_number_at_most_those_with_variance(spark):
    rng = np.random.default_rng(5)
    flat = [(i, [float(a), float(b), float(a), 3.0], "") for i, (a, b) in enumerate(rng.normal(size=(50, 2)))]
    model = whitening.fit(spark.createDataFrame(flat, VECTORS))
    assert len(model.values) == 2 and model.identity_error < 1e-9
    assert len(whitening.fit(spark.createDataFrame(flat, VECTORS), components=1).values) == 1
    same = spark.createDataFrame([(1, [2.0, 3.0], ""), (1, [2.0, 3.0], ""), (None, [2.0, 3.0], "")], VECTORS)
    model = whitening.fit(same)
    assert model.n == 3 and len(model.values) == 0 and [(r["deviation"], r["whitened"]) for r in whitening.whiten(same, model).collect()] == [(0, [])] * 3


def test_large_entries_and_unlike_lengths(spark):
    rows = [(i, [float(v) * 2**30, float(i)]) for i, v in enumerate((3, -5, 1, 7))]
    df = spark.createDataFrame([(i, v, "") for i, v in rows], VECTORS)
    got = {r["vec_id"]: int(r["deviation"]) for r in whitening.whiten(df, whitening.fit(df)).collect()}
    assert [got[i] for i, _ in rows] == by_hand(rows)[1]
    with pytest.raises(ValueError, match="entries"):
        whitening.fit(spark.createDataFrame([(1, [1.0], ""), (2, [1.0, 2.0], "")], VECTORS))


def test_cholesky_and_jacobi():
    rng = np.random.default_rng(8)
    a = rng.normal(size=(9, 5)) @ np.diag([100, 10, 1, 0.5, 0.1])
    order, factor = whitening.pivoted_cholesky(a @ a.T, 1e-10)
    assert factor.shape[1] == 5 and np.allclose((factor @ factor.T), (a @ a.T)[np.ix_(order, order)], rtol=1e-10, atol=1e-6)
    assert (np.diff(np.diag(factor)) <= 1e-9).all()
    turned = whitening.orthogonal_columns(factor)
    norms = np.sort((turned**2).sum(axis=0))[::-1]
    assert np.allclose(norms, np.linalg.svd(a)[1] ** 2, rtol=1e-8)
    gram = turned.T @ turned
    assert np.abs(gram - np.diag(np.diag(gram))).max() < 1e-12 * gram.max()


# conversations


def trie_by_hand(rows):
    own = {}
    sym = lambda r: hashlib.md5(f"{len((r[2] or '').encode())}:{r[2] or ''}{r[3] or ''}".encode()).hexdigest()
    for r in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0, sym(r))):
        own.setdefault(r[0], []).append((r[2] or "", r[3] or ""))
    members = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        donor = c - int(np.fmod(c, 20))
        path = tuple(own.get(donor, [])[:h] + turns[h:])
        for d in range(len(path) + 1):
            members.setdefault(path[:d], []).append((c, d == len(path)))
    own_saving = {p: (len(m) - 1) * (len(re.findall("[^\x20\x09-\x0d]+", p[-1][1])) if p else 0) for p, m in members.items()}
    kids = {}
    for p in members:
        if p:
            kids[p[:-1]] = kids.get(p[:-1], 0) + 1
    leaves, saved = {}, {}
    for p in members:
        for d in range(len(p) + 1):
            leaves[p[:d]] = leaves.get(p[:d], 0) + (p not in kids)
            saved[p[:d]] = saved.get(p[:d], 0) + own_saving[p]
    least = {p: min(c for c, _ in m) for p, m in members.items()}
    sha = lambda p: hashlib.sha256(",".join(map(str, sorted(c for c, e in members[p] if e))).encode()).hexdigest()
    return sorted((least[p], len(p), least[p[:-1]] if p else -1, len(m), kids.get(p, 0), leaves[p], saved[p], sha(p)) for p, m in members.items())


def dialogues(rng):
    openings = [[("system", f"You are model {i}."), ("user", "Hello there, again"), ("assistant", "Hi")] for i in range(3)]
    rows = []
    for c in [*range(0, 260), 400, 403, -3, -20, -41]:
        kind = rng.random()
        turns = list(openings[0]) if kind < 0.35 else openings[rng.randrange(3)][: rng.randrange(4)] + [("user", f"q{rng.randrange(4)} \t x"), ("assistant", f"a{rng.randrange(3)}")][: rng.randrange(3)]
        turns = turns or [(None, None)]
        rows += [(c, None if k == 0 and c % 7 == 0 else k, role, text, 1) for k, (role, text) in enumerate(turns)]
    rows += [(500, k, "user", f"long {k}", 1) for k in range(900)] + [(501, k, "user", f"long {k}", 1) for k in range(901)] + [(700, 0, "user", "same", 2)] * 3
    rows += [(710, 1, "b", "x y", 1), (710, 1, "a", "z", 1), (710, None, None, "n", 1), (710, None, "r", None, 1), (None, 0, "user", "nobody's", 1)]
    rng.shuffle(rows)
    return rows


def built(df):
    rows = conversations.prefix_trie(conversations.with_openings(conversations.paths_of(df))).collect()
    return sorted((r["conv_id"], r["depth"], -1 if r["parent_conv_id"] is None else r["parent_conv_id"], *(r[c] for c in conversations.COLUMNS[3:])) for r in rows)


@pytest.mark.parametrize("block", [1 << 17, 40, 1])
def test_trie_by_hand(spark, monkeypatch, block):
    """The same trie, whether a block holds all conversations of a task or one."""
    rows = dialogues(random.Random(block))
    monkeypatch.setattr(conversations, "BLOCK", block)
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled", "true")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", str(block < 99).lower() == "false")
    try:
        assert built(spark.createDataFrame(rows, TURNS).repartition(3)) == trie_by_hand(rows)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_forest_of_a_block():
    key = lambda s: b"".join(bytes([ord(c)]) * conversations.SYMBOL for c in s)
    paths = sorted(["", "a", "ab", "abc", "abd", "abd", "b", "bcde", "bcdf"])
    f = conversations.Forest([(key(p), i, [1] * len(p)) for i, p in enumerate(paths)])
    found = {(r[0], r[1]): r for r in f.rows}
    assert len(f.rows) == len({p[:d] for p in paths for d in range(len(p) + 1)})
    assert found[0, 0][2:5] == [9, 2, 4] and found[2, 2][2:5] == [4, 2, 2] and found[3, 4][2:5] == [2, 0, 1]
    assert conversations.shared(key("abcd"), key("abd")) == 2 and conversations.shared(b"", key("a")) == 0 and conversations.shared(key("ab"), key("abc")) == 2


def test_no_conversations(spark):
    assert built(spark.createDataFrame([], TURNS)) == [] and built(spark.createDataFrame([(None, 1, "a", "b", 0)], TURNS)) == []
    # fewer turns than are replaced, and no donor: a conversation without turns
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in range(21, 40)}
    c = next(c for c in h if h[c] > 0)
    assert built(spark.createDataFrame([(c, 0, "a", "b", 0)], TURNS)) == [(c, 0, -1, 1, 0, 1, 0, hashlib.sha256(str(c).encode()).hexdigest())]


# licenses

NOTICE = licenses.TEMPLATES[2][1]
LICENSED = [
    (1, "Released under the MIT License."), (2, None), (3, ""), (4, "mit license MIT-LICENSE  Mit\nlicense"), (5, "prose " + NOTICE + " prose " * 9 + NOTICE), (5, "prose " + NOTICE + " prose " * 9 + NOTICE),
    (None, "cc by cc by"), (6, NOTICE.replace("without restriction", "with no other restriction").replace("copies of the Software,", "all copies of the Software,")), (7, NOTICE[: len(NOTICE) // 2]), (8, "MİT LİCENSE miT license K"),
    (9, "é" * 3 + " cc by-nc 4.0 " * 400 + "Licensed under CC BY-NC 4.0."), (10, " ".join(NOTICE.split()[::-1])), (11, "x " * 6_000 + NOTICE + " y" * 6_000), (12, "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. THIS SOFTWARE"),
]


@pytest.fixture(scope="module")
def licensed(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("licensed"))
    spark.createDataFrame([(i, t, 3, "l") for i, t in LICENSED], "doc_id long, text string, row int, label string").repartition(3).write.parquet(f"{folder}/documents.parquet")
    return folder


def test_licenses_equal_their_sql(spark, licensed):
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{licensed}/documents.parquet/*.parquet'")
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    want = db.execute(f"SELECT {', '.join(names)} FROM ({licenses.OP13_SQL})").fetchall()
    clean = lambda rows: sorted(tuple("" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in rows)
    assert clean(licenses.op13_licenses(spark, licensed).select(*names).collect()) == clean(want)


def test_licenses_are_told(spark, licensed):
    got = {}
    for r in licenses.op13_licenses(spark, licensed).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert len(got[5]) == 2 and all(r["labels"] == "mit" and r["score"] == 1.0 and r["n_base"] == 0 for r in got[5])
    assert [(r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got[4]] == [(3, 0, 4, "mit")]
    assert [(r["n_words"], r["n_base"], r["first_word"], r["labels"], r["score"]) for i in (2, 3) for r in got[i]] == [(0, 0, None, "", 0.0)] * 2
    assert got[6][0]["labels"] == "mit" and 0.8 <= got[6][0]["score"] < 1
    assert got[7][0]["labels"] == got[10][0]["labels"] == "" and got[12][0]["labels"] == "bsd" and got[11][0]["labels"] == "mit"
    assert got[8][0]["n_base"] == 1 and got[8][0]["n_words"] == 5 and got[9][0]["labels"] == "cc-by,cc-by-nc"
    spans = next(r["spans"] for r in licenses.scan(spark.read.parquet(f"{licensed}/documents.parquet")).where("doc_id = 5").collect())
    n = len(re.findall("[a-z0-9]+", NOTICE.lower()))
    assert [(s["label"], s["first"], s["end"]) for s in spans] == [("mit", 1, 1 + n), ("mit", 1 + n + 9, 1 + 2 * n + 9)]


def test_license_scan_runs_no_python(spark, licensed):
    plan = licenses.op13_licenses(spark, licensed)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan) and plan.count("Exchange hashpartitioning") == 1 and "CartesianProduct" not in plan
