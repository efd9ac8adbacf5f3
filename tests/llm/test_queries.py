"""The registered queries over one small folder of tables against brute force and their SQL; stages on awkward tables."""

import hashlib
import random
import time
import zlib

import duckdb
import numpy as np
import pandas as pd
import pytest

import corpus_pipeline
from tests.llm.test_operators import DOCS, P, SECRET_TEXTS, WORDS, corpus, items, words
from tidemill.llm import decontaminate, html_text, langid, neardup, queries, secrets, substrings

PAGES = [(1, "http://a b", "<p>One &amp; two.</p>"), (5, None, "<p>One &amp; two.</p>"), (3, "u", "<html><nav><a href=/>Home</a></nav><article><h1>Title</h1><p>" + "A sentence of the article, and more of it. " * 3 + "</p></article></html>"), (2, "v", None), (9, "w", ""), (7, "z", "<div>" * 3000 + "deep" + "</div>" * 3000)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("tables")
    rng = np.random.default_rng(8)
    documents = [*corpus(), (900, "eyJa" * 2000 + " secret = abcdefgh", "en", "s", 8018), (903, words(random.Random(3), 12000), None, "s", 1)]
    vectors = [(int(i), [float(x) for x in rng.normal(size=6)]) for i in range(160)] + [(200, None), (201, [float("nan")] * 6), (250, [1e6, -2e5, 0.5, 1.0, 0.0, 3.0]), (251, [1e6, 1e6, 0.0, 0.0, 0.0, 0.0])]
    vectors += [(300 + i, vectors[0][1]) for i in range(7)]
    spark.createDataFrame(documents, DOCS).repartition(3).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    spark.createDataFrame(items(), "item_id string, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(vectors, "vec_id long, embedding array<double>").write.parquet(f"{folder}/embeddings.parquet")
    talk = [(c, k, "user" if k % 2 else None, f"t{c % 3} of {k}") for c in range(60) for k in range(c % 5)]
    spark.createDataFrame(talk, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return str(folder), {r[0]: r for r in documents}


@pytest.fixture(scope="module")
def empties(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("empty")
    for name, schema in (("documents", DOCS), ("pages", "page_id long, url string, html string"), ("benchmark", "item_id string, text string"), ("embeddings", "vec_id long, embedding array<double>"), ("conversations", "conv_id long, turn long, role string, text string")):
        spark.createDataFrame([], schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def found(spark, tables, name, key="doc_id"):
    return queries.QUERIES[name](spark, tables[0]).toPandas().set_index(key)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables(spark, empties, name):
    assert queries.QUERIES[name](spark, empties).count() == 0


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, tables, name):
    db = duckdb.connect()
    for t in ("pages", "embeddings", "documents", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{tables[0]}/{t}.parquet/*.parquet'")
    want = db.execute(queries.ORACLE_SQL[name]).df()
    got = queries.QUERIES[name](spark, tables[0]).toPandas()
    clean = lambda f: sorted(tuple("" if v is None or v is pd.NA or v != v else str(v).removesuffix(".0") for v in r) for r in f[sorted(f.columns)].itertuples(index=False, name=None))
    assert sorted(got.columns) == sorted(want.columns) and clean(got) == clean(want)


def test_op2(spark, tables):
    got = found(spark, tables, "op2_language_id")
    assert len(got) == len(tables[1])
    for i, row in tables[1].items():
        assert got.loc[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2)
        assert (got.loc[i].lang_pred == "und") == (not any(c.isalpha() for c in row[1] or "")) and 0 <= got.loc[i].score <= 1


def test_op3(spark, tables):
    got = found(spark, tables, "op3_jaccard_join")
    for i, (group, links) in neardup.brute_force([(i, r[1]) for i, r in tables[1].items()]).items():
        assert (got.loc[i].class_id, got.loc[i].n_links) == (group, links)


def test_op4(spark, tables):
    got = found(spark, tables, "op4_html_text", "page_id")
    assert len(got) == len(PAGES)
    for page_id, url, page in PAGES:
        blocks = html_text.blocks_of(page)
        p = html_text.trained().label([blocks])[0]
        assert got.loc[page_id].text == "\n\n".join(b.text for b, x in zip(blocks, p, strict=True) if x >= 0.5)
        assert got.loc[page_id].n_chars == len(got.loc[page_id].text) and (got.loc[page_id].url or None) == url
    assert got.loc[3].text.startswith("Title\n\nA sentence")


def test_op5(spark, tables):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    got = queries.QUERIES["op5_packing"](spark, tables[0]).toPandas()
    total = 0
    for i, row in tables[1].items():
        ids = [*library.encode(row[1] or "", add_special_tokens=False).ids, 0]
        total += len(ids)
        mine = got[got.doc_id == i].sort_values("piece")
        assert mine.length.tolist() == [min(2048, len(ids) - a) for a in range(0, len(ids), 2048)]
        assert [zlib.crc32(np.array(ids[a : a + 2048], "<u4").tobytes()) for a in range(0, len(ids), 2048)] == mine.ids_crc32.tolist()
    sums = got.groupby("sequence_id").length.sum()
    whole = int((got.length == 2048).sum())
    rest = got[got.length < 2048].length.sum()
    assert sums.max() <= 2048 and len(sums) <= whole + -(-rest // 2048) + 1
    assert (got.sort_values(["sequence_id", "offset"]).groupby("sequence_id").length.cumsum() - got.sort_values(["sequence_id", "offset"]).length == got.sort_values(["sequence_id", "offset"]).offset).all()


def test_op6(spark, tables):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    got = found(spark, tables, "op6_token_counts")
    for i, row in tables[1].items():
        n = len(library.encode(row[1] or "", add_special_tokens=False).ids)
        assert tuple(got.loc[i]) == (len((row[1] or "").encode()), n, n > 512)


def test_op7(spark, tables):
    got = found(spark, tables, "op7_decontamination")
    for i, want in decontaminate.brute_force([(i, r[1]) for i, r in tables[1].items()], items()).items():
        assert tuple(got.loc[i]) == (*want, want[1] > 0)


def test_op8(spark, tables):
    got = found(spark, tables, "op8_substrings")
    for i, want in substrings.brute_force([(i, r[1]) for i, r in tables[1].items()]).items():
        assert tuple(got.loc[i]) == want


def test_op9(spark, tables):
    got = found(spark, tables, "op9_secrets")
    for i, row in tables[1].items():
        assert tuple(got.loc[i][["n_assign", "n_access", "n_hex", "base_sha256"]]) == secrets.brute_force(row[1])
        base = ",".join(s for s in got.loc[i].spans.split(",") if s.split(":")[0] in ("assign", "access", "hex"))
        assert hashlib.sha256(base.encode()).hexdigest() == got.loc[i].base_sha256


@pytest.mark.parametrize("text", ["eyJa" * 250_000 + ".x eyJa.eyJ" + "b" * 30, " " * 1_000_000, "token" + " " * 1_000_000 + "=abcdefgh", "AKIA" * 250_000, "-----BEGIN " * 90_000])
def test_a_megabyte_is_scanned_in_seconds(text):
    data = np.frombuffer(text.encode(), np.uint8)
    began = time.time()
    automaton = secrets.scanner(secrets.BASE + secrets.MORE)
    bits = automaton.accepted(data, np.array([0, len(data)]))
    automaton.spans(data.tobytes(), int(bits[0]))
    assert time.time() - began < 60


def test_letters_beyond_the_dense_columns():
    rng = random.Random(4)
    alphabet = [chr(c) for c in range(0x4E00, 0x4E00 + 700)]
    samples = {"a": ["".join(rng.choice(alphabet[:400]) for _ in range(3000))], "b": ["".join(rng.choice(alphabet[300:]) for _ in range(3000))], "c": ["plain words of letters"]}
    model = langid.fit(samples)
    assert len(model.symbols) > langid.DENSE and len(model.arcs)
    texts = ["".join(rng.choice(alphabet[:300]) for _ in range(600)), "".join(rng.choice(alphabet[420:]) for _ in range(40)), samples["a"][0][100:160] + " words 丂x", "ж"]
    counts, _ = langid.phrases(model, texts)
    plain = {k: " ".join(langid.normal(v[0]).split()) for k, v in samples.items()}
    for row, text in zip(counts.tolist(), texts, strict=True):
        assert row == list(langid.brute_force(plain, text).values())
    assert langid.predict(model, texts[:2])[0] == ["a", "b"]


def test_only_labelled_rows_are_learned(spark):
    rows = [(1, "abc abd", "x"), (1, "ηηη θθθ", None), (3, "efg", "y"), (1, "ζζζ", "y")]
    model = langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert set("abcdefg") <= set(model.symbols) and "ζ" in model.symbols and not set("ηθ") & set(model.symbols)
    assert langid.predict(langid.fit({"b": ["x"], "a": ["x"]}), ["x"])[0] == ["a"]


def test_recall_near_the_threshold(spark):
    """Pairs just above the threshold, in one group with many shared words: every link is found."""
    rng = random.Random(9)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(120):
        copy = list(base)
        at = rng.randrange(5, 105)
        copy[at : at + rng.randint(1, 6)] = [f"c{i}_{k}" for k in range(rng.randint(1, 6))]
        rows.append((i, " ".join(copy)))
    want = neardup.brute_force(rows)
    got = neardup.similarity_join(spark.createDataFrame(rows, "doc_id long, text string")).toPandas().set_index("doc_id")
    assert sum(n for _, n in want.values()) > 1000
    assert got.n_links.sum() == sum(n for _, n in want.values()) and {i: g for i, (g, _) in want.items()} == got.class_id.to_dict()


def test_prefixes_fit_the_size_of_a_text():
    by_size = neardup.prefixes_by_size(0.8, 24, 8, 0.9999)
    assert by_size[1] == 8 and by_size[3] == 8 and by_size[-1] == by_size.min() == 5
    assert neardup.least_similarity(3, 0.8) == 1.0 and neardup.least_similarity(4, 0.8) == pytest.approx(0.8)


def test_climbing_meets_all_pairs_of_a_subtree():
    rng = np.random.default_rng(5)
    paths = rng.integers(0, 3, (40, 3)).astype(np.uint32)
    paths = paths[np.lexsort(paths.T[::-1])]
    value = rng.integers(0, 30, 40)
    near = lambda i, others: np.abs(value[others] - value[i]) <= 1
    label = neardup.climb(paths, np.zeros(40, int), np.full(40, 2), near)
    order = np.sort(np.unique(value))
    group = np.concatenate([[0], np.cumsum(np.diff(order) > 1)])
    want = group[np.searchsorted(order, value)]
    assert len(np.unique(label)) == group[-1] + 1 and all(len(np.unique(want[label == x])) == 1 for x in np.unique(label))


CLASH = "score double, secrets string, spans string, items string, n_words int, row long, lang_pred string, text_key long, _score int"


def clashing(spark):
    rows = [(i, t, "en" if i % 2 else "fr", "s", len(t or ""), 9.5, "x", "y", "z", 3, 77, "w", 5, 4) for i, t, *_ in corpus()]
    rows += [(1000 + i, t, "en", "s", len(t or ""), 9.5, "x", "y", "z", 3, 77, "w", 5, 4) for i, t in enumerate(SECRET_TEXTS)]
    return spark.createDataFrame(rows, f"{DOCS}, {CLASH}")


@pytest.mark.parametrize("stage", [0, 1, 2, 3])
def test_stages_take_no_name(spark, tables, stage):
    docs = clashing(spark)
    out = corpus_pipeline.STAGES[stage][1](spark, docs, tables[0])
    assert out.columns == docs.columns and out.dtypes == docs.dtypes
    rows = out.collect()
    assert rows and all((r["score"], r["secrets"], r["spans"], r["items"], r["n_words"], r["row"], r["lang_pred"], r["text_key"], r["_score"]) == (9.5, "x", "y", "z", 3, 77, "w", 5, 4) for r in rows)


@pytest.mark.parametrize("stage", [0, 1, 2, 3, 4])
def test_stages_of_empty_tables(spark, empties, stage):
    docs = spark.read.parquet(f"{empties}/documents.parquet")
    out = corpus_pipeline.STAGES[stage][1](spark, docs, empties)
    assert out.count() == 0 and (stage == 4 or out.columns == docs.columns)


@pytest.mark.parametrize("bound", [1 << 25, 200])
def test_shards_take_no_name(spark, bound):
    docs = clashing(spark)
    clean = decontaminate.decontaminate(docs, spark.createDataFrame(items(), "item_id string, text string"), max_item_bytes=bound)
    assert clean.columns == docs.columns and clean.where("items <> 'z' or spans <> 'y' or row <> 77").count() == 0


def test_texts_under_one_id(spark):
    rng = random.Random(2)
    a, b = words(rng, 40), words(rng, 40)
    rows = [(1, a, "p"), (1, b, "q"), (1, a, "o"), (2, a + " more", "r"), (None, a, "s"), (None, a, "s"), (3, None, "t"), (4, "", "u"), (3, None, "t")]
    kept = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert sorted((r["doc_id"] or 0, r["text"] or "", r["source"]) for r in kept.collect()) == sorted([(1, a, "o"), (1, b, "q"), (0, a, "s"), (0, a, "s"), (3, "", "t"), (4, "", "u")])


def test_very_long_texts_pass_the_stages(spark, tables):
    rng = random.Random(12)
    text = " ".join(rng.choice(WORDS) for _ in range(150_000)) + " password=hunter2222"
    docs = spark.createDataFrame([(1, text, "en", "s", len(text)), (2, "x" * 300_000, "en", "s", 300_000)], DOCS)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, tables[0]).collect(), docs.schema)
    assert sorted(r["doc_id"] for r in docs.collect()) == [1, 2] and "hunter2222" not in docs.where("doc_id = 1").first()["text"]
    assert corpus_pipeline.STAGES[-1][1](spark, docs, tables[0]).select("doc_id").distinct().count() == 2
