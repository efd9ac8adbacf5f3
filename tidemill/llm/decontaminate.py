"""Benchmark decontamination with a generalised suffix automaton of the test items.

The automaton reads words, not characters. Training words stream through it and the
longest match that ends at each word is tracked; where it reaches the window (or all of
a shorter item), the matched words are hit, and the state names the items that hold the
window. The automaton goes to the executors by broadcast, as arrays, only while the items'
texts are within ``MAX_ITEM_BYTES``: a word takes at most two states and three arcs. More
items are dealt into shards of about that size, each with an automaton of its own, and a
document's spans from all shards are united.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm._spark import releasing, require, table, unused, with_columns, written
from tidemill.llm._text import ALNUM, LOWER, byte_values, hashes, passes, runs, utf8

MAX_ITEM_BYTES = 2 << 20

#: Columns that a search adds, for the three names it is given.
FOUND = "`{}` long, `{}` array<struct<first:long,last:long>>, `{}` array<string>"
NAMES = ("n_words", "spans", "items")


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, starts, ends and hashes of all words, and where each row's words begin."""
    buf, offsets = utf8(texts)
    starts, ends = runs(ALNUM[buf], offsets)
    return buf, starts, ends, hashes(buf, starts, ends, byte_values(LOWER)), np.searchsorted(starts, offsets)


class Automaton:
    """Generalised suffix automaton of word sequences."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int):
        self.window = window
        _, _, _, h, first = words_of(pa.array([t for _, t in items], pa.string()))
        self.vocabulary, ids = np.unique(h, return_inverse=True)
        self.maybe = np.zeros(1 << 20, bool)
        self.maybe[(self.vocabulary >> np.uint64(44)).astype(np.int64)] = True
        self.next: list[dict[int, int]] | None = [{}]
        self.link = [-1]
        self.length = [0]
        texts = [ids[a:b].tolist() for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        for text in texts:
            self._add(text)
        self.shortest = min([window, *(len(t) for t in texts if t)])
        self._label([i for i, _ in items], texts)
        self._pack()

    def _pack(self) -> None:
        """Arcs as two arrays, ``state * width + word`` and the next state, in place of a table a state."""
        self.width = len(self.vocabulary) + 1
        sizes = np.array([len(d) for d in self.next], np.int64)
        words = np.fromiter((w for d in self.next for w in d), np.int64, int(sizes.sum()))
        self.keys = np.repeat(np.arange(len(sizes)), sizes) * self.width + words
        self.targets = np.fromiter((t for d in self.next for t in d.values()), np.int32, int(sizes.sum()))
        self.next = None
        self.link, self.length, self.at = (array("i", x) for x in (self.link, self.length, self.at))

    @cached_property
    def arcs(self) -> dict[int, int]:
        """The arcs as one table, made where the automaton is used."""
        return dict(zip(self.keys.tolist(), self.targets.tolist(), strict=True))

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "arcs"}

    def _add(self, text: list[int]) -> None:
        follow, link, length = self.next, self.link, self.length
        last = 0
        for w in text:
            known = follow[last].get(w)
            if known is not None and length[known] == length[last] + 1:
                last = known
                continue
            if known is None:
                made = len(follow)
                follow.append({})
                length.append(length[last] + 1)
                link.append(0)
                p = last
                while p >= 0 and w not in follow[p]:
                    follow[p][w] = made
                    p = link[p]
                if p >= 0:
                    q = follow[p][w]
                    link[made] = q if length[q] == length[p] + 1 else self._split(p, w, q)
                last = made
            else:
                last = self._split(last, w, known)

    def _split(self, p: int, w: int, q: int) -> int:
        """A copy of q for the strings that end the shorter match of p and w."""
        copy = len(self.next)
        self.next.append(dict(self.next[q]))
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def _label(self, names: list[str | None], texts: list[list[int]]) -> None:
        """For states at least a window long, their suffix of a window's length and its items; short items."""
        n, window = len(self.next), self.window
        order = sorted(range(n), key=self.length.__getitem__)
        self.at = [-1] * n
        own: dict[int, list[tuple[int, str | None]]] = {}
        members: dict[int, set[str | None]] = {}
        for v in order:
            if self.length[v] >= window:
                up = self.link[v]
                self.at[v] = v if self.length[up] < window else self.at[up]
        for name, text in zip(names, texts, strict=True):
            if len(text) < window:
                if text:
                    v = 0
                    for w in text:
                        v = self.next[v][w]
                    own.setdefault(v, []).append((len(text), name))
                continue
            v = size = 0
            for w in text:
                while w not in self.next[v]:
                    v = self.link[v]
                    size = self.length[v]
                v, size = self.next[v][w], size + 1
                if size >= window:
                    members.setdefault(self.at[v], set()).add(name)
        self.items = {v: sorted(x for x in s if x is not None) for v, s in members.items()}
        self.short: dict[int, list[tuple[int, str | None]]] = {}
        for v in order[1:]:
            if have := own.get(v, []) + self.short.get(self.link[v], []):
                self.short[v] = have

    def _walk(self, text: list[int]) -> Iterator[tuple[int, int, int]]:
        arcs, width, link, length = self.arcs, self.width, self.link, self.length
        v = size = 0
        for i, w in enumerate(text):
            to = arcs.get(v * width + w)
            while to is None and v:
                v = link[v]
                size = length[v]
                to = arcs.get(v * width + w)
            if to is not None:
                v, size = to, size + 1
            yield i, v, size

    def ids(self, h: np.ndarray) -> np.ndarray:
        """Index of each word in the items' vocabulary, -1 for others."""
        out = np.full(len(h), -1, np.int64)
        some = np.flatnonzero(self.maybe[(h >> np.uint64(44)).astype(np.int64)])
        at = np.minimum(np.searchsorted(self.vocabulary, h[some]), max(len(self.vocabulary) - 1, 0))
        same = self.vocabulary[at] == h[some] if len(self.vocabulary) else np.zeros(len(some), bool)
        out[some[same]] = at[same]
        return out

    def find(self, ids: np.ndarray, first: np.ndarray) -> dict[int, tuple[list[tuple[int, int]], set[str]]]:
        """Hit spans of words (from a row's first word, end included) and items, for rows that have any.

        Words that no item has end every match, so only runs of known words at least as
        long as the shortest window go through the automaton.
        """
        starts, ends = runs(ids >= 0, first)
        long = ends - starts >= self.shortest
        starts, ends = starts[long], ends[long]
        rows = np.searchsorted(first, starts, "right") - 1
        found: dict[int, tuple[list[tuple[int, int]], set[str]]] = {}
        window, at, items, short = self.window, self.at, self.items, self.short
        for row, a, b in zip(rows.tolist(), starts.tolist(), ends.tolist(), strict=True):
            base = a - int(first[row])
            for i, v, size in self._walk(ids[a:b].tolist()):
                span = 0
                if size >= window:
                    span = size
                    names = items[at[v]]
                elif v in short:
                    names = []
                else:
                    continue
                whole = [(n, name) for n, name in short.get(v, ()) if n <= size]
                if whole:
                    span = max(span, *(n for n, _ in whole))
                    names = [*names, *(name for _, name in whole if name is not None)]
                if not span:
                    continue
                spans, have = found.setdefault(row, ([], set()))
                have.update(names)
                begin, end = base + i - span + 1, base + i
                while spans and spans[-1][1] >= begin - 1:
                    begin = min(begin, spans.pop()[0])
                spans.append((begin, end))
        return found


def _search(docs: DataFrame, items: DataFrame, window: int, names: tuple[str, str, str], max_coverage: float | None = None) -> DataFrame:
    """``docs`` with FOUND in columns ``names``, for items whose texts are within the broadcast's bound.

    With ``max_coverage``, the same pass cuts the spans out and leaves out what is more
    covered: one Python worker a task, not two.
    """
    rows = items.select("item_id", "text").collect()
    shared = docs.sparkSession.sparkContext.broadcast(Automaton([(r["item_id"], r["text"]) for r in rows], window))
    spans_type = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = shared.value
        for batch in batches:
            texts = batch.column("text")
            _, offsets = utf8(texts)
            counts, spans, found = [], [], []
            for i, j in passes(offsets):
                _, _, _, h, first = words_of(texts.slice(i, j - i))
                hits = automaton.find(automaton.ids(h), first)
                counts.append(np.diff(first))
                for row in range(j - i):
                    s, have = hits.get(row, ((), ()))
                    spans.append([{"first": a, "last": b} for a, b in s])
                    found.append(sorted(have))
            counts = np.concatenate(counts).astype(np.int64) if counts else np.empty(0, np.int64)
            if max_coverage is not None:
                yield _cut(batch, spans, counts, max_coverage)
                continue
            added = [pa.array(counts), pa.array(spans, spans_type), pa.array(found, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *added], names=[*batch.schema.names, *names])

    return docs.mapInArrow(releasing(search), docs.schema if max_coverage is not None else with_columns(docs, FOUND.format(*names)))


def _cut(batch: pa.RecordBatch, spans: list[list[dict]], counts: np.ndarray, max_coverage: float) -> pa.RecordBatch:
    """``batch`` with its spans cut out of ``text``, without the rows of which more is hit."""
    at = batch.schema.get_field_index("text")
    texts = batch.column(at)
    out, keep = texts.to_pylist(), np.ones(len(spans), bool)
    for r in (r for r, s in enumerate(spans) if s):
        hit = sum(s["last"] - s["first"] + 1 for s in spans[r])
        keep[r] = hit <= max_coverage * counts[r]
        buf, starts, ends, _, _ = words_of(texts.slice(r, 1))
        parts, last = [], 0
        for s in spans[r]:
            parts.append(buf[last : starts[s["first"]]].tobytes())
            last = ends[s["last"]]
        out[r] = b"".join([*parts, buf[last:].tobytes()]).decode("utf-8")
    columns = [batch.column(i) if i != at else pa.array(out, pa.string()) for i in range(batch.num_columns)]
    return pa.RecordBatch.from_arrays(columns, names=batch.schema.names).filter(pa.array(keep))


def _distinct(items: DataFrame) -> DataFrame:
    """item_id and text, as strings, each pair once: items that repeat find nothing more."""
    return items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.col("text").isNotNull()).distinct()


def _bytes(items: DataFrame) -> int:
    return items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def _dealt(items: DataFrame, most: int, name: str) -> DataFrame:
    """``items`` with a shard number: by running size, so that a shard exceeds ``most`` bytes by its last item at most."""
    from tidemill.operators.ranking import preceding  # the driver alone needs it

    rows = items.withColumn("_h", F.xxhash64("item_id", "text")).withColumn("_g", F.hash("text", "item_id"))
    placed = preceding(rows, ["_h", "_g", "item_id"], F.octet_length("text").cast("long"), name="_before")
    return placed.select("item_id", "text", F.floor(F.col("_before") / F.lit(most)).alias(name))


def contamination(docs: DataFrame, items: DataFrame, window: int = 10, max_item_bytes: int = MAX_ITEM_BYTES, names: tuple[str, str, str] = NAMES) -> DataFrame:
    """Each row of ``docs`` (its columns) with n_words, spans (of words, last included) and items.

    ``docs`` has doc_id and text, ``items`` item_id and text. Null texts have no words;
    an item without words is ignored; an item without an id hits words but is not named.
    Repeated items count once. More than ``max_item_bytes`` of items are dealt into shards
    of about that size, each a pass; one item must fit.
    Repeated documents are rows of their own; an empty table on either side finds nothing.
    Columns of ``docs`` named like the results (``names``) are replaced.
    """
    require(docs, ("doc_id", "text"))
    require(items, ("item_id", "text"))
    docs, items = docs.drop(*names).withColumn("text", F.col("text").cast("string")), _distinct(items)
    if _bytes(items) <= max_item_bytes:
        return _search(docs, items, window, names)
    n_words, spans, found = names
    row = unused(docs, "row")
    rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "decontaminate-rows")
    items = written(_dealt(items, max_item_bytes, "shard"), "decontaminate-items")
    parts = None
    for (k,) in sorted(items.select("shard").distinct().collect()):
        shard = items.where(F.col("shard") == k)
        part = written(_search(rows.select(row, "text"), shard, window, names).drop("text"), "decontaminate-shard")
        parts = part if parts is None else parts.unionByName(part)
    united = parts.groupBy(row).agg(
        F.max(n_words).alias(n_words),
        F.array_sort(F.flatten(F.collect_list(spans))).alias(spans),  # one entry a shard
        F.array_sort(F.array_distinct(F.flatten(F.collect_list(found)))).alias(found),
    )
    # spans are sorted by their first word: join those that touch
    one = F.expr(f"""aggregate(`{spans}`, cast(array() as array<struct<first:bigint,last:bigint>>), (a, x) ->
        if(size(a) > 0 and element_at(a, -1).last >= x.first - 1,
           concat(slice(a, 1, size(a) - 1), array(named_struct('first', element_at(a, -1).first, 'last', greatest(element_at(a, -1).last, x.last)))),
           concat(a, array(x))))""")
    return rows.join(united.withColumn(spans, one), row).drop(row)


def n_hit() -> Column:
    return F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["last"] - s["first"] + 1)


def decontaminate(docs: DataFrame, items: DataFrame, window: int = 10, max_coverage: float = 0.8, max_item_bytes: int = MAX_ITEM_BYTES) -> DataFrame:
    """``docs`` without benchmark passages, in its own columns.

    Hit spans are cut out of the text (and n_chars, if there, counted anew); a document
    of which more than ``max_coverage`` is hit goes as a whole. Others stay as they are,
    null and empty texts among them; repeated rows are rows of their own, and no other
    column is touched, whatever its name. An empty table on either side changes nothing.
    """
    require(docs, ("doc_id", "text"))
    require(items, ("item_id", "text"))
    docs, items = docs.withColumn("text", F.col("text").cast("string")), _distinct(items)
    if _bytes(items) <= max_item_bytes:
        clean = _search(docs, items, window, NAMES, max_coverage)
    else:
        names = tuple(unused(docs, n) for n in NAMES)
        found = contamination(docs, items, window, max_item_bytes, names)

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rest = batch.select([n for n in batch.schema.names if n not in names])
                yield _cut(rest, batch.column(names[1]).to_pylist(), batch.column(names[0]).to_numpy(), max_coverage)

        clean = found.mapInArrow(releasing(cut), found.drop(*names).schema)
    if "n_chars" in docs.columns:
        kind = dict(docs.dtypes)["n_chars"]
        clean = clean.withColumn("n_chars", F.when(F.col("n_chars").isNotNull() & F.col("text").isNotNull(), F.length("text").cast(kind)).otherwise(F.col("n_chars")))
    return clean.select(*(F.col(f"`{c}`") for c in docs.columns))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", n_hit().alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (n_hit() > 0).alias("contaminated"),
    )


def brute_force(docs: list[tuple[int, str | None]], items: list[tuple[str, str | None]], window: int = 10) -> dict[int, tuple[int, int, int, str]]:
    """The same results for a few texts, by looking up every window."""
    import re

    word = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    split = lambda t: word.findall((t or "").translate(fold))
    windows: dict[tuple[str, ...], set[str]] = {}
    for name, text in items:
        w = split(text)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            windows.setdefault(tuple(w[i : i + window]), set()).add(name)
    sizes = {len(x) for x in windows}
    out = {}
    for key, text in docs:
        w, hit, names = split(text), set(), set()
        for n in sizes:
            for i in range(len(w) - n + 1):
                if (x := tuple(w[i : i + n])) in windows:
                    names |= windows[x]
                    hit.update(range(i, i + n))
        out[key] = (len(w), len(hit), len(names), hashlib.sha256(",".join(sorted(names)).encode()).hexdigest())
    return out
