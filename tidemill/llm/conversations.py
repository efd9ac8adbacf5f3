"""Prefix trie of conversations by union-find over the common prefixes of sorted neighbours.

A conversation is a row of 16-byte symbols, one for each turn. Conversations are sorted
across the cluster; equal prefixes then stand together, and a node of the trie is a run of
neighbours that agree on its first d turns. Each task walks its part in blocks of bounded
size. In a block, the edges between neighbours, weighted by the turns that both share, are
taken in descending depth: an edge unites two components in a branching node, and the
turns between a component's old and new depth are nodes with one child.

Nodes that touch neither end of their block are whole. The others, the prefixes of its
first and of its last conversation, are contracted to one row each with sums of what the
block knows of them, and merged across borders by their prefix. Sums stay sums across a
border because each block knows how many turns it shares with its neighbours: a node and
its children count where they begin, a leaf where it ends.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemill.llm._spark import require, table, written

SYMBOL = 16
#: Turns that a block holds, but for its last conversation.
BLOCK = 1 << 17
NOTHING = hashlib.sha256(b"").hexdigest()


def paths_of(turns: DataFrame) -> DataFrame:
    """conv_id, turns (array of struct with sym and words) of each conversation, in the order of its turns.

    Null turns come first, turns of one number in the order of a digest of their role and
    text. Null roles and texts are empty, rows without conv_id belong to no conversation,
    repeated rows are turns each. One conversation's digests must fit in a task.
    """
    require(turns, ("conv_id", "turn", "role", "text"))
    role, text = (F.coalesce(F.col(c), F.lit("")) for c in ("role", "text"))
    sym = F.md5(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text))
    one = F.struct(F.col("turn").isNotNull().alias("known"), "turn", sym.alias("sym"), F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("int").alias("words"))
    rows = turns.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), one.alias("one"))
    return rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("one")).alias("turns"))


def with_openings(paths: DataFrame, every: int = 20, most: int = 4) -> DataFrame:
    """``paths`` with the first h turns replaced by those of the conversation whose id is rounded down to ``every``.

    h is the crc32 of the decimal conv_id, modulo ``most``. A donor sends at most
    ``most`` - 1 turns to at most ``every`` conversations.
    """
    paths = written(paths, "conversations")
    heads = paths.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("donor"), F.slice("turns", 1, most - 1).alias("head"))
    rows = paths.select("*", (F.col("conv_id") - F.col("conv_id") % every).alias("donor"), (F.crc32(F.col("conv_id").cast("string")) % most).cast("int").alias("h"))
    head = F.coalesce(F.slice("head", F.lit(1), F.col("h")), F.slice("turns", 1, 0))
    return rows.join(heads, "donor", "left").select("conv_id", F.concat(head, F.slice("turns", F.col("h") + 1, F.size("turns"))).alias("turns"))


def shared(a: bytes, b: bytes) -> int:
    """Symbols that both begin with."""
    low, high = 0, min(len(a), len(b)) // SYMBOL
    if a[: high * SYMBOL] == b[: high * SYMBOL]:
        return high
    while high - low > 1:
        mid = (low + high) // 2
        low, high = (mid, high) if a[: mid * SYMBOL] == b[: mid * SYMBOL] else (low, mid)
    return low


def prefix_keys(key: bytes) -> list[bytes]:
    """A digest of each prefix, the empty one first."""
    out = [hashlib.blake2b(digest_size=SYMBOL).digest()]
    for i in range(0, len(key), SYMBOL):
        out.append(hashlib.blake2b(out[-1] + key[i : i + SYMBOL], digest_size=SYMBOL).digest())
    return out


class Forest:
    """All nodes over a block of sorted conversations (key, conv_id, words), as rows.

    A row is [depth, conv_id, n, children, leaves, with, without, row of the parent, first
    and last key, key that ends here or -1]; ``with`` is the sum of members times words
    over the subtree, ``without`` that of words.
    """

    def __init__(self, block: list[tuple[bytes, int, list[int]]]):
        self.keys: list[bytes] = []
        self.words: list[list[int]] = []
        self.ids: list[list[int]] = []
        for key, conv_id, words in block:
            if not self.keys or self.keys[-1] != key:
                self.keys.append(key)
                self.words.append(words)
                self.ids.append([])
            self.ids[-1].append(conv_id)
        self.rows: list[list] = []
        # open nodes by component: depth, conv_id, n, children, leaves below, sums below, rows of the children, first and last key, ending key
        self.open = [[len(k) // SYMBOL, min(ids), len(ids), 0, 0, 0, 0, [], i, i, i] for i, (k, ids) in enumerate(zip(self.keys, self.ids, strict=True))]
        self.up = list(range(len(self.keys)))
        edges = sorted(((-shared(a, b), i) for i, (a, b) in enumerate(zip(self.keys, self.keys[1:], strict=False))))
        for less, i in edges:
            self._unite(self._find(i), self._find(i + 1), -less)
        if self.keys:
            root = self._find(0)
            self._lift(root, 0)
            self._close(self.open[root])

    def _find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    def _close(self, node: list) -> int:
        """The finished row of an open node."""
        depth, conv_id, n, children, leaves, with_, without, below, first, last, ends = node
        words = self.words[first][depth - 1] if depth else 0
        at = len(self.rows)
        self.rows.append([depth, conv_id, n, children, leaves if children else 1, with_ + n * words, without + words, -1, first, last, ends])
        for r in below:
            self.rows[r][7] = at
        return at

    def _lift(self, root: int, depth: int) -> None:
        """Let the component's open node be at ``depth``: what lies deeper is finished."""
        node = self.open[root]
        while node[0] > depth:
            at = self._close(node)
            _, conv_id, n, _, leaves, with_, without, _, first, last, _ = self.rows[at]
            node = [node[0] - 1, conv_id, n, 1, leaves, with_, without, [at], first, last, -1]
        self.open[root] = node

    def _unite(self, a: int, b: int, depth: int) -> None:
        self._lift(a, depth)
        self._lift(b, depth)
        x, y = self.open[a], self.open[b]
        below, more = (x[7], y[7]) if len(x[7]) >= len(y[7]) else (y[7], x[7])
        below.extend(more)
        # only the first of a run can end where the run agrees
        self.open[a] = [depth, min(x[1], y[1]), *(x[k] + y[k] for k in range(2, 7)), below, min(x[8], y[8]), max(x[9], y[9]), x[10]]
        self.up[b] = a


FOREST = pa.schema(
    [("kind", pa.string()), ("part", pa.int32()), ("block", pa.int32()), ("depth", pa.int64()), ("conv_id", pa.int64()), ("parent_conv_id", pa.int64()), ("side", pa.string()), ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()), ("with", pa.int64()), ("without", pa.int64()), ("along", pa.int64())]
    + [("span", pa.bool_()), ("length", pa.int64()), ("before", pa.int64()), ("after", pa.int64()), ("ends", pa.string()), ("key", pa.binary()), ("up", pa.binary()), ("first", pa.binary()), ("last", pa.binary())]
)
_FOREST_DDL = "kind string, part int, block int, depth long, conv_id long, parent_conv_id long, side string, n_convs long, n_children long, n_leaves long, `with` long, without long, along long, span boolean, length long, before long, after long, ends string, key binary, up binary, first binary, last binary"


def _block_rows(block: list, part: int, number: int, before: int | None, after: int | None) -> list[dict]:
    """Whole nodes (kind node) and the prefixes of the first and last conversation (kind spine) of a block."""
    f = Forest(block)
    top = len(f.keys) - 1
    across = shared(f.keys[0], f.keys[-1])
    names = {"L": prefix_keys(f.keys[0]), "R": prefix_keys(f.keys[-1])}
    sums = {}
    for s, words in (("L", f.words[0]), ("R", f.words[-1])):
        sums[s] = [0]
        for w in words:
            sums[s].append(sums[s][-1] + w)
    out = []
    for depth, conv_id, n, children, leaves, with_, without, up, first, last, ends in f.rows:
        side = "L" if first == 0 else "R" if last == top else None
        ids = ",".join(map(str, f.ids[ends])) if ends >= 0 else None
        row = {"part": part, "block": number, "depth": depth, "conv_id": conv_id, "n_convs": n, "n_children": children, "n_leaves": leaves, "with": with_, "without": without}
        if side:
            row |= {"kind": "spine", "side": side, "ends": ids, "along": sums[side][depth], "span": depth <= across, "length": len(f.keys[-1]) // SYMBOL, "before": before, "after": after, "key": names[side][depth], "up": names[side][depth - 1] if depth else None}
        else:
            over = f.rows[up]
            spine = over[8] == 0 or over[9] == top
            row |= {"kind": "node", "ends": hashlib.sha256(ids.encode()).hexdigest() if ids else NOTHING, "side": ("L" if over[8] == 0 else "R") if spine else None, "parent_conv_id": None if spine else over[1]}
        out.append(row)
    return out


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The forests of a sorted partition, block after block, and a row with its first and last conversation."""
    part = TaskContext.get().partitionId()

    def give(rows: list[dict]) -> Iterator[pa.RecordBatch]:
        for a in range(0, len(rows), 1 << 13):
            yield pa.RecordBatch.from_pylist(rows[a : a + (1 << 13)], schema=FOREST)

    block: list = []
    size, number, before = 0, 0, None
    begins = None
    for batch in batches:
        for conv_id, key, words in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "key", "words")), strict=True):
            if size >= BLOCK:
                after = shared(block[-1][0], key)
                yield from give(_block_rows(block, part, number, before, after))
                block, size, number, before = [], 0, number + 1, after
            begins = key if begins is None else begins
            block.append((key, conv_id, words))
            size += len(words) + 1
    if block:
        yield from give(_block_rows(block, part, number, before, None))
        yield from give([{"kind": "edge", "part": part, "first": begins, "last": block[-1][0]}])


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        part, first, last, left, right = (batch.column(c).to_pylist() for c in ("part", "first", "last", "left", "right"))
        lcp = [[-1 if x is None or y is None else shared(x, y) for x, y in zip(*pair, strict=True)] for pair in ((left, first), (last, right))]
        yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *(pa.array(x, pa.int64()) for x in lcp)], names=["part", "from_left", "to_right"])


def _united(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each prefix of rows sorted by prefix, part and block; ids of conversations that end there are hashed as they pass."""
    schema = pa.schema([("key", pa.binary()), ("up", pa.binary()), ("depth", pa.int64()), *((c, pa.int64()) for c in ("conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")), ("ends_sha256", pa.string())])
    now, digest, any_ = None, None, False
    for batch in batches:
        done = []
        for r in batch.to_pylist():
            if now is None or now["key"] != r["key"]:
                if now is not None:
                    done.append(now | {"ends_sha256": digest.hexdigest()})
                now, digest, any_ = {c: r[c] for c in schema.names if c != "ends_sha256"}, hashlib.sha256(), False
            else:
                now["conv_id"] = min(now["conv_id"], r["conv_id"])
                for c in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                    now[c] += r[c]
            if r["ends"] is not None:
                digest.update((b"," if any_ else b"") + r["ends"].encode())
                any_ = True
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=schema)
    if now is not None:
        yield pa.RecordBatch.from_pylist([now | {"ends_sha256": digest.hexdigest()}], schema=schema)


COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def prefix_trie(paths: DataFrame) -> DataFrame:
    """A row for each distinct prefix of the ``turns`` of ``paths`` (as ``paths_of`` gives them).

    conv_id is the smallest member; n_convs, n_children and n_leaves count members,
    children and childless nodes of the subtree; saved_tokens adds (n_convs - 1) times the
    words of the last turn over the subtree; ends_sha256 digests the members that end at
    the node. Conversations without turns are members of the root alone; without any
    conversation there are no rows.
    """
    rows = paths.select("conv_id", F.unhex(F.array_join("turns.sym", "")).alias("key"), F.col("turns.words").alias("words"))
    rows = rows.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    forest = written(rows.mapInArrow(_forest, _FOREST_DDL), "trie")
    # two rows a partition
    order = Window.orderBy("part")
    edges = forest.where("kind = 'edge'").select("part", "first", "last").withColumn("left", F.lag("last").over(order)).withColumn("right", F.lead("first").over(order))
    borders = edges.mapInArrow(_borders, "part int, from_left long, to_right long")
    spine = forest.where("kind = 'spine'").join(borders, "part").withColumn("before", F.coalesce("before", "from_left")).withColumn("after", F.coalesce("after", "to_right"))
    # what is shared with the left neighbour has been counted there
    along = F.max(F.when((F.col("side") == "L") & (F.col("depth") == F.col("before")), F.col("along"))).over(Window.partitionBy("part", "block"))
    before_it = F.max(F.when(F.col("side") == "L", F.col("along"))).over(Window.partitionBy("part", "block").orderBy("depth").rangeBetween(-1, -1))
    known = (F.col("side") == "L") & (F.col("depth") <= F.col("before"))
    spine = spine.withColumn("known", F.when(known, F.coalesce(along, F.lit(0)) - F.coalesce(before_it, F.lit(0))).otherwise(F.lit(0)))
    goes_on = (F.col("span") | (F.col("side") == "R")) & (F.col("length") <= F.col("after"))
    one = lambda c: c.cast("long")
    spine = spine.select(
        "key", "up", "part", "block", "side", "depth", "conv_id", "n_convs", "ends",
        (F.col("n_children") - one((F.col("side") == "L") & (F.col("depth") < F.col("before")))).alias("n_children"),
        (F.col("n_leaves") - one(goes_on)).alias("n_leaves"),
        (F.col("with") - F.col("without") + F.col("known")).alias("saved_tokens"),
    )
    spine = written(spine, "trie-borders")
    merged = spine.repartition("key").sortWithinPartitions("key", "part", "block")
    merged = written(merged.mapInArrow(_united, "key binary, up binary, depth long, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"), "trie-merged")
    names = merged.select(F.col("key"), F.col("conv_id").alias("parent_conv_id"))
    outer = merged.join(names.withColumnRenamed("key", "up"), "up", "left")
    # children of contracted nodes find them by their block, so no node has all of its children in one task
    places = spine.select("part", "block", "side", (F.col("depth") + 1).alias("depth"), "key").join(names, "key").drop("key")
    nodes = forest.where("kind = 'node'").withColumn("saved_tokens", F.col("with") - F.col("without")).withColumnRenamed("ends", "ends_sha256")
    inner = nodes.where(F.col("side").isNull()).select(*COLUMNS)
    hung = nodes.where(F.col("side").isNotNull()).drop("parent_conv_id").join(places, ["part", "block", "side", "depth"]).select(*COLUMNS)
    return outer.select(*COLUMNS).unionByName(inner).unionByName(hung)


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(with_openings(paths_of(table(spark, sf_dir, "conversations"))))


_SQL_CRC = "xor(list_reduce(list_transform(string_split(c.conv_id::VARCHAR, ''), lambda s: ascii(s)::UBIGINT), lambda crc, b: list_reduce([xor(crc, b), 0, 0, 0, 0, 0, 0, 0, 0]::UBIGINT[], lambda x, _: xor(x >> 1, (x & 1) * 3988292384)), 4294967295::UBIGINT), 4294967295)"

OP12_SQL = rf"""
WITH t AS (
  SELECT conv_id, turn, md5(strlen(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS sym, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS words
  FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, list(sym ORDER BY turn NULLS FIRST, sym) AS sym, list(words ORDER BY turn NULLS FIRST, sym) AS words FROM t GROUP BY conv_id
), h AS (SELECT c.*, (({_SQL_CRC}) % 4)::INTEGER AS h FROM c),
r AS (
  SELECT h.conv_id, list_concat(coalesce(d.sym[1:h.h], []), h.sym[h.h + 1:]) AS sym, list_concat(coalesce(d.words[1:h.h], []), h.words[h.h + 1:]) AS words
  FROM h LEFT JOIN c d ON d.conv_id = h.conv_id - h.conv_id % 20
), p AS (SELECT conv_id, sym[1:d] AS path, d AS depth, coalesce(words[d], 0) AS words, d = len(sym) AS ends FROM (SELECT *, unnest(range(len(sym) + 1)) AS d FROM r)),
n AS (
  SELECT path, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(words) AS words, sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '')) AS ends_sha256
  FROM p GROUP BY path, depth
), k AS (SELECT path[1:depth - 1] AS path, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
s AS (
  SELECT path[1:d] AS path, sum(leaf) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
  FROM (SELECT n.*, CASE WHEN k.n_children IS NULL THEN 1 ELSE 0 END AS leaf, unnest(range(n.depth + 1)) AS d FROM n LEFT JOIN k USING (path)) GROUP BY 1
)
SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0) AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN s USING (path) LEFT JOIN k USING (path) LEFT JOIN n u ON n.depth > 0 AND u.path = n.path[1:n.depth - 1]
"""
