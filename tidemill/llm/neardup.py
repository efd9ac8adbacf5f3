"""Similarity join on word shingles: a MinHash LSH forest with exact verification.

1. Every text gets the hash of its word sequence, its number of distinct shingles and a
   MinHash signature of ``trees * depth`` values. Texts with equal words are one class.
2. The ``depth`` values of each tree are a path in a trie of all classes. Tries are not
   stored: sorted signatures are one, with the length of the prefix that neighbours
   share. A subtree that may hold a wanted pair, that below the shortest useful prefix,
   is dealt as a whole; a large one in blocks.
3. Subtrees are climbed from whole paths to ever shorter prefixes: at each length, classes
   that meet there for the first time are compared by their whole signatures, unless they
   are joined already. How far a class climbs depends on it: until a partner as unlike as
   its size allows would have been met with the target recall. Only a spanning forest of
   the pairs that may reach the threshold leaves a task; its components hold every
   candidate pair.
4. Within components the shingle sets of all pairs are intersected exactly, in blocks.
   What leaves a task is the number of links of each class and a spanning forest of the
   links; the components of that are the groups.

Pairs are counted inside blocks of bounded size and never emitted. Large subtrees and
components are dealt into blocks by hash, and each pair of blocks is a task of its own.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm._spark import HEAVY, dropped, releasing, require, skew_join, table, unused, written
from tidemill.llm._text import ALNUM, LOWER, byte_values, grams, hashes, mix, passes, runs, utf8

SHINGLE = 5
THRESHOLD = 0.8
TREES = 24
DEPTH = 8
RECALL = 0.9999
#: Classes that one side of a block holds, and bytes of their shingles.
BLOCK = 512
BLOCK_BYTES = 8 << 20
#: A pair is verified if this share of the threshold or more is estimated; at 192 values
#: a pair at the threshold falls below it once in some 10^12 cases.
SLACK = 0.7

SIGNED = "doc_id long, text_key long, seq_a long, seq_b long, n_shingles long, signature binary"


def met(similarity: float, prefix: int, trees: int) -> float:
    """How likely a pair shares a prefix of that length in some tree."""
    return 1 - (1 - similarity**prefix) ** trees


def prefix_length(similarity: float, trees: int, depth: int, recall: float) -> int:
    """The prefix at which shortening may stop: the longest at which such a pair is met often enough."""
    p = depth
    while p > 1 and met(similarity, p, trees) < recall:
        p -= 1
    return p


def least_similarity(n: int, threshold: float) -> float:
    """The smallest similarity from the threshold on that a set of n shingles can have with any other."""
    share = round(threshold * 1_000_000)
    least = 1.0
    for both in range(1, n + 1):
        # the largest other set that still reaches the threshold with so many in common
        other = both * 1_000_000 // share - n + both
        if other >= both:
            least = min(least, both / (n + other - both))
    return least


@lru_cache(maxsize=8)
def prefixes_by_size(threshold: float, trees: int, depth: int, recall: float) -> np.ndarray:
    """For each number of shingles the prefix at which shortening stops; the last entry is for all larger ones."""
    return np.array([depth] + [prefix_length(least_similarity(n, threshold), trees, depth, recall) for n in range(1, 65)] + [prefix_length(threshold, trees, depth, recall)])


def shingles(texts: pa.Array, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Shingle hashes of all rows and where each row's begin; two hashes of each row's words.

    Words are runs of letters and digits, A-Z lower-cased. A text of fewer than k words
    but some has one shingle of all of them; one without words has none.
    """
    buf, offsets = utf8(texts)
    starts, ends = runs(ALNUM[buf], offsets)
    words = hashes(buf, starts, ends, byte_values(LOWER))
    first = np.searchsorted(starts, offsets)
    counts = np.diff(first)
    g = grams(words, k)
    row = np.repeat(np.arange(len(counts)), counts)
    whole = np.zeros(len(words), bool)
    if len(g):
        whole[: len(g)] = row[: len(g)] == row[k - 1 :]
    out = np.zeros(len(words), np.uint64)
    out[: len(g)] = g
    short = np.flatnonzero((counts > 0) & (counts < k))
    for i in short.tolist():
        out[first[i]] = mix(np.array([sum((int(w) * (2 * j + 3)) for j, w in enumerate(words[first[i] : first[i + 1]])) % (1 << 64)], np.uint64))[0] ^ np.uint64(counts[i])
        whole[first[i]] = True
    where = np.concatenate([[0], np.cumsum(whole)])[first]
    # sequence hashes: sums of words mixed with their places
    place = (np.arange(len(words)) - np.repeat(first[:-1], counts)).astype(np.uint64)
    sums = []
    for salt in (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03):
        c = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(words ^ mix(place * np.uint64(salt) + np.uint64(salt))))])
        sums.append(mix(c[first[1:]] - c[first[:-1]] + counts.astype(np.uint64)))
    return out[whole], where, sums[0], sums[1]


_MULTIPLIERS = (mix(np.arange(1, TREES * DEPTH + 1, dtype=np.uint64)) >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
_OFFSETS = mix(np.arange(1001, TREES * DEPTH + 1001, dtype=np.uint64)).astype(np.uint32)


def signatures(h: np.ndarray, where: np.ndarray) -> np.ndarray:
    """MinHash signatures (rows with shingles only; others are all ones), 32 bits a value."""
    n = len(where) - 1
    out = np.full((n, len(_MULTIPLIERS)), 0xFFFFFFFF, np.uint32)
    some = np.flatnonzero(np.diff(where) > 0)
    if not len(some):
        return out
    low = (h >> np.uint64(32)).astype(np.uint32)
    begins = where[some]
    for k in range(len(_MULTIPLIERS)):
        x = low ^ _OFFSETS[k]
        x *= _MULTIPLIERS[k]
        x ^= x >> np.uint32(15)
        x *= _MULTIPLIERS[-1 - k]
        out[some, k] = np.minimum.reduceat(x, begins)
    return out


def distinct(h: np.ndarray, where: np.ndarray) -> np.ndarray:
    """Number of distinct shingles of each row: the size of the set that verification intersects."""
    return np.array([len(np.unique(h[a:b])) for a, b in zip(where[:-1].tolist(), where[1:].tolist(), strict=True)], np.int64)


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        _, offsets = utf8(batch.column(1))
        for i, j in passes(offsets):
            h, where, a, b = shingles(batch.column(1).slice(i, j - i))
            s = signatures(h, where)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(i, j - i), batch.column(2).slice(i, j - i), pa.array(a.view(np.int64)), pa.array(b.view(np.int64)), pa.array(distinct(h, where)), pa.array([x.tobytes() for x in s], pa.binary())],
                names=[x.split(" ")[0] for x in SIGNED.split(", ")],
            )


class Forest:
    """Union of sets of small whole numbers."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, i: int) -> int:
        up = self.up
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return int(i)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        for i, j in zip(a.tolist(), b.tolist(), strict=True):
            i, j = self.find(i), self.find(j)
            if i != j:
                self.up[max(i, j)] = min(i, j)

    def edges(self) -> tuple[np.ndarray, np.ndarray]:
        root = np.array([self.find(i) for i in range(len(self.up))], np.int64)
        moved = np.flatnonzero(root != np.arange(len(root)))
        return moved, root[moved]


def _groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Whole groups of rows sorted by their first ``keys`` columns, many at a time."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        whole = pa.Table.from_batches(held)
        columns = [whole.column(i).to_numpy() for i in range(keys)]
        change = np.zeros(whole.num_rows, bool)
        for c in columns:
            change[1:] |= c[1:] != c[:-1]
        cut = np.flatnonzero(change)
        if len(cut):
            yield whole.slice(0, int(cut[-1]))
            held = whole.slice(int(cut[-1])).combine_chunks().to_batches()
    if held:
        yield pa.Table.from_batches(held)


def _segments(table_: pa.Table, keys: int) -> np.ndarray:
    change = np.zeros(table_.num_rows, bool)
    change[:1] = True
    for i in range(keys):
        c = table_.column(i).to_numpy()
        change[1:] |= c[1:] != c[:-1]
    return np.append(np.flatnonzero(change), table_.num_rows)


def climb(paths: np.ndarray, stop: np.ndarray, side: np.ndarray, near: Callable[[int, np.ndarray], np.ndarray]) -> np.ndarray:
    """Components of the near pairs of one subtree: for each row the smallest row of its own.

    ``paths`` are sorted rows of a trie below one prefix (what follows it), ``stop`` is how
    many of those values a row wants to share at least, ``near(i, others)`` tells which of
    the others are near row i. Rows of side 0 meet those of side 1 only, if there are any.
    From whole paths to ever shorter prefixes, rows that share one are compared unless they
    shared a longer one or are joined already.
    """
    n, depth = paths.shape
    label = np.arange(n)
    two = (side == 1).any()
    shared = np.full(n + 1, -1)
    shared[1:-1] = np.where((paths[1:] != paths[:-1]).any(1), (paths[1:] != paths[:-1]).argmax(1), depth)
    for length in range(depth, -1, -1):
        if not label.any():
            break
        edges = np.flatnonzero(shared < length)
        # rows that have shared a longer prefix are neighbours: the end of their run
        longer = np.flatnonzero(shared < length + 1)
        run_end = np.repeat(longer[1:], np.diff(longer))
        wanted = stop <= length
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            if b - a < 2 or not wanted[a:b].any():
                continue
            for i in range(a, b):
                others = np.arange(run_end[i], b)
                others = others[label[others] != label[i]]
                if two:
                    others = others[side[others] != side[i]]
                if not wanted[i]:
                    others = others[wanted[others]]
                if not len(others):
                    continue
                found = others[near(i, others)]
                if len(found):
                    all_ = np.unique(np.append(label[found], label[i]))
                    label[np.isin(label, all_)] = all_[0]
    return label


def _candidates(threshold: float, trees: int, depth: int, recall: float):
    """Spanning forests of the pairs in each block of a subtree whose estimate is near the threshold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_size = prefixes_by_size(threshold, trees, depth, recall)
        shortest = int(by_size.min())
        for group in _groups(batches, 3):
            ids = group.column("node").to_numpy()
            side = group.column("side").to_numpy()
            sizes = group.column("n_shingles").to_numpy()
            sig = np.frombuffer(b"".join(group.column("signature").to_pylist()), np.uint32).reshape(len(ids), -1)
            path = np.frombuffer(b"".join(group.column("path").to_pylist()), ">u4").reshape(len(ids), -1)
            stop = by_size[np.minimum(sizes, len(by_size) - 1)] - shortest
            least = threshold * SLACK * sig.shape[1]

            def near(i: int, others: np.ndarray) -> np.ndarray:
                fit = np.minimum(sizes[others], sizes[i]) >= threshold * np.maximum(sizes[others], sizes[i])
                fit[fit] = (sig[others[fit]] == sig[i]).sum(1) >= least
                return fit

            edge = _segments(group, 3)
            a_out, b_out = [], []
            width = np.diff(edge)
            # subtrees of two, the usual case, all at once
            two = edge[:-1][width == 2]
            if len(two):
                close = (sig[two] == sig[two + 1]).sum(1) >= least
                close &= np.minimum(sizes[two], sizes[two + 1]) >= threshold * np.maximum(sizes[two], sizes[two + 1])
                a_out.append(ids[two[close]])
                b_out.append(ids[two[close] + 1])
            for s, e in zip(edge[:-1][width > 2].tolist(), edge[1:][width > 2].tolist(), strict=True):
                label = climb(path[s:e], stop[s:e], side[s:e], lambda i, others, s=s: near(s + i, s + others))
                moved = np.flatnonzero(label != np.arange(e - s))
                a_out.append(ids[s + moved])
                b_out.append(ids[s + label[moved]])
            a = np.concatenate(a_out) if a_out else np.empty(0, np.int64)
            b = np.concatenate(b_out) if b_out else np.empty(0, np.int64)
            pairs = np.unique(np.column_stack([np.maximum(a, b), np.minimum(a, b)]), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], names=["u", "v"])

    return run


def links_in_block(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, threshold: float) -> np.ndarray:
    """Matrix of left by right: whether the Jaccard similarity reaches the threshold, exactly."""
    sizes = np.array([len(s) for s in sets])
    values, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), sizes)
    order = np.argsort(inverse, kind="stable")
    inverse, row = inverse[order], row[order]
    common = np.bincount(inverse, minlength=len(values)) > 1
    number = np.cumsum(common) - 1
    keep = common[inverse]
    inverse, row = number[inverse[keep]], row[keep]
    total = np.zeros((len(left), len(right)), np.float32)
    step = 4096
    cuts = np.searchsorted(inverse, np.arange(0, int(common.sum()) + step, step))
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        if b > a:
            grid = np.zeros((len(sets), step), np.float32)
            grid[row[a:b], inverse[a:b] % step] = 1
            total += grid[left] @ grid[right].T
    both = total.astype(np.int64)
    union = sizes[left][:, None] + sizes[right][None, :] - both
    # whole numbers: a millionth of a similarity is told apart
    return both * 1_000_000 >= union * round(threshold * 1_000_000)


def _links(threshold: float):
    """Links of each class in each block of a component, and a spanning forest of the links."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in _groups(batches, 3):
            edge = _segments(group, 3)
            node_all, side_all, weight_all = (group.column(c).to_numpy() for c in ("node", "side", "copies"))
            sets_all = group.column("shingles")
            out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
            for s, e in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
                nodes, at = np.unique(node_all[s:e], return_index=True)
                side, weight = side_all[s:e][at], weight_all[s:e][at]
                sets = [np.frombuffer(sets_all[s + i].as_buffer(), np.uint64) for i in at.tolist()]
                two = (side == 1).any() and (side == 0).any()
                left = np.flatnonzero(side == 0) if two else np.arange(len(nodes))
                right = np.flatnonzero(side == 1) if two else left
                linked = links_in_block(sets, left, right, threshold)
                if not two:
                    np.fill_diagonal(linked, False)
                n = np.zeros(len(nodes), np.int64)
                n[left] += linked @ weight[right]
                if two:
                    n[right] += linked.T @ weight[left]
                forest = Forest(len(nodes))
                i, j = np.nonzero(linked)
                forest.join(left[i], right[j])
                root = np.array([forest.find(i) for i in range(len(nodes))], np.int64)
                some = np.flatnonzero(n)
                out.append((nodes[some], nodes[root[some]], n[some]))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in out])) for i in range(3)], names=["u", "v", "n"])

    return run


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) of all nodes of ``edges`` (u, v).

    Larger neighbours of each node are joined to its smallest neighbour, then smaller
    ones, until each component is a star, which many are from the start; every round is
    written to the shared folder, and the round before deleted. ``edges`` is read once.
    """
    pairs = edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    pairs = written(pairs, "components")
    while True:
        n, tangled = _stars(pairs)
        if not tangled:
            break
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count(F.lit(1)).alias("degree"))
        # to the smallest of the neighbourhood go all larger neighbours of each node
        large = skew_join(both.where(F.col("v") > F.col("u")), low, ["u"], F.col("degree") > F.lit(2 * n * HEAVY))
        large = large.select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = written(large, "components-large")
        dropped(pairs)
        low = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("degree"))
        # and all smaller neighbours, with the node itself; there are no more pairs than before
        small = skew_join(large, low, ["u"], F.col("degree") > F.lit(n * HEAVY)).select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = small.unionByName(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        pairs = written(small, "components-small")
        dropped(large)
    found = written(pairs.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(pairs.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "components-found")
    dropped(pairs)
    return found


def _stars(pairs: DataFrame) -> tuple[int, int]:
    """Number of pairs (u, v), and of nodes that stand above others but are no root, or below more than one."""
    ends = pairs.select(F.col("u").alias("node"), F.lit(1).alias("below")).unionByName(pairs.select(F.col("v").alias("node"), F.lit(0).alias("below")))
    nodes = ends.groupBy("node").agg(F.sum("below").alias("below"), F.count(F.lit(1)).alias("ends"))
    n, tangled = nodes.agg(F.sum("below"), F.count_if((F.col("below") > 0) & (F.col("ends") > 1))).first()
    return n or 0, tangled


def _blocks(rows: DataFrame, key: str, n_blocks: Column) -> DataFrame:
    """Rows dealt into blocks by hash, once for each pair of blocks that they are in."""
    dealt = rows.withColumn("n_blocks", n_blocks.cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("n_blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1))
    pairs = dealt.withColumn("other", other)
    low, high = F.least("block", "other"), F.greatest("block", "other")
    # side 0: of the lower block, 1: of the higher, 2: of a block that meets itself
    side = F.when(F.col("block") == F.col("other"), 2).when(F.col("block") < F.col("other"), 0).otherwise(1)
    return pairs.select(F.col(key).alias("key"), low.alias("low"), high.alias("high"), side.cast("int").alias("side"), *(c for c in rows.columns if c != key))


def similarity_join(docs: DataFrame, threshold: float = THRESHOLD, recall: float = RECALL) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, copy_of, class_id, n_links, group_size.

    ``copy_of`` is the smallest doc_id of the documents with the same words, ``class_id``
    that of all documents linked to it through any chain of links, and ``n_links`` the
    number of other documents whose shingles have a Jaccard similarity of ``threshold``
    or more with this one's, copies counted each. Texts without words (null, empty) have
    no shingles and no links: each is its own class. Rows that repeat a doc_id are
    documents of their own, by their texts. Rows with a null doc_id take no part in links
    and keep null ids. An empty table gives no rows, other columns are ignored.
    """
    found, _ = _similarity_join(docs, threshold, recall)
    return found.select("doc_id", "copy_of", "class_id", "n_links", "group_size")


def _similarity_join(docs: DataFrame, threshold: float, recall: float) -> tuple[DataFrame, list[DataFrame]]:
    """The result of ``similarity_join`` with text_key and the group's first row, and the tables that it reads."""
    require(docs, ("doc_id", "text"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("text_key", F.xxhash64("text"))
    signed = written(rows.mapInArrow(releasing(_sign), SIGNED), "neardup-signed")
    live = signed.where(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0))
    # texts with equal words have equal signatures: any will do
    first = F.min(F.struct("doc_id", "text_key")).alias("first")
    classes = live.groupBy("seq_a", "seq_b").agg(first, F.count(F.lit(1)).alias("copies"), F.any_value("n_shingles").alias("n_shingles"), F.any_value("signature").alias("signature"))
    holders = written(classes.withColumn("node", F.monotonically_increasing_id()), "neardup-holders")

    shortest = int(prefixes_by_size(threshold, TREES, DEPTH, recall).min())

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            sig = np.frombuffer(b"".join(batch.column("signature").to_pylist()), np.uint32).reshape(batch.num_rows, TREES, DEPTH)
            key = np.zeros((batch.num_rows, TREES), np.uint64)
            for d in range(shortest):
                key = mix(key ^ sig[:, :, d].astype(np.uint64) + np.arange(TREES, dtype=np.uint64)[None, :] * np.uint64(1 << 32))
            rest = sig[:, :, shortest:].astype(">u4").reshape(batch.num_rows * TREES, -1)
            yield pa.RecordBatch.from_arrays([pa.array(key.reshape(-1).view(np.int64)), pa.array(np.repeat(batch.column("node").to_numpy(), TREES)), pa.array([x.tobytes() for x in rest], pa.binary())], names=["key", "node", "path"])

    entries = written(holders.select("node", "signature").mapInArrow(releasing(keys), "key long, node long, path binary"), "neardup-keys")
    subtrees = entries.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    met_ = skew_join(entries, subtrees, ["key"], F.col("size") > F.lit(entries.count() * HEAVY)).join(holders.select("node", "n_shingles", "signature"), "node")
    near = _blocks(met_, "key", F.ceil(F.col("size") / F.lit(BLOCK)))
    near = near.select("key", "low", "high", "side", "node", "n_shingles", "path", "signature")
    near = near.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high", "path")
    found = components(near.mapInArrow(releasing(_candidates(threshold, TREES, DEPTH, recall)), "u long, v long"))
    dropped(entries)
    sized = found.join(holders.select("node", "copies", "n_shingles", "first.doc_id", "first.text_key"), "node")
    totals = sized.groupBy("root").agg(F.count(F.lit(1)).alias("size"), F.sum("n_shingles").alias("shingles"))
    n_blocks = F.ceil(F.greatest(F.col("size") / F.lit(BLOCK), F.col("shingles") * 8 / F.lit(BLOCK_BYTES)))
    total = found.count()
    # the text of one row of each class is wanted; rows that repeat both id and text are one
    member = skew_join(sized.drop("n_shingles"), totals.withColumn("n_blocks", n_blocks), ["root"], F.col("size") > F.lit(total * HEAVY))
    member = written(member.select("root", "node", "copies", "doc_id", "text_key", "n_blocks"), "neardup-members")
    dropped(found)

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            text = batch.column("text")
            _, offsets = utf8(text)
            out = []
            for i, j in passes(offsets):
                h, where, _, _ = shingles(text.slice(i, j - i))
                out += [np.unique(h[a:b]).tobytes() for a, b in zip(where[:-1].tolist(), where[1:].tolist(), strict=True)]
            names = [n for n in batch.schema.names if n != "text"]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(out, pa.binary())], names=[*names, "shingles"])

    # a share of all documents decides here: a merge at every size, never a broadcast
    texts = rows.join(member.hint("merge"), ["doc_id", "text_key"])
    full = texts.select("root", "node", "n_blocks", "copies", "text").mapInArrow(releasing(sets), "root long, node long, n_blocks long, copies long, shingles binary")
    full = written(full, "neardup-sets")
    dealt = _blocks(full, "root", F.col("n_blocks")).repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    verified = dealt.select("key", "low", "high", "side", "node", "copies", "shingles").mapInArrow(releasing(_links(threshold)), "u long, v long, n long")
    verified = written(verified, "neardup-links")
    dropped(full, member)
    links = verified.groupBy("u").agg(F.sum("n").alias("others"))
    groups = components(verified.select("u", "v"))

    named = holders.select("seq_a", "seq_b", "node", "first", "copies").join(links.withColumnRenamed("u", "node"), "node", "left").join(groups, "node", "left")
    named = named.select("seq_a", "seq_b", "first", F.coalesce("root", "node").alias("root"), (F.coalesce("others", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "copies")
    whole = named.groupBy("root").agg(F.sum("copies").alias("group_size"), F.min("first").alias("group_first"), F.count(F.lit(1)).alias("classes"))
    named = skew_join(named, whole, ["root"], F.col("classes") > F.lit(holders.count() * HEAVY))
    named = written(named, "neardup-named")
    dropped(verified, groups, holders)
    lone = signed.where(F.col("doc_id").isNull() | (F.col("n_shingles") == 0))
    own = F.struct("doc_id", "text_key")
    lone = lone.select("doc_id", "text_key", F.col("doc_id").alias("copy_of"), F.col("doc_id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("group_size"), own.alias("group_first"))
    linked = skew_join(live.select("doc_id", "text_key", "seq_a", "seq_b"), named, ["seq_a", "seq_b"], F.col("copies") > F.lit(signed.count() * HEAVY))
    linked = linked.select("doc_id", "text_key", F.col("first.doc_id").alias("copy_of"), F.col("group_first.doc_id").alias("class_id"), "n_links", "group_size", "group_first")
    return linked.unionByName(lone), [signed, named]


def keep_one(docs: DataFrame) -> DataFrame:
    """``docs`` in its own columns with one document of each group: that with the smallest doc_id.

    Of rows that repeat that doc_id with texts of one group, the text whose hash is the
    smallest stays; different texts that are not near copies all stay, whatever their
    ids. Of rows that repeat both doc_id and text one stays, that whose other columns come
    first in order. Rows with a null doc_id all stay, as do texts without words under an id
    of their own. Empty tables stay empty; no column is touched, whatever its name.
    """
    found, read = _similarity_join(docs, THRESHOLD, RECALL)
    key, number = unused(docs, "text_key"), unused(docs, "doc_id")
    other = F.struct("doc_id", "text_key") != F.col("group_first")
    gone = written(found.where(F.col("doc_id").isNotNull() & other).select(F.col("doc_id").alias(number), F.col("text_key").alias(key)).distinct(), "neardup-gone")
    dropped(*read)
    keyed = docs.withColumn(number, F.col("doc_id").cast("long")).withColumn(key, F.xxhash64(F.col("text").cast("string")))
    rest = keyed.join(gone.hint("merge"), [number, key], "left_anti")
    again = rest.groupBy(number, key).count().where(F.col(number).isNotNull() & (F.col("count") > 1)).limit(1).collect()
    own = [F.col(f"`{c}`") for c in docs.columns]
    if not again:
        return rest.select(*own)
    named = rest.where(F.col(number).isNotNull())
    once = named.groupBy(number, key).agg(F.min(F.struct(*own)).alias("row")).select("row.*")
    return once.unionByName(rest.where(F.col(number).isNull()).select(*own))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similarity_join(table(spark, sf_dir, "documents"))


def brute_force(docs: list[tuple[int, str | None]], threshold: float = THRESHOLD) -> dict[int, tuple[int, int]]:
    """class_id and n_links for a few texts, by comparing all pairs of shingle sets."""
    import re

    fold = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for i, text in docs:
        w = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(fold))
        sets[i] = {tuple(w[k : k + SHINGLE]) for k in range(max(1, len(w) - SHINGLE + 1))} if w else set()
    ids = sorted(sets)
    up = {i: i for i in ids}

    def find(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    n = dict.fromkeys(ids, 0)
    for x, i in enumerate(ids):
        for j in ids[x + 1 :]:
            both = len(sets[i] & sets[j])
            if both and both * 1_000_000 >= (len(sets[i]) + len(sets[j]) - both) * round(threshold * 1_000_000):
                n[i], n[j] = n[i] + 1, n[j] + 1
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (find(i), n[i]) for i in ids}
