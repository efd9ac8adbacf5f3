"""Substring deduplication by seeds and extension.

Seeds are winnowed anchors: of the ``window - seed + 1`` runs of ``seed`` words in each
window of ``window`` words, the one that hashes lowest. Two equal windows hold the same
anchor at the same place, so documents are joined on the anchors that they share, and
every match of a document with a smaller one is extended from the anchor word by word to
the left and to the right. An extension that makes the match a window long, or longer, is
a repeat; repeats of one document that overlap are united, so what is cut is maximal.

Nothing is keyed by a single word or anchor alone: texts travel in packs of some
megabytes, and a pack sends each anchor once for each different surrounding, with the
smallest document that has it, by range of anchor. An anchor that very many packs share
(a phrase in a third of all texts) is dealt further by the words that it is extended
over: its windows are compared whole, by range of window hash. What a pack is told is one
array a range.

Words are told apart by hashes of 64 bits in anchors and windows, of 32 bits in the words
that an anchor is extended over (beside the 64 of the anchor).
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm._spark import require, table, written
from tidemill.llm._text import SOLID, byte_values, grams, hashes, mix, passes, runs, sliding_min, utf8

#: Text of a pack, at most; a longer document is a pack of its own.
PACK_BYTES = 2 << 20
#: Bits of an anchor that are told to other packs: a chance match costs some work, no result.
ANCHOR_BYTES = 6
#: Packs that share an anchor from which it is dealt by the words around it.
HOT_PACKS = 64
#: Surroundings of one anchor in one range that are compared in pairs; more are by hashes of each extension.
PAIRS = 32


class Pack:
    """Words, anchors and windows of some documents."""

    def __init__(self, ids: np.ndarray, texts: pa.Array, window: int, seed: int):
        self.ids = ids
        self.buf, self.offsets = utf8(texts)
        self.starts, self.ends = runs(SOLID[self.buf], self.offsets)
        self.words = hashes(self.buf, self.starts, self.ends, byte_values())
        self.first = np.searchsorted(self.starts, self.offsets)
        self.window, self.seed = window, seed
        self.row = np.repeat(np.arange(len(ids)), np.diff(self.first))
        n = len(self.words) - window + 1
        whole = self.row[: max(n, 0)] == self.row[window - 1 :] if n > 0 else np.empty(0, bool)
        self.at = np.flatnonzero(whole)
        # the lowest hashes are small numbers: mixed again, so that ranges of them are of one size
        self.anchor = mix(sliding_min(grams(self.words, seed), window - seed + 1)[self.at]) if n > 0 else np.empty(0, np.uint64)

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct anchors, and whether more than one document of the pack has them."""
        order = np.argsort(self.anchor, kind="stable")
        a, rows = self.anchor[order], self.row[self.at[order]]
        begins = np.flatnonzero(np.concatenate([[True], a[1:] != a[:-1]])) if len(a) else np.empty(0, np.int64)
        if not len(a):
            return a, np.empty(0, bool)
        return a[begins], np.minimum.reduceat(rows, begins) != np.maximum.reduceat(rows, begins)

    def seeds(self, elsewhere: np.ndarray) -> np.ndarray:
        """Places in ``at`` of the windows whose anchor is shared, within the pack or with others."""
        a, several = self.anchors()
        mine = several | _has(elsewhere, _short(a))
        return np.flatnonzero(mine[np.searchsorted(a, self.anchor)]) if len(a) else np.empty(0, np.int64)

    def split(self, elsewhere: np.ndarray, hot: np.ndarray) -> tuple[Surroundings, np.ndarray, np.ndarray]:
        """Of the shared anchors' windows: surroundings of the ordinary ones; places and hashes of the others' windows."""
        some = self.seeds(elsewhere)
        dealt = _has(hot, _short(self.anchor[some]))
        at = self.at[some[dealt]]
        h = grams(self.words, self.window, 1)[at] if len(at) else np.empty(0, np.uint64)
        return Surroundings(self, some[~dealt]), at, h

    def repeats(self, elsewhere: np.ndarray, hot: np.ndarray, masks: np.ndarray, smaller: np.ndarray) -> np.ndarray:
        """For each word: whether it is in a window that also starts in a smaller document."""
        around, at, h = self.split(elsewhere, hot)
        w, least = _least(h, self.ids[self.row[at]])
        gone = _has(smaller, h)
        if len(w):
            gone |= least[np.searchsorted(w, h)] < self.ids[self.row[at]]
        begins = np.concatenate([at[gone], around.repeats(masks)])
        edge = np.zeros(len(self.words) + 1, np.int64)
        np.add.at(edge, begins, 1)
        np.add.at(edge, begins + self.window, -1)
        return np.cumsum(edge[:-1]) > 0


class Surroundings:
    """Occurrences of anchors in a pack, and each different surrounding of an anchor once.

    ``anchor``, ``words`` (32-bit hashes of the words left of the anchor, the nearest
    first, then of those right of it), ``room`` (how many there are on either side) and
    ``least`` (the smallest document that has it) are of the different surroundings, by
    anchor; ``which`` is the surrounding of each occurrence.
    """

    def __init__(self, pack: Pack, some: np.ndarray):
        self.pack = pack
        reach = self.reach = pack.window - pack.seed
        # where in its window the anchor stands: the first of the lowest runs
        runs_ = mix(grams(pack.words, pack.seed)) if len(some) else np.empty(0, np.uint64)
        begin = pack.at[some]
        place = np.full(len(some), -1, np.int64)
        for o in range(reach, -1, -1):
            place[runs_[begin + o] == pack.anchor[some]] = o
        self.start, first = np.unique(begin + place, return_index=True)
        anchor = pack.anchor[some[first]] if len(some) else np.empty(0, np.uint64)
        row = pack.row[self.start]
        around = np.empty((len(self.start), 2 * reach), np.uint32)
        room = np.zeros((len(self.start), 2), np.uint8)
        key = np.empty(len(self.start), np.uint64)
        words = (pack.words >> np.uint64(32)).astype(np.uint32)
        steps = np.concatenate([-np.arange(1, reach + 1), pack.seed - 1 + np.arange(1, reach + 1)])
        for a in range(0, len(self.start), 1 << 16):
            part = slice(a, a + (1 << 16))
            at = self.start[part, None] + steps
            inside = (at >= pack.first[row[part], None]) & (at < pack.first[row[part] + 1, None])
            around[part] = np.where(inside, words[np.clip(at, 0, len(words) - 1)], 0)
            room[part, 0], room[part, 1] = inside[:, :reach].sum(1), inside[:, reach:].sum(1)
            key[part] = mix(grams_of(around[part]) ^ (room[part, 0].astype(np.uint64) << np.uint64(8)) ^ room[part, 1])
        order = np.lexsort((key, anchor))
        new = np.ones(len(order), bool)
        new[1:] = (anchor[order][1:] != anchor[order][:-1]) | (key[order][1:] != key[order][:-1])
        self.which = np.empty(len(order), np.int64)
        self.which[order] = np.cumsum(new) - 1
        self.ids = pack.ids[row]
        heads = order[new]
        self.anchor, self.words, self.room = anchor[heads], around[heads], room[heads]
        self.least = np.minimum.reduceat(self.ids[order], np.flatnonzero(new)) if len(order) else self.ids

    def repeats(self, masks: np.ndarray) -> np.ndarray:
        """First words of the windows that repeat, given for each surrounding the bits of its repeated extensions."""
        if not len(self.start):
            return np.empty(0, np.int64)
        out = []
        for left in range(self.reach + 1):
            whole = (self.room[:, 0] >= left) & (self.room[:, 1] >= self.reach - left)
            # what a smaller document of the pack has too, or what others told
            again = whole[self.which] & ((masks[self.which] >> left & 1 > 0) | (self.ids > self.least[self.which]))
            out.append(self.start[again] - left)
        return np.concatenate(out)


def grams_of(words: np.ndarray) -> np.ndarray:
    """A hash of each row."""
    out = np.zeros(len(words), np.uint64)
    for column in words.T:
        out = mix(out * np.uint64(0x9E3779B97F4A7C15) + column.astype(np.uint64))
    return out


def extended(anchor: np.ndarray, words: np.ndarray, room: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For surroundings sorted by anchor: bits ``left`` of the extensions that a smaller document has as well.

    Bit ``left`` stands for the window of ``left`` words before the anchor and the rest
    after it. Surroundings of one anchor are compared in pairs, growing the match to both
    sides; where there are very many, each extension is looked up by its hash.
    """
    n, reach = words.shape[0], words.shape[1] // 2
    masks = np.zeros(n, np.uint16)
    if not n:
        return masks
    begins = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    size = np.repeat(np.diff(np.append(begins, n)), np.diff(np.append(begins, n)))
    # windows of a match that reaches l words to the left and r to the right
    bits = np.zeros((reach + 1, reach + 1), np.uint16)
    for l_ in range(reach + 1):
        for r in range(reach + 1):
            bits[l_, r] = sum(1 << k for k in range(reach + 1) if k <= l_ and reach - k <= r)
    few = size <= PAIRS
    for shift in range(1, min(PAIRS, int(size[few].max()) if few.any() else 0)):
        i = np.flatnonzero(few[:-shift] & (anchor[:-shift] == anchor[shift:]))
        for a in range(0, len(i), 1 << 18):
            x = i[a : a + (1 << 18)]
            y = x + shift
            same = words[x] == words[y]
            grown = [np.minimum(np.logical_and.accumulate(same[:, side], axis=1).sum(1), np.minimum(room[x, k], room[y, k])) for k, side in ((0, slice(0, reach)), (1, slice(reach, None)))]
            found = bits[grown[0], grown[1]]
            later, sooner = ids[x] > ids[y], ids[x] < ids[y]
            masks[x[later]] |= found[later]
            masks[y[sooner]] |= found[sooner]
    many = np.flatnonzero(~few)
    for left in range(reach + 1) if len(many) else ():
        able = many[(room[many, 0] >= left) & (room[many, 1] >= reach - left)]
        h = mix(anchor[able] ^ grams_of(np.concatenate([words[able, :left], words[able, reach : 2 * reach - left]], axis=1)))
        w, least = _least(h, ids[able])
        masks[able[least[np.searchsorted(w, h)] < ids[able]]] |= np.uint16(1 << left) if len(w) else 0
    return masks


def _short(a: np.ndarray) -> np.ndarray:
    return a >> np.uint64(64 - 8 * ANCHOR_BYTES)


def _has(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
    if not len(sorted_):
        return np.zeros(len(x), bool)
    return sorted_[np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)] == x


def _least(h: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes and the smallest id of each."""
    order = np.argsort(h, kind="stable")
    h, ids = h[order], ids[order]
    begins = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, np.int64)
    return h[begins], np.minimum.reduceat(ids, begins) if len(h) else ids


def _narrow(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :ANCHOR_BYTES].tobytes()


def _wide(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // ANCHOR_BYTES, 8), np.uint8)
    out[:, :ANCHOR_BYTES] = np.frombuffer(data, np.uint8).reshape(-1, ANCHOR_BYTES)
    return out.view("<u8").reshape(-1)


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def _gathered(batches: Iterator[pa.RecordBatch], pack_bytes: int) -> Iterator[tuple[int, pa.Table]]:
    """Packs of consecutive rows of a scan's partition: number, rows."""
    number = TaskContext.get().partitionId() << 32
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        _, offsets = utf8(batch.column(1))
        for i, j in passes(offsets, pack_bytes):
            part = int(offsets[j] - offsets[i])
            if held and size + part > pack_bytes:
                yield number, pa.Table.from_batches(held).combine_chunks()
                number, held, size = number + 1, [], 0
            held.append(batch.slice(i, j - i))
            size += part
    if held:
        yield number, pa.Table.from_batches(held).combine_chunks()


def _packs(docs: DataFrame, pack_bytes: int) -> DataFrame:
    """Packs of rows, stored: pack, data (an Arrow stream, compressed).

    All passes read this table, so a pack's number means the same documents in each of
    them, however the scan is split when a pass is planned. Row groups hold few packs,
    as a reader takes a whole one at once.
    """

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for number, whole in _gathered(batches, pack_bytes):
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                out.write_table(whole)
            yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["pack", "data"])

    groups = {"parquet.block.size": 4 * PACK_BYTES, "parquet.page.size.row.check.min": 1, "parquet.page.size.row.check.max": 1, "parquet.enable.dictionary": "false"}
    return written(_rows(docs).mapInArrow(gather, "pack long, data binary"), "substrings-packs", "none", groups)


def _pack(whole: pa.Table, window: int, seed: int) -> Pack:
    # a null id is larger than any other
    ids = whole.column(0).combine_chunks().fill_null(np.iinfo(np.int64).max).to_numpy()
    return Pack(ids, whole.column(1), window, seed)


def _open(data: bytes, window: int, seed: int) -> tuple[Pack, pa.Table]:
    whole = pa.ipc.open_stream(data).read_all().combine_chunks()
    return _pack(whole, window, seed), whole


def _ranges(h: np.ndarray, bits: int, n: int) -> Iterator[tuple[int, slice]]:
    """The parts of sorted hashes of ``bits`` bits that fall in each of n ranges."""
    bucket = (h >> np.uint64(bits - 24)).astype(np.int64) * n >> 24
    edges = np.searchsorted(bucket, np.arange(n + 1))
    for b in np.flatnonzero(np.diff(edges)).tolist():
        yield b, slice(edges[b], edges[b + 1])


TOLD = "pack long, bucket long, told binary, apart binary"


def _told(found: DataFrame, answer: Callable) -> DataFrame:
    """Let ``answer`` see each range of hashes whole; what each pack is told, as two arrays a pack."""
    parts = found.groupBy("bucket").applyInArrow(answer, TOLD)
    return parts.groupBy("pack").applyInArrow(_joined, "pack long, told binary, apart binary")


def _joined(parts: pa.Table) -> pa.Table:
    parts = parts.sort_by("bucket")
    both = {name: pa.array([b"".join(parts.column(name).to_pylist())], pa.binary()) for name in ("told", "apart")}
    return pa.table({"pack": parts.column("pack").slice(0, 1), **both})


def _shared_anchors(found: pa.Table, hot_packs: int = HOT_PACKS) -> pa.Table:
    """Of the anchors of each pack, those that other packs have too; those that very many have come second."""
    packs = found.column("pack").to_pylist()
    arrays = [_wide(x) for x in found.column("anchors").to_pylist()]
    values, counts = np.unique(np.concatenate(arrays), return_counts=True)
    shared, hot = values[counts > 1], values[counts > hot_packs]
    told = [(_narrow(a[_has(shared, a)]), _narrow(a[_has(hot, a)])) for a in arrays]
    return _answers(found, [(p, *t) for p, t in zip(packs, told, strict=True) if t[0]])


def _extensions(found: pa.Table) -> pa.Table:
    """Bits of the repeated extensions of each pack's surroundings, in their order."""
    packs = found.column("pack").to_pylist()
    parts = [_surroundings(r) for r in found.select(["anchors", "words", "room", "ids", "least"]).to_pylist()]
    anchor, words, room, ids = (np.concatenate(x) for x in zip(*parts, strict=True))
    order = np.argsort(anchor, kind="stable")
    masks = np.empty(len(order), np.uint16)
    masks[order] = extended(anchor[order], words[order], room[order], ids[order])
    cuts = np.cumsum([len(p[0]) for p in parts])[:-1]
    return _answers(found, [(p, m.astype("<u2").tobytes(), b"") for p, m in zip(packs, np.split(masks, cuts), strict=True)])


def _surroundings(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    anchor = np.frombuffer(row["anchors"], "<u8")
    room = np.frombuffer(row["room"], np.uint8).reshape(len(anchor), 2)
    return anchor, np.frombuffer(row["words"], "<u4").reshape(len(anchor), -1), room, _ids_of(row["ids"], row["least"])


def _ids_of(ids: bytes, least: bytes) -> np.ndarray:
    return np.frombuffer(ids, "<i8")[np.frombuffer(least, "<u2" if len(ids) <= 8 << 16 else "<u4")]


def _smaller_windows(found: pa.Table) -> pa.Table:
    """Of the windows of each pack, those that start in a smaller document of another pack."""
    packs = found.column("pack").to_pylist()
    arrays = [np.frombuffer(x, "<u8") for x in found.column("anchors").to_pylist()]
    ids = [_ids_of(i, x) for i, x in zip(found.column("ids").to_pylist(), found.column("least").to_pylist(), strict=True)]
    w, least = _least(np.concatenate(arrays), np.concatenate(ids))
    told = [a[least[np.searchsorted(w, a)] < i].astype("<u8").tobytes() for a, i in zip(arrays, ids, strict=True)]
    return _answers(found, [(p, b"", t) for p, t in zip(packs, told, strict=True) if t])


def _answers(found: pa.Table, rows: list[tuple[int, bytes, bytes]]) -> pa.Table:
    bucket = found.column("bucket")[0].as_py()
    return pa.table({"pack": pa.array([r[0] for r in rows], pa.int64()), "bucket": pa.array([bucket] * len(rows), pa.int64()), "told": pa.array([r[1] for r in rows], pa.binary()), "apart": pa.array([r[2] for r in rows], pa.binary())})


def _either(found: pa.Table) -> pa.Table:
    """A range of anchors with their surroundings, or one of windows: windows have ranges below zero."""
    return (_extensions if found.column("bucket")[0].as_py() >= 0 else _smaller_windows)(found)


def repeated_substrings(docs: DataFrame, window: int = 13, seed: int = 5, buckets: int | None = None, with_text: bool = True, pack_bytes: int = PACK_BYTES, hot_packs: int = HOT_PACKS) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and ``kept``) of each row of ``docs`` (doc_id, text).

    A word goes if it is in a window of ``window`` words whose words also start in a
    document with a smaller doc_id; windows are judged on the input. Words are what
    space and the control characters 9 to 13 separate; kept words are joined by one
    space. Null texts have no words, as have empty ones. Rows that repeat a doc_id are
    one document as far as "smaller" goes; a null doc_id is larger than any other. An
    empty table gives no rows; other columns are ignored.
    """
    require(docs, ("doc_id", "text"))
    if not 0 < seed <= window:
        raise ValueError("a seed is at least a word and at most a window long")
    if window - seed > 15:
        raise ValueError("a window is at most 15 words longer than its seed")
    spark = docs.sparkSession
    n = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    packs = _packs(docs, pack_bytes)

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column("pack").to_pylist(), batch.column("data"), strict=True):
                a, _ = _open(data.as_buffer(), window, seed)[0].anchors()
                a = np.unique(_short(a))
                out = [(b, _narrow(a[s])) for b, s in _ranges(a, 8 * ANCHOR_BYTES, n)]
                yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in out], pa.int64()), pa.array([number] * len(out), pa.int64()), pa.array([x for _, x in out], pa.binary())], names=["bucket", "pack", "anchors"])

    def share(found: pa.Table) -> pa.Table:
        return _shared_anchors(found, hot_packs)

    found = packs.mapInArrow(anchors, "bucket long, pack long, anchors binary")
    shared = written(_told(found, share), "substrings-anchors", "none")

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data, told, apart in zip(batch.column("pack").to_pylist(), batch.column("data"), batch.column("told").to_pylist(), batch.column("apart").to_pylist(), strict=True):
                pack, _ = _open(data.as_buffer(), window, seed)
                around, at, h = pack.split(_wide(told or b""), _wide(apart or b""))
                # the smallest id of the documents, as its place among the pack's sorted ids
                ids, place = np.unique(pack.ids, return_inverse=True)
                out = [(b, around.anchor[s].astype("<u8").tobytes(), np.ascontiguousarray(around.words[s], "<u4").tobytes(), around.room[s].tobytes(), *_own_ids(ids, np.searchsorted(ids, around.least[s]))) for b, s in _ranges(around.anchor, 64, n)]
                w, least = _least(h, place[pack.row[at]])
                out += [(b - n, w[s].astype("<u8").tobytes(), b"", b"", *_own_ids(ids, least[s])) for b, s in _ranges(w, 64, n)]
                columns = [[x[i] for x in out] for i in range(6)]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array([number] * len(out), pa.int64()), *(pa.array(c, pa.binary()) for c in columns[1:])], names=["bucket", "pack", "anchors", "words", "room", "ids", "least"])

    seen = packs.join(shared, "pack", "left").mapInArrow(ranges, "bucket long, pack long, anchors binary, words binary, room binary, ids binary, least binary")
    answers = written(_told(seen, _either).withColumnsRenamed({"told": "masks", "apart": "windows"}), "substrings-answers", "none")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, *told in zip(batch.column("data"), *(batch.column(c).to_pylist() for c in ("told", "apart", "masks", "windows")), strict=True):
                pack, whole = _open(data.as_buffer(), window, seed)
                elsewhere, hot, masks, small = (x or b"" for x in told)
                gone = pack.repeats(_wide(elsewhere), _wide(hot), np.frombuffer(masks, "<u2"), np.sort(np.frombuffer(small, "<u8")))
                texts = _kept(pack, ~gone)
                counts = np.diff(pack.first)
                sums = np.concatenate([[0], np.cumsum(gone)])
                columns = [whole.column(0).combine_chunks(), pa.array(counts.astype(np.int64)), pa.array((sums[pack.first[1:]] - sums[pack.first[:-1]]).astype(np.int64)), pa.array([hashlib.sha256(t).hexdigest() for t in texts])]
                if with_text:
                    columns.append(pa.array(texts, pa.binary()).cast(pa.string()))
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"][: len(columns)])

    joined = packs.join(shared, "pack", "left").join(answers, "pack", "left")
    return joined.select("data", "told", "apart", "masks", "windows").mapInArrow(keep, "doc_id long, n_words long, n_removed long, kept_sha256 string" + (", kept string" if with_text else ""))


def _own_ids(ids: np.ndarray, place: np.ndarray) -> tuple[bytes, bytes]:
    """The ids that a range needs, and the places among them."""
    own, at = np.unique(place, return_inverse=True)
    return ids[own].astype("<i8").tobytes(), at.astype("<u2" if len(own) <= 1 << 16 else "<u4").tobytes()


def _kept(pack: Pack, keep: np.ndarray) -> list[memoryview]:
    """Kept words of each row, joined by one space."""
    starts, ends, rows = pack.starts[keep], pack.ends[keep], pack.row[keep]
    edge = np.zeros(len(pack.buf) + 1, np.int8)
    edge[starts] += 1
    edge[ends] -= 1
    take = np.cumsum(edge[:-1], dtype=np.int8).astype(bool)
    out = pack.buf.copy()
    # the byte after a word that another kept word of its row follows becomes a space
    inner = ends[:-1][rows[1:] == rows[:-1]] if len(rows) else ends
    out[inner] = 32
    take[inner] = True
    sums = np.concatenate([[0], np.cumsum(take)])[pack.offsets]
    data = memoryview(out[take].tobytes())
    return [data[a:b] for a, b in zip(sums[:-1].tolist(), sums[1:].tolist(), strict=True)]


def op8_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_substrings(table(spark, sf_dir, "documents"), with_text=False)


def brute_force(docs: list[tuple[int, str | None]], window: int = 13) -> dict[int, tuple[int, int, str]]:
    """The same results for a few texts, by a table of all windows."""
    import re

    words = {i: re.findall("[^\x20\x09-\x0d]+", t or "") for i, t in docs}
    least: dict[tuple[str, ...], int] = {}
    for i, w in words.items():
        for k in range(len(w) - window + 1):
            key = tuple(w[k : k + window])
            least[key] = min(i, least.get(key, i))
    out = {}
    for i, w in words.items():
        gone = {j for k in range(len(w) - window + 1) if least[tuple(w[k : k + window])] < i for j in range(k, k + window)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        out[i] = (len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out
