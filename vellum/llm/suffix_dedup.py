"""Suffix-array dedup: bytes covered by a string of ``LENGTH`` bytes that also starts in a document with a smaller id.

Texts are staged once as blocks of a few megabytes, a row each, in shared storage. Every window of ``LENGTH`` bytes has an
anchor, the ``GRAM``-byte string in it with the least hash, so equal windows have equal anchors. Three exchanges follow,
in which blocks ask and shards of the anchors' hash space answer; texts stay where they are.

1. A block asks which of its distinct anchors occur in another document. A bit per anchor comes back.
2. For these anchors it asks about contexts: the bytes of a run of windows that share the anchor, once for each distinct
   context. A shard puts its contexts together, builds a suffix array by induced sorting and the permuted common
   prefixes, takes the windows with a common prefix of ``LENGTH`` as one group, and answers one bit per window: whether a
   document smaller than all of the block's with that context holds it.
3. The block marks the windows, by these bits and by the order of its own documents, and removes what they cover.

An anchor that ``HOT_DOCS`` documents hold or more is not asked about as a whole: its windows are contexts of their own
and go to shards by their own hash, so no shard collects the surroundings of a common passage. A run of more than ``RUN``
windows is several contexts, so a text of one letter is a few contexts that are equal. Shards are as many as a multiple
of the shuffle partitions and are dealt to them in turn; they work through their contexts in batches of about
``BATCH_BYTES``. Answers lie in shared storage in a folder for each partition of blocks, so a task reads its own.

A null text is empty. Rows that share an id do not remove each other's bytes. A null id is larger than every other, and
nulls are equal. Equal contexts of a block are found by hash and confirmed on their bytes; shards compare bytes.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.dataset as pads
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import common
from vellum.llm.crf import numbers
from vellum.llm.rolling import BYTE_HASH, _ODD, _ODD_INVERSE, _powers, mix
from vellum.llm.storage import open_fs
from vellum.llm.suffix_array import permuted_prefixes, suffix_array

LENGTH = 50
GRAM = 20
#: Grams of a window.
SPAN = LENGTH - GRAM + 1
BLOCK_BYTES = 2 << 20
BATCH_BYTES = 1 << 19
HOT_DOCS = 10_000
#: Windows of a context.
RUN = 256
#: Shards of each shuffle partition in the first two exchanges.
SHARDS = 4
NULL_ID = (1 << 63) - 1


def _least_in_windows(h: np.ndarray, w: int) -> np.ndarray:
    m, width = h, 1
    while width * 2 <= w:
        m, width = np.minimum(m[:-width], m[width:]), width * 2
    return m if width == w else np.minimum(m[: len(m) - (w - width)], m[w - width :])


class Texts:
    """A block's texts and the runs of windows that share an anchor."""

    def __init__(self, data: bytes, lengths: list[int], ids: list[int | None]):
        self.buf = np.frombuffer(data, np.uint8)
        self.lengths = np.array(lengths, np.int64)
        self.ends = np.cumsum(self.lengths)
        self.ids = np.array([NULL_ID if i is None else i for i in ids], np.int64)
        n = len(self.buf)
        self.sums = np.concatenate(([np.uint64(0)], np.cumsum(BYTE_HASH[self.buf] * _powers(_ODD, n)))) if n else np.zeros(1, np.uint64)
        self.back = _powers(_ODD_INVERSE, n + 1)
        if n < LENGTH:
            self.start = self.stop = self.doc = np.zeros(0, np.int64)
            self.anchor = np.zeros(0, np.uint64)
            return
        grams = mix((self.sums[GRAM:] - self.sums[:-GRAM]) * self.back[: n - GRAM + 1])
        least = _least_in_windows(grams, SPAN)  # one per window start
        fits = np.zeros(len(least), bool)
        begins = self.ends - self.lengths
        last = self.ends - LENGTH + 1
        for a, b in zip(begins[last > begins], last[last > begins], strict=True):
            fits[a:b] = True
        new = np.empty(len(least), bool)
        new[0], new[1:] = True, least[1:] != least[:-1]
        new[begins[begins < len(least)]] = True
        self.start = np.flatnonzero(new & fits)
        self.doc = np.searchsorted(self.ends, self.start, side="right")
        following = np.append(self.start[1:], len(least))
        self.stop = np.minimum(following, last[self.doc])
        parts = -(-(self.stop - self.start) // RUN)
        if parts.max(initial=1) > 1:
            which = np.repeat(np.arange(len(parts)), parts)
            self.start = self.start[which] + RUN * _ranges(np.zeros(len(parts), np.int64), parts)
            self.stop = np.minimum(self.start + RUN, self.stop[which])
            self.doc = self.doc[which]
        self.anchor = mix(least[self.start])  # least hashes lie low; mixed, they spread over the shards

    def hashes(self, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
        """Hash of the bytes of each range, and its length."""
        return mix(mix((self.sums[stop] - self.sums[start]) * self.back[start]) + (stop - start).astype(np.uint64))

    def equal(self, start: np.ndarray, stop: np.ndarray, like: np.ndarray) -> bool:
        """Whether every range holds the bytes of the range that it is taken to be like."""
        other = np.flatnonzero(like != np.arange(len(like)))
        for k in range(0, len(other), 1 << 14):
            a = other[k : k + (1 << 14)]
            b = like[a]
            n = stop[a] - start[a]
            if (n != stop[b] - start[b]).any() or (self.buf[_ranges(start[a], n)] != self.buf[_ranges(start[b], n)]).any():
                return False
        return True

    def anchors(self) -> tuple[np.ndarray, np.ndarray]:
        """The distinct anchors, ascending, and the number of documents of the block that hold each."""
        order = np.lexsort((self.doc, self.anchor))
        a, d = self.anchor[order], self.doc[order]
        once = np.concatenate(([True], (a[1:] != a[:-1]) | (self.ids[d[1:]] != self.ids[d[:-1]]))) if len(a) else np.zeros(0, bool)
        return np.unique(a[once], return_counts=True)


def shard_of(h: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of the hash space."""
    return ((h >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


def _present(shard: np.ndarray):
    """``(shard, begin, end)`` of each shard that occurs; ascending."""
    names, begin = np.unique(shard, return_index=True)
    return zip(names.tolist(), begin.tolist(), [*begin[1:].tolist(), len(shard)], strict=True)


class Contexts:
    """The distinct contexts of a block: what it asks, and where each run of windows finds its answer."""

    def __init__(self, t: Texts, common_: np.ndarray, hot: np.ndarray, shards: int):
        """``common_`` and ``hot``: sorted anchors."""
        member = lambda x: x[np.minimum(np.searchsorted(x, t.anchor), len(x) - 1)] == t.anchor if len(x) else np.zeros(len(t.anchor), bool)
        cold = np.flatnonzero(member(common_) & ~member(hot))
        warm = np.flatnonzero(member(hot))
        n_warm = t.stop[warm] - t.start[warm]
        each = np.repeat(t.start[warm], n_warm) + np.arange(n_warm.sum()) - np.repeat(np.cumsum(n_warm) - n_warm, n_warm)
        start = np.concatenate((t.start[cold], each))
        self.windows = np.concatenate((t.stop[cold] - t.start[cold], np.ones(len(each), np.int64)))
        doc = np.concatenate((t.doc[cold], np.repeat(t.doc[warm], n_warm)))
        stop = start + self.windows + LENGTH - 1
        content = t.hashes(start, stop)
        route = np.concatenate((t.anchor[cold], content[len(cold) :]))
        distinct = lambda c: np.unique(np.stack((route, c), axis=1).view([("r", "<u8"), ("c", "<u8")]).ravel(), return_index=True, return_inverse=True)
        keys, first, self.which = distinct(content)
        if not t.equal(start, stop, first[self.which]):  # hashes agree by chance or design: tell contexts apart by their bytes
            keys, first, self.which = distinct(numbers([t.buf[a:b].tobytes() for a, b in zip(start, stop, strict=True)]).astype(np.uint64))
        self.start, self.id = start, t.ids[doc]
        self.least = np.full(len(keys), NULL_ID, np.int64)
        np.minimum.at(self.least, self.which, self.id)
        self.route, self.size = keys["r"], self.windows[first]
        self.first, self.stop_first = start[first], stop[first]
        self.shard = shard_of(self.route, shards)
        self.offset = np.concatenate(([0], np.cumsum(self.size)))  # of each context's bits in the answer

    def ask(self, t: Texts):
        """``(shard, routes, sizes, least ids, bytes)`` per shard, contexts in the order of their keys."""
        for s, a, b in _present(self.shard):
            at = _ranges(self.first[a:b], self.stop_first[a:b] - self.first[a:b])
            yield s, self.route[a:b].tobytes(), self.size[a:b].astype("<u4").tobytes(), self.least[a:b].tobytes(), t.buf[at].tobytes()


def smaller_elsewhere(route: np.ndarray, size: np.ndarray, least: np.ndarray, data: np.ndarray) -> np.ndarray:
    """For every window of every context whether a context with a smaller least id holds the same window.

    Equal contexts are one, with the least of their ids. Where a route has several different ones, they lie together in
    a batch, whose suffix array finds the equal windows; the windows of a route's only context stand nowhere else.
    """
    at = np.concatenate(([0], np.cumsum(size + LENGTH - 1))).tolist()
    blob = data.tobytes()
    index: dict[bytes, int] = {}
    same = np.array([index.setdefault(blob[a:b], len(index)) for a, b in zip(at, at[1:], strict=False)], np.int64)
    lowest = np.full(len(index), NULL_ID, np.int64)
    np.minimum.at(lowest, same, least)
    one = np.unique(same, return_index=True)[1]
    texts, n_windows, of = list(index), size[one], route[one]
    bit = np.concatenate(([0], np.cumsum(n_windows)))
    smallest = np.repeat(lowest, n_windows)  # of each window of each different context
    order = np.argsort(of, kind="stable")
    new = np.flatnonzero(np.concatenate(([True], of[order][1:] != of[order][:-1]))) if len(of) else np.zeros(0, np.int64)
    batch, held = [], 0
    for a, b in zip(new, np.append(new[1:], len(order)), strict=True):
        if b - a > 1:
            group = order[a:b]
            batch.append(group)
            held += int((n_windows[group] + LENGTH - 1).sum())
            if held > BATCH_BYTES:
                _batch(np.concatenate(batch), texts, n_windows, lowest, bit, smallest)
                batch, held = [], 0
    if batch:
        _batch(np.concatenate(batch), texts, n_windows, lowest, bit, smallest)
    return smallest[_ranges(bit[same], size)] < np.repeat(least, size)


def _ranges(start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The numbers ``start .. start + n - 1`` of all pairs, one after the other."""
    return np.repeat(start - np.concatenate(([0], np.cumsum(n)[:-1])), n) + np.arange(n.sum()) if len(n) else np.zeros(0, np.int64)


def _batch(which: np.ndarray, texts: list[bytes], n_windows: np.ndarray, lowest: np.ndarray, bit: np.ndarray, smallest: np.ndarray) -> None:
    """Lower ``smallest`` for the windows of these contexts to the least id of all that hold an equal window."""
    text = np.frombuffer(b"".join([texts[k] for k in which.tolist()]), np.uint8)
    n = n_windows[which]
    place = np.concatenate(([0], np.cumsum(n + LENGTH - 1)))[:-1]
    starts = _ranges(place, n)
    window = np.full(len(text), -1, np.int64)
    window[starts] = np.arange(len(starts))
    order = suffix_array(text, LENGTH)
    order = order[window[order] >= 0]  # windows; other suffixes run into the next context
    heads = np.flatnonzero(permuted_prefixes(text, order, LENGTH)[order] < LENGTH)
    heads = np.unique(np.append(0, heads))
    mine = window[order]
    group = np.zeros(len(order), np.int64)
    group[heads[1:]] = 1
    owner = np.repeat(lowest[which], n)
    out = np.empty(len(starts), np.int64)
    out[mine] = np.minimum.reduceat(owner[mine], heads)[np.cumsum(group)]
    smallest[_ranges(bit[which], n)] = out


def coverage(n: int, starts: np.ndarray) -> np.ndarray:
    """The bytes that the windows at ``starts`` cover."""
    edge = np.bincount(starts, minlength=n + LENGTH + 1)[: n + 1] - np.bincount(starts + LENGTH, minlength=n + LENGTH + 1)[: n + 1]
    return np.cumsum(edge)[:n] > 0


#: Bits of a block's number below those of its partition.
SEQ_BITS = 24


@functools.lru_cache(maxsize=2)
def _part_answers(path: str, part: int) -> pa.Table | None:
    fs, name = open_fs(f"{path}/part={part}")
    if fs.get_file_info(name).type == pafs.FileType.NotFound:
        return None
    return pads.dataset(name, filesystem=fs, format="parquet", exclude_invalid_files=True).to_table()


def read_answers(path: str, block: int, columns: list[str]) -> list[tuple]:
    """The answers to a block, from the file of its partition; tasks go through the blocks of a partition in turn."""
    found = _part_answers(path, block >> SEQ_BITS)
    if found is None:
        return []
    return list(zip(*(found.filter(pc.equal(found.column("block"), block)).column(c).to_pylist() for c in columns), strict=True))


def stage(docs: DataFrame, doc_id: str, text: str, shards: int, rest: list[str]) -> DataFrame:
    """A row per block: ids, lengths, text, other columns as an Arrow stream, and the first question (anchors of each
    shard, and how many documents hold those that several do)."""
    schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("data", pa.binary()), ("rest", pa.binary()), ("asked", pa.list_(pa.struct([("shard", pa.int32()), ("anchors", pa.binary()), ("docs", pa.binary())])))])

    def run(batches):
        part, seq = TaskContext.get().partitionId(), 0
        held: list[pa.RecordBatch] = []

        def flush():
            nonlocal seq
            b = pa.Table.from_batches(held).combine_chunks()
            texts = [x.encode("utf-8", "surrogatepass") if x else b"" for x in b.column(1).to_pylist()]
            ids, lengths, data = b.column(0).to_pylist(), [len(x) for x in texts], b"".join(texts)
            anchors, docs_ = Texts(data, lengths, ids).anchors()
            asked = [{"shard": s, "anchors": anchors[a:e].astype("<u4").tobytes(), "docs": np.minimum(docs_[a:e], 65535).astype("<u2").tobytes()} for s, a, e in _present(shard_of(anchors, shards))]
            sink = pa.BufferOutputStream()
            with pa.ipc.new_stream(sink, b.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as w:
                if rest:
                    w.write_table(b)
            row = {"block": part << SEQ_BITS | seq, "ids": ids, "lengths": lengths, "data": data, "rest": sink.getvalue().to_pybytes() if rest else None, "asked": asked}
            seq += 1
            held.clear()
            return pa.RecordBatch.from_pylist([row], schema)

        size = 0
        for b in batches:
            for piece in common.slices(b, common.byte_sizes(b.column(1)), BLOCK_BYTES // 4):
                held.append(piece)
                size += sum(common.byte_sizes(piece.column(1)))
                if size >= BLOCK_BYTES:
                    yield flush()
                    size = 0
        if held:
            yield flush()

    rows = docs.select(F.col(doc_id).cast("long").alias("__id"), F.col(text).cast("string").alias("__text"), *rest)
    return rows.mapInArrow(run, "block long, ids array<long>, lengths array<long>, data binary, rest binary, asked array<struct<shard:int,anchors:binary,docs:binary>>")


def _mark_anchors(group: pa.Table) -> pa.Table:
    """The first answer: which of the anchors that blocks asked about are in more than one document, and which are hot."""
    parts = [np.frombuffer(x, "<u4") for x in group.column("anchors").to_pylist()]
    docs = np.concatenate([np.frombuffer(x, "<u2") for x in group.column("docs").to_pylist()]).astype(np.int64)
    names, which = np.unique(np.concatenate(parts), return_inverse=True)
    total = np.bincount(which, docs, minlength=len(names))
    cuts = np.cumsum([len(p) for p in parts])[:-1]
    bits = lambda x: [np.packbits(y).tobytes() for y in np.split(x[which], cuts)]
    return pa.table({"block": group.column("block"), "shard": group.column("shard"), "several": pa.array(bits(total > 1), pa.binary()), "hot": pa.array(bits(total >= HOT_DOCS), pa.binary())})


def _mark_windows(group: pa.Table) -> pa.Table:
    """The second answer: a bit per window of each block's contexts."""
    join = lambda name, kind: np.concatenate([np.frombuffer(x, kind) for x in group.column(name).to_pylist()])
    route, size, least, data = join("routes", "<u8"), join("sizes", "<u4").astype(np.int64), join("least", "<i8"), join("data", np.uint8)
    bits = smaller_elsewhere(route, size, least, data)
    n_windows = [int(np.frombuffer(x, "<u4").sum()) for x in group.column("sizes").to_pylist()]
    return pa.table({"block": group.column("block"), "shard": group.column("shard"), "bits": pa.array([np.packbits(y).tobytes() for y in np.split(bits, np.cumsum(n_windows)[:-1])], pa.binary())})


def _bits(data: bytes, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=n).astype(bool)


def _contexts(row: dict, answers: str, shards: int) -> tuple[Texts, Contexts]:
    """A block's texts and contexts, from the first answer. Both later passes make the same ones."""
    t = Texts(row["data"], row["lengths"], row["ids"])
    anchors = np.unique(t.anchor)
    several, hot = np.zeros(len(anchors), bool), np.zeros(len(anchors), bool)
    cuts = np.searchsorted(shard_of(anchors, shards), np.arange(shards + 1))
    for s, a, b in read_answers(answers, row["block"], ["shard", "several", "hot"]):
        several[cuts[s] : cuts[s + 1]], hot[cuts[s] : cuts[s + 1]] = _bits(a, cuts[s + 1] - cuts[s]), _bits(b, cuts[s + 1] - cuts[s])
    return t, Contexts(t, anchors[several], anchors[hot], shards)


def _answered(asked: DataFrame, answer, kinds: str, path: str) -> str:
    """Give each shard's questions to ``answer``, shards dealt to the partitions in turn, and write what it says by the
    partitions of the blocks that asked."""
    n = common.shuffle_partitions(asked.sparkSession)

    def run(batches):
        held, key = [], None
        for b in batches:
            shards = b.column("shard").to_numpy()
            cuts = [0, *(np.flatnonzero(shards[1:] != shards[:-1]) + 1).tolist(), b.num_rows]
            for p, q in zip(cuts, cuts[1:], strict=False):
                if held and shards[p] != key:
                    yield from answer(pa.Table.from_batches(held)).to_batches()
                    held = []
                key = shards[p]
                held.append(b.slice(p, q - p))
        if held:
            yield from answer(pa.Table.from_batches(held)).to_batches()

    placed = asked.repartitionById(n, F.col("shard") % n).sortWithinPartitions("shard")
    parts = placed.mapInArrow(run, kinds).withColumn("part", F.shiftright("block", SEQ_BITS))
    parts.repartition(n, "part").sortWithinPartitions("part", "block").write.partitionBy("part").option("compression", "zstd").parquet(path)
    return path


def remove_repeats(docs: DataFrame, emit, kinds: str, doc_id: str = "doc_id", text: str = "text", rest: tuple[str, ...] = ()) -> DataFrame:
    """Rows made by ``emit(ids, texts, masks, rest)`` from each block: ``masks`` has the removed bytes of each text and
    ``rest`` the block's rows as an Arrow table, where other columns were asked for."""
    spark = docs.sparkSession
    path = common.workdir(spark, "repeats")
    shards = SHARDS * common.shuffle_partitions(spark)
    with common.settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="500", spark__sql__parquet__compression__codec="zstd"):
        blocks = common.table(stage(docs, doc_id, text, shards, list(rest)), f"{path}/blocks")
    by_bytes = {"spark__sql__execution__arrow__maxRecordsPerBatch": "2000", "spark__sql__execution__arrow__maxBytesPerBatch": str(1 << 20), "spark__sql__parquet__columnarReaderBatchSize": "2"}
    with common.settings(spark, **by_bytes):
        asked = blocks.select("block", F.explode("asked").alias("q")).select("block", "q.*")
        answers = _answered(asked, _mark_anchors, "block long, shard int, several binary, hot binary", f"{path}/anchors")

    def ask(batches):
        for b in batches:
            for row in b.to_pylist():
                t, c = _contexts(row, answers, shards)
                for s, *parts in c.ask(t):
                    yield pa.RecordBatch.from_arrays([pa.array([row["block"]]), pa.array([s], pa.int32()), *[pa.array([x], pa.binary()) for x in parts]], names=["block", "shard", "routes", "sizes", "least", "data"])

    with common.settings(spark, **by_bytes):
        asked = blocks.select("block", "ids", "lengths", "data").mapInArrow(ask, "block long, shard int, routes binary, sizes binary, least binary, data binary")
        bits = _answered(asked, _mark_windows, "block long, shard int, bits binary", f"{path}/windows")

    def mark(batches):
        for b in batches:
            for row in b.to_pylist():
                t, c = _contexts(row, answers, shards)
                smaller = np.zeros(c.offset[-1], bool)
                cuts = c.offset[np.searchsorted(c.shard, np.arange(shards + 1))]
                for s, x in read_answers(bits, row["block"], ["shard", "bits"]):
                    smaller[cuts[s] : cuts[s + 1]] = _bits(x, cuts[s + 1] - cuts[s])
                window = _ranges(c.start, c.windows)
                marked = smaller[_ranges(c.offset[c.which], c.windows)] | np.repeat(c.id > c.least[c.which], c.windows)
                gone = coverage(len(t.buf), window[marked])
                begins = t.ends - t.lengths
                table = pa.ipc.open_stream(row["rest"]).read_all() if rest else None
                yield from emit(row["ids"], [t.buf[a:e] for a, e in zip(begins, t.ends, strict=True)], [gone[a:e] for a, e in zip(begins, t.ends, strict=True)], table)

    with common.settings(spark, **by_bytes):
        out = common.table(blocks.select("block", "ids", "lengths", "data", "rest").mapInArrow(mark, kinds), f"{path}/out")
    common.remove(spark, f"{path}/blocks", answers, bits)
    return out


def _digest(ids, texts, masks, _rest):
    kept = [t[~m] for t, m in zip(texts, masks, strict=True)]
    spans = [int((m & ~np.concatenate(([False], m[:-1]))).sum()) for m in masks]
    yield pa.RecordBatch.from_arrays([
        pa.array(ids, pa.int64()), pa.array([len(t) for t in texts], pa.int64()), pa.array([int(m.sum()) for m in masks], pa.int64()), pa.array(spans, pa.int64()),
        pa.array([hashlib.sha256(k.tobytes()).hexdigest() for k in kept]),
    ], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` per row of ``docs``."""
    return remove_repeats(docs, _digest, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string", doc_id, text)


def cleaned(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the repeated bytes taken out of their texts, all other columns as they were. A character of which
    only a part is left goes with it; a null text stays null."""
    names = docs.columns
    at = names.index(text)

    def emit(_ids, texts, masks, table):
        was = table.column(1).to_pylist()
        new = [None if w is None else t[~m].tobytes().decode("utf-8", "ignore") if m.any() else w for w, t, m in zip(was, texts, masks, strict=True)]
        columns = [c for name, c in zip(table.column_names, table.columns, strict=True)][2:]
        columns.insert(at, pa.array(new, pa.string()))
        yield from pa.Table.from_arrays(columns, names=names).to_batches()

    rest = tuple(c for c in names if c != text)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return remove_repeats(docs, emit, kinds, doc_id, text, rest)


def op6_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """All ``documents``: matches of 50 bytes."""
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Windows of 50 bytes as hexadecimal digits, cut from pieces of a text of 305 bytes, which start 256 apart.
OP6_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
part AS (SELECT r, doc_id, a, substr(h, 2 * a + 1, 2 * 305) AS h FROM (SELECT r, doc_id, h, unnest(range(0, CAST(length(h) // 2 - 49 AS BIGINT), 256)) AS a FROM d)),
w AS (SELECT r, doc_id, a + i AS i, substr(h, 2 * i + 1, 100) AS w FROM (SELECT r, doc_id, a, h, unnest(range(CAST(length(h) // 2 - 49 AS BIGINT))) AS i FROM part)),
f AS (SELECT w, min(doc_id) AS least FROM w GROUP BY w HAVING count(*) > 1),
m AS (SELECT r, i FROM w JOIN f ON w.w = f.w AND w.doc_id > f.least),
g AS (SELECT r, i, sum(CASE WHEN i > before THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS k FROM (SELECT r, i, coalesce(lag(i) OVER (PARTITION BY r ORDER BY i) + 50, -1) AS before FROM m)),
s AS (SELECT r, min(i) AS a, max(i) + 50 AS b FROM g GROUP BY r, k),
p AS (SELECT r, count(*) AS n_spans, sum(b - a) AS n_removed, list({'a': a, 'b': b} ORDER BY a) AS cuts FROM s GROUP BY r),
c AS (SELECT d.*, coalesce(n_spans, 0) AS n_spans, coalesce(n_removed, 0) AS n_removed, list_concat([0], list_transform(coalesce(cuts, []), lambda x: x.b)) AS begins, list_concat(list_transform(coalesce(cuts, []), lambda x: x.a), [length(h) // 2]) AS ends FROM d LEFT JOIN p ON d.r = p.r)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(n_removed AS BIGINT) AS n_removed, CAST(n_spans AS BIGINT) AS n_spans,
       sha256(unhex(array_to_string(list_transform(range(1, len(begins) + 1), lambda k: substr(h, 2 * begins[k] + 1, 2 * (ends[k] - begins[k]))), ''))) AS kept_sha256
FROM c
"""
