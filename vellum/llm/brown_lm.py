"""Brown class-based language model: exchange clustering of words, class transitions and word emissions.

Texts are tokenised once into blocks: a block is what one task read, as local word numbers by falling frequency, its
distinct words as 64-bit hashes with their training counts. Words are dealt to shards by their hashes. From there blocks and
shards exchange messages, never tokens and never a row per word: a block sends each shard what it has of the shard's words
as one row, the shard sums up the rows of all blocks and answers each in the order of its row. A shard is added for every
``SHARD_TOKENS``, so that its words fit one task. Words of at least ``MIN_COUNT`` training tokens are clustered; rarer words
share one class, the end of a text has one to itself.

Exchange: every frequent word has counts of the classes of its neighbours on both sides. In each sweep every shard goes
through its words by falling count and moves each to the class that raises the mutual information of adjacent classes
most. A shard sees its own moves at once, those of others after the sweep, and neighbours by the classes that they had
before it; then the counts are taken anew. Sweeps end after ``SWEEPS`` of them, or when words of fewer than ``SETTLED`` of
the tokens moved.
As classes must start somewhere, the first sweep seeds them with the ``CLASSES`` most frequent words and describes
neighbours by groups: the ``TOP`` most frequent words, and ``HASHED`` groups of all others. The tables are bounded by the
square of the classes; the words stay distributed.

Probability of a token: transition of its class from the class before it (counts smoothed by ``ADD``; a text starts
after an end), times emission of the word by its class. The rare class keeps the share that words seen once have of it
for the one unknown word (Good-Turing). All training tokens of all documents count.

A null text is empty: one token, the end. A null doc_id counts as the text '' for the fold. Repeated rows are scored
and counted as often as they stand. Word hashes are taken to be distinct (64 bits).
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import common

FOLDS, HELD_OUT = 5, 1
#: Training tokens from which a word is clustered.
MIN_COUNT = 10
#: Classes of frequent words; then the class of rare words and that of the end.
CLASSES = 48
RARE, END, ALL = CLASSES, CLASSES + 1, CLASSES + 2
#: Groups of neighbours: classes; in the first sweep frequent words, hashed groups of others, and one for the end.
GROUPS = ALL
TOP, HASHED = 32, GROUPS - 33
#: Sweeps after the first one at most, and the share of tokens whose words moved below which there is no other.
SWEEPS, SETTLED = 2, 0.01
ADD = 0.5
#: Tokens after which a block is closed.
BLOCK_TOKENS = 3_000_000
#: Tokens for each of which a shard is added, beyond the session's shuffle partitions, and words of it handled at once.
SHARD_TOKENS, SLOTS = 4_000_000, 50_000
END_HASH = 0


def word_hashes(words: list[bytes]) -> np.ndarray:
    from xxhash import xxh64_intdigest

    return np.array([xxh64_intdigest(w) for w in words], np.uint64).view(np.int64)


def pack(ids: np.ndarray) -> bytes:
    """Word numbers as three compressed planes of bytes."""
    return zstandard.compress(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def unpack(data: bytes) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(data), np.uint8).reshape(4, -1).T.copy().view("<i4").ravel()


class Block:
    """Tokens of consecutive documents as numbers of the block's distinct words."""

    def __init__(self):
        self.number: dict[bytes, int] = {}
        self.parts: list[np.ndarray] = []
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.held: list[bool] = []
        self.n = 0

    def add(self, doc_id: int | None, text: str | None) -> None:
        tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()
        number = self.number
        for w in set(tokens).difference(number):
            number[w] = len(number)
        self.parts.append(np.array([*[number[w] for w in tokens], -1], np.int32))
        self.ids.append(doc_id)
        self.lengths.append(len(tokens) + 1)
        self.held.append(zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % FOLDS == HELD_OUT)
        self.n += len(tokens) + 1

    def row(self, block: int) -> dict:
        """The block's row; the end of a text is word 0."""
        ids = np.concatenate(self.parts) + 1
        self.parts.clear()
        train = np.repeat(~np.array(self.held), self.lengths)
        size = len(self.number) + 1
        order = np.argsort(-np.bincount(ids[ids > 0], minlength=size)[1:], kind="stable") + 1
        rank = np.zeros(size, np.int32)
        rank[order] = np.arange(1, size)
        hashes = np.concatenate(([END_HASH], word_hashes(list(self.number))))[np.concatenate(([0], order))]
        ids = rank[ids]
        counts = np.bincount(ids[train], minlength=size)
        return {"block": block, "ids": self.ids, "lengths": self.lengths, "held": self.held, "tokens": pack(ids), "hashes": hashes.tobytes(), "counts": counts.tobytes(), "n_tokens": len(ids)}


BLOCKS = "block long, ids array<long>, lengths array<long>, held array<boolean>, tokens binary, hashes binary, counts binary, n_tokens long"


def tokenise(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """One row per block."""
    schema = pa.schema([("block", pa.int64()), ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("tokens", pa.binary()), ("hashes", pa.binary()), ("counts", pa.binary()), ("n_tokens", pa.int64())])

    def run(batches):
        part, seq, block = TaskContext.get().partitionId(), 0, Block()
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                block.add(i, t.as_py())
                if block.n >= BLOCK_TOKENS:
                    yield pa.RecordBatch.from_pylist([block.row(part << 24 | seq)], schema)
                    seq, block = seq + 1, Block()
        if block.n:
            yield pa.RecordBatch.from_pylist([block.row(part << 24 | seq)], schema)

    return docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("t")).mapInArrow(run, BLOCKS)


def shard_of(h: np.ndarray, n: int) -> np.ndarray:
    """The shard, of ``n``, that sums up each word hash."""
    return ((h.view(np.uint64) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def dealt(h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The words in the order of their shards, and where each shard begins in it."""
    shard = shard_of(h, n)
    order = np.argsort(shard, kind="stable")
    return order, np.searchsorted(shard[order], np.arange(n + 1))


def cut(data: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """The bytes of ``data`` from each of ``bounds`` to the next."""
    data = np.ascontiguousarray(data)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer((bounds * data.itemsize).astype(np.int32)), pa.py_buffer(data)])


def joined(column, dtype) -> np.ndarray:
    """The numbers of all values of a binary column."""
    return np.frombuffer(b"".join(x for x in column.to_pylist() if x), dtype)


def starts(sizes) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(sizes, dtype=np.int64)))


def filled(schema: pa.Schema, **columns) -> pa.Table:
    """Rows with nulls in the columns that are not given."""
    n = len(next(iter(columns.values())))
    return pa.Table.from_arrays([columns[f.name] if f.name in columns else pa.nulls(n, f.type) for f in schema], schema=schema)


def messages(schema: pa.Schema, block: int, bounds: np.ndarray, **columns) -> pa.Table:
    """One row per shard that a block has words of; ``bounds`` are those of the shards."""
    rows = filled(schema, block=pa.array(np.full(len(bounds) - 1, block)), shard=pa.array(np.arange(len(bounds) - 1, dtype=np.int32)), **columns)
    return rows.filter(pa.array(bounds[:-1] < bounds[1:]))


def per_shard(sent: DataFrame, n: int, work, schema: str) -> DataFrame:
    """``work`` on all rows of a shard as one table."""

    def run(batches):
        held = [b for b in batches if b.num_rows]
        if held:
            rows = pa.Table.from_batches(held)
            held.clear()
            shard = rows.column("shard").to_numpy()
            found = np.unique(shard)
            for s in found:
                some = rows if len(found) == 1 else rows.filter(pa.array(shard == s))
                yield from work(some, int(s)).combine_chunks().to_batches()

    return sent.repartitionById(n, "shard").mapInArrow(run, schema)


def asked(blocks: DataFrame, n: int) -> DataFrame:
    """``block, shard, h, c``: a block's distinct words of a shard with their training counts there."""
    schema = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("h", pa.binary()), ("c", pa.binary())])

    def run(batches):
        for b in batches:
            for block, hashes, counts in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                h, c = np.frombuffer(hashes, np.int64), np.frombuffer(counts, np.int64)
                order, bounds = dealt(h, n)
                yield from messages(schema, block, bounds, h=cut(h[order], bounds), c=cut(c[order].astype("<u4"), bounds)).combine_chunks().to_batches()

    return blocks.select("block", "hashes", "counts").mapInArrow(run, "block long, shard int, h binary, c binary")


def totals(sent: DataFrame, n: int) -> DataFrame:
    """For every message of ``asked``: the words' counts in all blocks as ``totals``, and as ``slots`` the numbers in the
    shard of those that are clustered. And a row per shard, without a block: its clustered ``words`` by number (by falling
    count), ``facts`` (tokens, distinct words, tokens of rare words, words seen once, ends) and its most frequent words."""
    schema = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("totals", pa.binary()), ("slots", pa.binary()), ("words", pa.binary()), ("facts", pa.list_(pa.int64())), ("top", pa.list_(pa.int64())), ("top_count", pa.list_(pa.int64()))])
    most = max(TOP, CLASSES)

    def work(rows: pa.Table, shard: int) -> pa.Table:
        bounds = starts(common.byte_sizes(rows.column("h"))) // 8
        names, which = np.unique(joined(rows.column("h"), np.int64), return_inverse=True)
        total = np.bincount(which, joined(rows.column("c"), "<u4"), minlength=len(names)).astype(np.int64)
        word = names != END_HASH
        often = np.flatnonzero(word & (total >= MIN_COUNT))
        often = often[np.lexsort((names[often], -total[often]))]
        slot = np.full(len(names), -1, np.int32)
        slot[often] = np.arange(len(often))
        slots = slot[which]
        clustered = slots >= 0
        rare = word & (total < MIN_COUNT)
        facts = [total.sum(), (total > 0).sum(), total[rare].sum(), (word & (total == 1)).sum(), total[~word].sum()]
        lists = {"facts": facts, "top": names[often[:most]], "top_count": total[often[:most]]}
        own = filled(schema, shard=pa.array([shard], pa.int32()), words=pa.array([names[often].tobytes()]), **{k: pa.array([[int(x) for x in v]], pa.list_(pa.int64())) for k, v in lists.items()})
        sent = filled(schema, block=rows.column("block"), shard=rows.column("shard"), totals=cut(total[which], bounds), slots=cut(slots[clustered], starts(clustered)[bounds]))
        return pa.concat_tables([sent, own])

    return per_shard(sent, n, work, "block long, shard int, totals binary, slots binary, words binary, facts array<long>, top array<long>, top_count array<long>")


def _groups(h: np.ndarray, top: dict[int, int]) -> np.ndarray:
    """Context group of each word hash."""
    out = TOP + (h.view(np.uint64) % np.uint64(HASHED)).astype(np.int64)
    for k in np.flatnonzero(np.isin(h, np.array(list(top), np.int64))):
        out[k] = top[int(h[k])]
    out[h == END_HASH] = GROUPS - 1
    return out


SENT = "block long, shard int, slots binary, was binary, sizes binary, cells binary, counts binary, table array<long>"
SENT_SCHEMA = pa.schema([("block", pa.int64()), ("shard", pa.int32()), *[(k, pa.binary()) for k in ("slots", "was", "sizes", "cells", "counts")], ("table", pa.list_(pa.int64()))])
OPENED = SENT + ", ids array<long>, lengths array<long>, held array<boolean>, known array<long>, base array<double>, fixed array<double>, tokens binary, place binary, bounds binary"
OPENED_SCHEMA = pa.schema([*SENT_SCHEMA, ("ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64())), ("fixed", pa.list_(pa.float64())), *[(k, pa.binary()) for k in ("tokens", "place", "bounds")]])


def contexts(schema: pa.Schema, block: int, tokens: np.ndarray, lengths: list[int], held: list[bool], group: np.ndarray, index: np.ndarray, was: np.ndarray, slots: np.ndarray, bounds: np.ndarray) -> pa.Table:
    """A block's messages to the shards: the neighbours' groups of its clustered words in training texts, left ones first.

    ``group`` and ``index`` (place among the clustered words, -1 for others) are by the numbers in ``tokens``; ``was``
    (classes, -1 for none), ``slots`` and the shards' ``bounds`` are by place. A message has, a word after another, its slot,
    its class, the size of its list of groups, and the lists with 32-bit counts. A last row has the block's table of
    classes by groups.
    """
    begins = starts(lengths)[:-1]
    wide = np.int64 if len(was) * 2 * GROUPS >= 1 << 31 else np.int32
    train = np.repeat(~np.array(held, bool), lengths)
    mine, right = index.astype(wide)[tokens], group.astype(wide)[tokens]
    own, left = np.empty_like(mine), np.empty_like(right)
    own[1:], left[1:] = mine[:-1], right[:-1]
    own[begins], left[begins] = -1, group[0]  # the end before a text is the start, not a word of it
    as_left, as_right = train & (mine >= 0), train & (own >= 0)
    key = np.concatenate((mine[as_left] * (2 * GROUPS) + left[as_left], own[as_right] * (2 * GROUPS) + (right[as_right] + GROUPS)))
    key.sort()
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    n = np.diff(np.append(first, len(key)))
    word, cell = np.divmod(key[first], 2 * GROUPS)
    at = np.searchsorted(word, np.arange(len(was) + 1, dtype=wide))
    cls = was[word].astype(np.int64)
    live = cls >= 0
    table = np.bincount(cls[live] * (2 * GROUPS) + cell[live], n[live], minlength=CLASSES * 2 * GROUPS).astype(np.int64)
    sent = messages(schema, block, bounds, slots=cut(slots, bounds), was=cut(was, bounds), sizes=cut(np.diff(at).astype(np.uint8), bounds), cells=cut(cell.astype(np.uint8), at[bounds]), counts=cut(n.astype("<u4"), at[bounds]))
    return pa.concat_tables([sent, filled(schema, block=pa.array([block]), table=pa.array([table]))])


def opened(blocks: DataFrame, answers: DataFrame, n: int, most: list[int], unit: float, rare: int, ends: int, unknown: float) -> DataFrame:
    """A row per block, without a shard, with what later steps need: its texts' ids, base scores and the emissions that
    follow from no class, the tokens as 0 for ends, the numbers from 1 of clustered words and a last number for all others,
    and the clustered words' numbers in the order of shards (``place``) with their ``slots``. And the messages of the first
    sweep, with the ``most`` frequent words as seeds and as groups."""
    seeds, top = {h: k for k, h in enumerate(most[:CLASSES])}, {h: k for k, h in enumerate(most[:TOP])}

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows:
            return OPENED_SCHEMA.empty_table()
        row = left.to_pylist()[0]
        right = right.sort_by("shard")
        h = np.frombuffer(row["hashes"], np.int64)
        order, _ = dealt(h, n)
        total = np.empty(len(h), np.int64)
        total[order] = joined(right.column("totals"), np.int64)
        slots = joined(right.column("slots"), np.int32)
        end = h == END_HASH
        often = ~end & (total >= MIN_COUNT)
        place = order[often[order]]
        bounds = np.searchsorted(shard_of(h[place], n), np.arange(n + 1))
        tokens, begins = unpack(row["tokens"]), starts(row["lengths"])[:-1]
        total_of = lambda x: np.add.reduceat(x[tokens], begins)
        share = np.where(often, 1.0, np.where(end, 1 / max(ends, 1), (1 - unknown) / max(rare, 1)))
        fixed = np.log10(np.where(total > 0, share * total, unknown))
        base = np.log10(total + 0.5) - unit
        index = np.full(len(h), -1)
        index[place] = np.arange(len(place))
        was = np.full(len(place), -1, np.int8)
        for k in np.flatnonzero(np.isin(h[place], np.array(list(seeds), np.int64))):
            was[k] = seeds[int(h[place[k]])]
        sent = contexts(OPENED_SCHEMA, row["block"], tokens, row["lengths"], row["held"], _groups(h, top), index, was, slots, bounds)
        number = np.where(end, 0, len(place) + 1)
        number[often] = np.arange(1, len(place) + 1)
        kept = {k: row[k] for k in ("block", "ids", "lengths", "held")} | {"known": total_of((total > 0).astype(np.int64)), "base": total_of(base), "fixed": total_of(fixed)}
        kept |= {"tokens": pack(number.astype(np.int32)[tokens]), "place": number[place].astype(np.int32).tobytes(), "slots": slots.tobytes(), "bounds": bounds.tobytes()}
        return pa.concat_tables([sent, filled(OPENED_SCHEMA, **{k: pa.array([v], OPENED_SCHEMA.field(k).type) for k, v in kept.items()})])

    return blocks.groupBy("block").cogroup(answers.where("block IS NOT NULL").select("block", "shard", "totals", "slots").groupBy("block")).applyInArrow(run, OPENED)


def block_rows(ready: DataFrame, *columns: str) -> DataFrame:
    return ready.where("tokens IS NOT NULL").select("block", "tokens", *columns)


def class_rows(now: DataFrame) -> DataFrame:
    return now.where("block IS NOT NULL").select("block", "shard", "classes")


def _class_of(place: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The class of each number of a block."""
    out = np.full(len(place) + 2, RARE, np.int64)
    out[0], out[place] = END, classes
    return out


def renewed(ready: DataFrame, now: DataFrame) -> DataFrame:
    """The messages of a later sweep, with the classes of the sweep before as groups."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        if not left.num_rows or not right.num_rows:
            return SENT_SCHEMA.empty_table()
        row = left.to_pylist()[0]
        place, slots, bounds = (np.frombuffer(row[k], t) for k, t in (("place", np.int32), ("slots", np.int32), ("bounds", np.int64)))
        was = joined(right.sort_by("shard").column("classes"), np.int8)
        index = np.full(len(place) + 2, -1)
        index[place] = np.arange(len(place))
        return contexts(SENT_SCHEMA, row["block"], unpack(row["tokens"]), row["lengths"], row["held"], _class_of(place, was), index, was, slots, bounds)

    return block_rows(ready, "lengths", "held", "place", "slots", "bounds").groupBy("block").cogroup(class_rows(now).groupBy("block")).applyInArrow(run, SENT)


def xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1))


def exchange(row: np.ndarray, cell: np.ndarray, count: np.ndarray, old: np.ndarray, table: np.ndarray, chunk: int = 256) -> np.ndarray:
    """One sweep over words (their cells ascending by row): each goes to the class with the largest gain. ``old`` is -1
    for words that are in no class yet. ``table``: classes by cells; it follows the moves."""
    new = old.copy()
    bounds = np.searchsorted(row, np.arange(0, len(old) + chunk, chunk).clip(max=len(old)))
    for k, a in enumerate(range(0, len(old), chunk)):
        lo, hi = bounds[k], bounds[k + 1]
        n = min(chunk, len(old) - a)
        r, c, x = row[lo:hi] - a, cell[lo:hi], count[lo:hi].astype(float)
        was = old[a : a + n]
        own = table[was[r], c] * (was[r] >= 0)
        left = np.bincount(r, x, minlength=n)  # twice the word's tokens, about
        totals = table.sum(1)
        gain = np.zeros((n, len(table)))
        if len(r):
            by_cell = np.ascontiguousarray(table.T)
            first = np.flatnonzero(np.concatenate(([True], r[1:] != r[:-1])))
            gain[r[first]] = np.add.reduceat(xlogx(by_cell[c] + x[:, None]) - xlogx(by_cell)[c], first, axis=0)
        gain -= xlogx(totals[None] + left[:, None]) - xlogx(totals)[None]
        here = np.flatnonzero(was >= 0)
        if len(here):  # its own class counts without it
            stay = np.bincount(r, (xlogx(own) - xlogx(own - x)) * (was[r] >= 0), minlength=n)
            t = totals[was[here]]
            gain[here, was[here]] = stay[here] - (xlogx(t) - xlogx(t - left[here]))
        best = gain.argmax(1)
        new[a : a + n] = best
        moved = best != was
        m = moved[r]
        np.add.at(table, (best[r[m]], c[m]), x[m])
        m &= was[r] >= 0
        np.add.at(table, (was[r[m]], c[m]), -x[m])
    return new


def summed(rows: DataFrame, column: str, size: int) -> np.ndarray:
    """The sum of arrays of a fixed ``size``."""
    out = np.zeros(size)
    for r in rows.where(F.col(column).isNotNull()).select(F.posexplode(column).alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect():  # ``size`` rows
        out[r["k"]] = r["n"]
    return out


SWEPT = "block long, shard int, classes binary, mass array<long>, moved long"


def sweep(sent: DataFrame, n: int, path: str) -> DataFrame:
    """The messages' words after a sweep: ``block, shard, classes``, in the order of the message. And a row per shard, without
    a block: the classes by slot, the tokens of each class as ``mass``, and the tokens of the words that moved."""
    table = summed(sent, "table", CLASSES * 2 * GROUPS).reshape(CLASSES, 2 * GROUPS)
    schema = pa.schema([("block", pa.int64()), ("shard", pa.int32()), ("classes", pa.binary()), ("mass", pa.list_(pa.int64())), ("moved", pa.int64())])

    def work(rows: pa.Table, shard: int) -> pa.Table:
        bounds = starts(common.byte_sizes(rows.column("was")))
        slots = joined(rows.column("slots"), np.int32)
        size = int(slots.max()) + 1
        old = np.full(size, -1, np.int64)
        old[slots] = joined(rows.column("was"), np.int8)
        row = np.repeat(slots, joined(rows.column("sizes"), np.uint8))
        cell, count = joined(rows.column("cells"), np.uint8), joined(rows.column("counts"), "<u4")
        new, mine, tokens = old.copy(), table.copy(), np.zeros(size, np.int64)
        for a in range(0, size, SLOTS):  # bounded: a table of some words by groups
            m = min(SLOTS, size - a)
            some = slice(None) if m == size else (row >= a) & (row < a + m)
            dense = np.bincount((row[some].astype(np.int64) - a) * (2 * GROUPS) + cell[some], count[some], minlength=m * 2 * GROUPS).reshape(m, 2 * GROUPS)
            r, c = np.nonzero(dense)
            new[a : a + m] = exchange(r, c, dense[r, c], old[a : a + m], mine)
            tokens[a : a + m] = dense[:, :GROUPS].sum(1)
        mass = np.bincount(new, tokens, minlength=CLASSES).astype(np.int64)
        own = filled(schema, shard=pa.array([shard], pa.int32()), classes=pa.array([new.astype(np.int8).tobytes()]), mass=pa.array([mass]), moved=pa.array([int(tokens[new != old].sum())]))
        return pa.concat_tables([filled(schema, block=rows.column("block"), shard=rows.column("shard"), classes=cut(new.astype(np.int8)[slots], bounds)), own])

    rows = sent.where("shard IS NOT NULL").select("block", "shard", "slots", "was", "sizes", "cells", "counts")
    with common.settings(sent.sparkSession, spark__sql__parquet__columnarReaderBatchSize="64"):
        return common.table(per_shard(rows, n, work, SWEPT), path)


def cluster(ready: DataFrame, answers: DataFrame, n: int, tokens: int, path: str) -> DataFrame:
    """``h, class`` of every clustered word; ``tokens`` is how often all of them stand. The last sweep's rows lie in
    ``path/classes``."""
    spark = ready.sparkSession
    now = sweep(ready.drop("tokens"), n, f"{path}/classes")
    for k in range(1, SWEEPS + 1):
        with common.settings(spark, spark__sql__parquet__columnarReaderBatchSize="4"):
            sent = common.table(renewed(ready, now), f"{path}/contexts{k}")
        now = sweep(sent, n, f"{path}/classes")  # read by the table just written, and no more
        common.remove(spark, f"{path}/contexts{k}")
        if (now.agg(F.sum("moved").alias("moved")).first()["moved"] or 0) < SETTLED * tokens:
            break

    def run(batches):
        for b in batches:
            for words, classes in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(words, np.int64)), pa.array(np.frombuffer(classes, np.int8).astype(np.int32))], names=["h", "class"])

    shards = now.where("block IS NULL").select("shard", "classes")
    return answers.where("block IS NULL").select("shard", "words").join(shards, "shard").select("words", "classes").mapInArrow(run, "h long, class int")


def pairs_of(sequence: np.ndarray, lengths: list[int]) -> np.ndarray:
    """The class before each token and its own, as one number; a text starts after an end."""
    before = np.empty(len(sequence), np.int16)
    before[1:] = sequence[:-1]
    before[starts(lengths)[:-1]] = END
    return before * np.int16(ALL) + sequence


def perplexity_scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score`` per row of ``docs``."""
    spark = docs.sparkSession
    path = common.workdir(spark, "brown")
    with common.settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="2000"):
        blocks = common.table(tokenise(docs, doc_id, text), f"{path}/blocks")
    size = blocks.agg(F.sum("n_tokens").alias("n")).first()["n"] or 0
    shards = max(common.shuffle_partitions(spark), size // SHARD_TOKENS)
    with common.settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="8", spark__sql__parquet__columnarReaderBatchSize="4"):
        answers = common.table(totals(asked(blocks, shards), shards), f"{path}/answers")
    by_shard = answers.where("block IS NULL")
    n, v, rare, hapax, ends = (x or 0 for x in by_shard.agg(*[F.sum(F.col("facts")[k]) for k in range(5)]).first())
    most = by_shard.select(F.explode(F.arrays_zip("top", "top_count")).alias("w")).orderBy(F.desc("w.top_count"), "w.top").limit(max(TOP, CLASSES))
    most = [r["h"] for r in most.select(F.col("w.top").alias("h")).collect()]
    unknown = (hapax + ADD) / (rare + hapax + 2 * ADD)
    with common.settings(spark, spark__sql__parquet__columnarReaderBatchSize="4"):
        ready = opened(blocks.drop("counts", "n_tokens"), answers, shards, most, math.log10(n + 0.5 * (v + 1)), rare, ends, unknown)
        ready = common.table(ready, f"{path}/ready")
    common.remove(spark, f"{path}/blocks")
    cluster(ready, answers, shards, n - rare - ends, path)
    now = spark.read.schema(SWEPT).parquet(f"{path}/classes")
    mass = np.concatenate((summed(now, "mass", CLASSES), [1, 1]))  # of the last two classes all is in ``fixed``

    def label(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("ids", pa.list_(pa.int64())), ("held", pa.list_(pa.bool_())), ("lengths", pa.list_(pa.int64())), ("known", pa.list_(pa.int64())), ("base", pa.list_(pa.float64())), ("fixed", pa.list_(pa.float64())), ("classes", pa.binary()), ("transitions", pa.list_(pa.int64()))])
        if not left.num_rows:
            return schema.empty_table()
        row = left.to_pylist()[0]
        place = np.frombuffer(row["place"], np.int32)
        klass = _class_of(place, joined(right.sort_by("shard").column("classes"), np.int8) if len(place) else place).astype(np.uint8)
        sequence = klass[unpack(row["tokens"])]
        pairs = np.bincount(pairs_of(sequence, row["lengths"])[np.repeat(~np.array(row["held"]), row["lengths"])], minlength=ALL * ALL)
        return pa.Table.from_pylist([{k: row[k] for k in ("ids", "held", "lengths", "known", "base", "fixed")} | {"classes": zstandard.compress(sequence.tobytes(), 1), "transitions": pairs}], schema)

    with common.settings(spark, spark__sql__parquet__columnarReaderBatchSize="4"):
        texts = block_rows(ready, "ids", "held", "lengths", "known", "base", "fixed", "place").groupBy("block")
        labels = texts.cogroup(class_rows(now).groupBy("block")).applyInArrow(label, "ids array<long>, held array<boolean>, lengths array<long>, known array<long>, base array<double>, fixed array<double>, classes binary, transitions array<long>")
        labels = common.table(labels, f"{path}/labels")
    counts = summed(labels, "transitions", ALL * ALL).reshape(ALL, ALL) + ADD
    trans = (np.log10(counts / counts.sum(1, keepdims=True)) - np.log10(np.maximum(mass, 1))).ravel()

    def score(batches):
        for b in batches:
            for r in b.to_pylist():
                sequence = np.frombuffer(zstandard.decompress(r["classes"]), np.uint8)
                begins = starts(r["lengths"])[:-1]
                total = np.add.reduceat(trans[pairs_of(sequence, r["lengths"])], begins) + np.array(r["fixed"])
                yield pa.RecordBatch.from_arrays([pa.array(r["ids"], pa.int64()), pa.array(r["held"]), pa.array(r["lengths"], pa.int64()), pa.array(r["known"], pa.int64()), pa.array(np.full(len(begins), n)), pa.array(r["base"]), pa.array(total)], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    with common.settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="1", spark__sql__parquet__columnarReaderBatchSize="4"):
        scores = labels.select("ids", "held", "lengths", "known", "base", "fixed", "classes").mapInArrow(score, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
        scores = common.table(scores, f"{path}/scores")
    common.remove(spark, *[f"{path}/{k}" for k in ("labels", "ready", "answers", "classes")])
    return scores


def op2_brown_lm(spark, sf_dir: str) -> DataFrame:
    """All ``documents``: base and class-model log10 probabilities of every text."""
    return perplexity_scores(spark.read.parquet(f"{sf_dir}/documents.parquet"))
