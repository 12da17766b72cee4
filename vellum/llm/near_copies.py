"""SimHash near-dedup at a similarity: documents whose sets of ``WORDS``-word shingles have a Jaccard similarity of 0.8
or more, found through fingerprints in Gray order and verified on the shingles themselves.

Sets as alike as that differ in 0.15 of the bits of a SimHash, too many for a fingerprint of 64 bits to tell them from
others. So a fingerprint has ``WIDE`` such words, and there are several Gray orders, each of one of the words under one
rotation: in an order, two fingerprints that agree in its leading bits stand close to each other. A leaf is ``LEAF``
neighbours in one order; leaves are compared with themselves and with the one before, also across partitions. Inside them the bits that all of a
row of ``SUB`` fingerprints share are its pattern, and pairs of rows are dropped as a whole when their patterns differ in
more than the limit; of the rest, differences are added up word by word and a pair is dropped when they pass the limit
for as many words. The number of orders follows from the number of texts, so that a pair of similarity 0.8 meets in some
order with probability ``RECALL``; more similar pairs meet more surely. It grows with a small power of that number.

Texts with equal words are one node. A leaf gives a spanning forest of its candidates, and what these connect is a group.
Inside groups the sets themselves are compared: a group's nodes are dealt by hash into cells of about ``CELL`` nodes and
``CELL_BYTES`` of text, each pair of cells is a work item, and an item gives back a spanning forest of its links. So a
group is never written out as pairs, and a task holds two cells of it.

Words are told apart as in ``simhash``: white space is ASCII, A-Z counts as a-z. A text of fewer than ``WORDS`` words is one
shingle; texts without words are copies of each other.
"""

from __future__ import annotations

import math
import string

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.llm import common
from vellum.llm.components import components, stars
from vellum.llm.crf import numbers
from vellum.llm.rolling import BYTE_HASH, _ODD, _ODD_INVERSE, _powers, mix
from vellum.llm.simhash import gray_rank

WORDS = 5
#: 64-bit words of a fingerprint, and bits that may differ after one, two ... of them: what sets of similarity 0.8 differ
#: in on average and 4.3, 3.5, 3.3 and 3 standard deviations.
WIDE, LIMITS = 4, (22, 34, 46, 56)
#: Neighbours of a leaf and of a row in it.
LEAF, SUB = 512, 16
#: Nodes and bytes of words of a cell, about.
CELL, CELL_BYTES = 512, 2 << 20
#: Share of differing bits at similarity 0.8, and how likely such a pair meets in some order.
DIFFER, RECALL = math.acos(0.8 / 0.9) / math.pi, 0.995


def orders_for(n: int) -> int:
    """Gray orders for ``n`` fingerprints: a pair meets in one if it agrees in the bits that tell leaves apart."""
    meets = (1 - DIFFER) ** max(0.0, math.log2(max(n, 1) / LEAF))
    return 1 if meets >= RECALL else math.ceil(math.log(1 - RECALL) / math.log(1 - meets))


def words_of(text: Column) -> Column:
    """The words with one space between them, A-Z in lower case; empty for null."""
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    return F.trim(F.regexp_replace(lower, f"[{common.SPACE}]+", " "))


def _bounds(words: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Begin and end of every shingle in words with single spaces."""
    spaces = np.flatnonzero(np.frombuffer(words, np.uint8) == 32)
    ends = np.append(spaces, len(words))
    begins = np.concatenate(([0], spaces + 1))
    n = max(len(ends) - WORDS + 1, 1)
    return begins[:n], ends[-n:]


def shingles(words: bytes) -> set[bytes]:
    return {words[a:b] for a, b in zip(*(x.tolist() for x in _bounds(words)), strict=True)} if words else set()


def shingle_hashes(words: bytes) -> np.ndarray:
    """Hashes of the distinct shingles, ascending."""
    if not words:
        return np.zeros(0, np.int64)
    buf = np.frombuffer(words, np.uint8)
    sums = np.concatenate(([np.uint64(0)], np.cumsum(BYTE_HASH[buf] * _powers(_ODD, len(buf)))))
    a, b = _bounds(words)
    return np.unique(mix(mix((sums[b] - sums[a]) * _powers(_ODD_INVERSE, len(buf) + 1)[a]) + (b - a).astype(np.uint64)).view(np.int64))


_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)  # highest bit first
_SALTS = np.array([(k + 1) * 0x9E3779B97F4A7C15 % (1 << 64) for k in range(WIDE)], np.uint64)


def wide_fingerprint(hashes: np.ndarray) -> np.ndarray:
    """The SimHash of shingle hashes in ``WIDE`` words."""
    octets = mix(hashes.view(np.uint64)[:, None] ^ _SALTS).astype(">u8").view(np.uint8)
    if len(hashes) < 2000:  # bit by bit is faster for few, by values of octets for many
        ones = np.unpackbits(octets, axis=1).sum(0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8 * WIDE)])
    return np.packbits(2 * ones > len(hashes)).view(">u8").astype(np.uint64)


PRINTS = "node long, size long, " + ", ".join(f"f{k} long" for k in range(WIDE))


def fingerprints(nodes: DataFrame) -> DataFrame:
    """``node, size, f0, f1 ...``: the number of shingles and the fingerprint of every node with words."""

    def run(batches):
        for b in batches:
            names, words = b.column(0).to_pylist(), [w.encode("utf-8", "surrogatepass") for w in b.column(1).to_pylist()]
            hashes = [(n, shingle_hashes(w)) for n, w in zip(names, words, strict=True) if w]
            prints = np.array([wide_fingerprint(h) for _, h in hashes], np.uint64).reshape(-1, WIDE).view(np.int64)
            columns = [pa.array([n for n, _ in hashes], pa.int64()), pa.array([len(h) for _, h in hashes], pa.int64()), *[pa.array(prints[:, k]) for k in range(WIDE)]]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "size", *[f"f{k}" for k in range(WIDE)]])

    return nodes.select("node", "words").mapInArrow(run, PRINTS)


def within(a: np.ndarray, b: np.ndarray, first: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the pairs of fingerprints (rows of ``WIDE`` words) within the limits; word ``first`` counts first."""
    turn = [(first + k) % WIDE for k in range(WIDE)]
    rows = [np.concatenate((x, np.repeat(x[-1:], -len(x) % SUB, 0))).reshape(-1, SUB, WIDE) for x in (a, b)]
    ones, zeros = ([op.reduce(y, axis=1) for y in z] for op, z in ((np.bitwise_and, rows), (np.bitwise_and, [~x for x in rows])))
    shared = (ones[0] | zeros[0])[:, None] & (ones[1] | zeros[1])[None]
    apart = np.bitwise_count((ones[0][:, None] ^ ones[1][None]) & shared).cumsum(axis=2, dtype=np.int64)[:, :, -1]
    i, j = np.nonzero(apart <= LIMITS[-1])
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for at in range(0, len(i), 256):
        x, y = i[at : at + 256], j[at : at + 256]
        differ = np.bitwise_count(rows[0][x][:, :, None, turn[0]] ^ rows[1][y][:, None, :, turn[0]])
        pair, u, v = np.nonzero(differ <= LIMITS[0])
        total = differ[pair, u, v].astype(np.int64)
        p, q = x[pair] * SUB + u, y[pair] * SUB + v
        real = (p < len(a)) & (q < len(b))
        p, q, total = p[real], q[real], total[real]
        for k in range(1, WIDE):
            total = total + np.bitwise_count(a[p, turn[k]] ^ b[q, turn[k]])
            p, q, total = (z[total <= LIMITS[k]] for z in (p, q, total))
        found.append((p, q))
    return tuple(np.concatenate(z) for z in zip(*found, strict=True))


def _forest(x: np.ndarray, y: np.ndarray, t: int, inner: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Nodes of as many candidates as connect them, of a leaf ``y`` with the leaf ``x`` before it, and with itself
    (``inner``). Rows of leaves: node, size and the fingerprint."""
    both = np.concatenate((x, y)) if inner else x
    if not len(both) or not len(y):
        return (np.zeros(0, np.int64),) * 2
    i, j = within(both[:, 2:].view(np.uint64), y[:, 2:].view(np.uint64), t % WIDE)
    j, both = j + len(x), np.concatenate((x, y))
    keep = (i < j) & (5 * both[i, 1] >= 4 * both[j, 1]) & (5 * both[j, 1] >= 4 * both[i, 1])
    i, j = stars(i[keep], j[keep], len(both))
    return both[i, 0], both[j, 0]


def candidates(prints: DataFrame, orders: int, path: str) -> DataFrame:
    """``a, b``: of the pairs of nodes within the limits that meet in one of the orders, and whose sizes allow the
    similarity, as many as connect the nodes of a leaf."""
    spark = prints.sparkSession
    names = [f"f{k}" for k in range(WIDE)]
    turns = -(-orders // WIDE)  # rotations of each word
    ranks = []
    for t in range(orders):
        f, r = F.col(names[t % WIDE]), (t // WIDE) * 64 // turns
        ranks.append(F.struct(F.lit(t).alias("t"), gray_rank(F.shiftleft(f, r).bitwiseOR(F.shiftrightunsigned(f, 64 - r)) if r else f).alias("rank")))
    rows = prints.select("node", "size", *names, F.explode(F.array(*ranks)).alias("o")).select("o.t", "o.rank", "node", "size", *names)
    parts = max(1, min(common.shuffle_partitions(spark), prints.count() * orders // (16 * LEAF)))
    placed = rows.repartitionByRange(parts, "t", "rank").sortWithinPartitions("t", "rank", "node")
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("part", pa.int64()), ("head", pa.bool_()), ("t", pa.int32()), ("leaf", pa.binary())])

    def run(batches):
        part, first = TaskContext.get().partitionId(), True

        def found(x, y, t):
            a, b = _forest(x, y, t)
            none = pa.nulls(len(a))
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *[none.cast(f.type) for f in list(schema)[2:]]], schema=schema)

        def edge(leaf, t, head):
            return pa.RecordBatch.from_pylist([{"part": part, "head": head, "t": t, "leaf": leaf.tobytes()}], schema)

        none = np.zeros((0, 2 + WIDE), np.int64)
        held, before, order = none, none, None
        for batch in batches:
            ts = batch.column(0).to_numpy()
            table = np.stack([batch.column(k).to_numpy() for k in range(1, 3 + WIDE)], axis=1)
            cuts = [0, *(np.flatnonzero(ts[1:] != ts[:-1]) + 1).tolist(), len(ts)]
            for p, q in zip(cuts, cuts[1:], strict=False):
                if p == q:
                    continue
                if order is not None and ts[p] != order:
                    if first:
                        yield edge(held, order, True)
                    yield found(before, held, order)
                    held, before, first = none, none, False
                order = int(ts[p])
                held = np.concatenate((held, table[p:q]))
                while len(held) >= LEAF:
                    if first:
                        yield edge(held[:LEAF], order, True)
                    yield found(before, held[:LEAF], order)
                    before, held, first = held[:LEAF], held[LEAF:], False
        if order is not None:
            if first:
                yield edge(held, order, True)
            yield found(before, held, order)
            yield edge(np.concatenate((before, held))[-LEAF:], order, False)

    out = common.table(placed.select("t", "node", "size", *names).mapInArrow(run, "a long, b long, part long, head boolean, t int, leaf binary"), path)
    edges = out.where("leaf IS NOT NULL").select("head", "t", "leaf", F.dense_rank().over(Window.orderBy("part")).alias("at"))  # two rows a partition
    ends = edges.where("NOT head").select("t", (F.col("at") + 1).alias("at"), F.col("leaf").alias("x")).join(edges.where("head").select("t", "at", F.col("leaf").alias("y")), ["t", "at"])

    def seams(batches):
        for batch in batches:
            for t, x, y in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                a, b = _forest(*(np.frombuffer(z, np.int64).reshape(-1, 2 + WIDE) for z in (x, y)), t, inner=False)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

    return out.where("a IS NOT NULL").select("a", "b").unionByName(ends.select("t", "x", "y").mapInArrow(seams, "a long, b long")).distinct()


def linked(words: list[bytes], cells: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions ``(i, j)`` of as many similar pairs as connect the texts; where there are two cells, of pairs across."""
    sets = [sorted(shingles(w)) for w in words]
    sizes = np.array([len(x) for x in sets], np.int64)
    flat = numbers([x for each in sets for x in each])
    begins = np.cumsum(sizes) - sizes
    mark = np.zeros(len(flat), bool)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for i, (a, n) in enumerate(zip(begins.tolist(), sizes.tolist(), strict=True)):
        mark[flat[a : a + n]] = True
        both = np.add.reduceat(mark[flat[a:]], begins[i:] - a, dtype=np.int64)  # with this text and those behind it
        mark[flat[a : a + n]] = False
        hits = 5 * both >= 4 * (n + sizes[i:] - both)
        hits[0] = False
        if cells[0] != cells[-1]:
            hits &= cells[i:] != cells[i]
        j = np.flatnonzero(hits) + i
        found.append((np.full(len(j), i), j))
    i, j = (np.concatenate(x) for x in zip(*found, strict=True))
    return stars(i, j, len(words))


def group_links(groups: DataFrame, nodes: DataFrame) -> DataFrame:
    """``a, b``: links that connect the similar nodes of each group of ``group, node``."""
    spark = nodes.sparkSession
    texts = groups.join(nodes.select("node", "words"), "node")
    sizes = texts.groupBy("group").agg(F.count("*").alias("n"), F.sum(F.octet_length("words")).alias("bytes"))
    cells = F.greatest(F.ceil(F.col("n") / CELL), F.ceil(F.col("bytes") / CELL_BYTES)).cast("int")
    mine = F.pmod(F.xxhash64("node"), F.col("cells")).cast("int")
    dealt = groups.join(sizes.select("group", cells.alias("cells")), "group").select("group", "node", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("other"))
    items = dealt.select("group", F.least("mine", "other").alias("s"), F.greatest("mine", "other").alias("t"), "mine", "node")
    key = ["group", "s", "t"]
    loaded = items.join(nodes.select("node", "words"), "node").repartition(common.shuffle_partitions(spark), *key).sortWithinPartitions(*key, "mine", "node")

    def run(batches):
        held, now = [], None

        def item(rows):
            if len(rows) < 2:
                return
            names = np.array([r[1] for r in rows])
            i, j = linked([r[2] for r in rows], np.array([r[0] for r in rows]))
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(names[i]), pa.array(names[j])], names=["a", "b"])

        for b in batches:
            for *tile, cell, node, words in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if tile != now:
                    yield from item(held)
                    held, now = [], tile
                held.append((cell, node, words.encode("utf-8", "surrogatepass")))
        yield from item(held)

    return loaded.select(*key, "mine", "node", "words").mapInArrow(run, "a long, b long")


def near_links(nodes: DataFrame, path: str) -> DataFrame:
    """``node, component`` of the nodes that are not their component's least; ``nodes`` has ``node, key, words``."""
    spark = nodes.sparkSession
    small = {"spark__sql__execution__arrow__maxRecordsPerBatch": "2000", "spark__sql__execution__arrow__maxBytesPerBatch": str(4 << 20)}
    with common.settings(spark, **small):
        prints = common.table(fingerprints(nodes), f"{path}/prints")
    trees = components(common.table(candidates(prints, orders_for(prints.count()), f"{path}/leaves"), f"{path}/trees"))
    roots = trees.select(F.col("component").alias("group"), F.col("component").alias("node")).distinct()
    groups = common.table(roots.unionByName(trees.select(F.col("component").alias("group"), "node")), f"{path}/groups")
    with common.settings(spark, **small):
        links = common.table(group_links(groups, nodes), f"{path}/links")
    out = components(links)
    common.remove(spark, *[f"{path}/{x}" for x in ("prints", "leaves", "trees", "groups", "links")])
    return out


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when one document of each group of near copies does: the one with the least doc_id,
    of repeated rows one. Rows that share an id but not their words are documents of their own. Rows with a null doc_id
    belong to no group and stay."""
    spark = docs.sparkSession
    path = common.workdir(spark, "near")
    named = docs.where(F.col(doc_id).isNotNull()).withColumns({"__id": F.col(doc_id).cast("long"), "__key": F.sha2(words_of(F.col(text)), 256)})
    rows = named.select("__id", F.col("__key").alias("key"), words_of(F.col(text)).alias("words"))
    distinct = rows.groupBy("key").agg(F.min("__id").alias("id"), F.first("words").alias("words"))
    nodes = common.table(distinct.withColumn("node", F.monotonically_increasing_id()), f"{path}/nodes")
    group = F.coalesce("component", "node")
    best = nodes.select("node", "id", "key").join(near_links(nodes, path), "node", "left").groupBy(group.alias("group")).agg(F.min(F.struct("id", "key")).alias("r"))
    kept = common.table(best.select(F.col("r.id").alias("__id"), F.col("r.key").alias("__key")), f"{path}/kept")
    once = named.join(kept, ["__id", "__key"], "left_semi").dropDuplicates(["__id", "__key"]).select(docs.columns)
    common.remove(spark, f"{path}/nodes")
    return once.unionByName(docs.where(F.col(doc_id).isNull()))
