"""SimHash near-dedup: fingerprints in Gray order under a hierarchy of masked bit patterns.

Distinct fingerprints are sorted by Gray rank, so that neighbours agree in many bits, and cut into leaves of ``LEAF``.
Every node knows the bits that all its fingerprints share (mask and pattern); ``FAN`` nodes make one of the next level.
The self-join walks the hierarchy from the top: of two nodes the shared bits that differ are counted, and the pair goes
on to its children only while that count is within the distance. Pairs of leaves that survive compare their
fingerprints, again by sub-nodes first, and give back a spanning forest of the links. A group of near copies is spread
over leaves of bounded size, and copies with one fingerprint are one entry before anything is sorted.

A null text has no words: fingerprint zero, linked like any other. A null doc_id gets its fingerprint and no component
(and takes no part in others'). Repeated rows get equal results. An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import common
from vellum.llm.components import components, stars

SEED = 42
#: Words of a shingle.
SHINGLE = 3
#: Fingerprints of a leaf, of a sub-node in it, and children of an upper node.
LEAF, SUB, FAN = 512, 16, 32
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)  # highest bit first


def fingerprint(text: bytes) -> int:
    """64-bit SimHash of the word shingles of a UTF-8 text, A-Z in lower case."""
    from xxhash import xxh64_intdigest

    words = text.lower().split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        return xxh64_intdigest(b" ".join(words), SEED)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate(([0], ends[: -SHINGLE] + 1)).tolist()
    hashes = np.array([xxh64_intdigest(joined[a:b], SEED) for a, b in zip(begins, ends[SHINGLE - 1 :].tolist(), strict=True)], dtype=">u8")
    n = len(hashes)
    octets = hashes.view(np.uint8).reshape(n, 8)
    if n < 64:
        ones = np.unpackbits(octets, axis=1).sum(0, dtype=np.int64)
    else:
        ones = np.concatenate([np.bincount(octets[:, k], minlength=256) @ _BITS for k in range(8)])
    return int.from_bytes(np.packbits(2 * ones > n).tobytes(), "big")


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp``: the fingerprint as a signed long, per row."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint((t or "").encode("utf-8", "surrogatepass")) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def gray_rank(fp):
    """Rank of a code word in the reflected Gray sequence, as a signed long that sorts as the unsigned one."""
    for k in (1, 2, 4, 8, 16, 32):
        fp = fp.bitwiseXOR(F.shiftrightunsigned(fp, k))
    return fp.bitwiseXOR(F.lit(-(1 << 63)))


def shared_bits(fps: np.ndarray) -> tuple[int, int]:
    """Mask of the bits that all agree in, and those bits."""
    ones, zeros = np.bitwise_and.reduce(fps), np.bitwise_and.reduce(~fps)
    return ones | zeros, ones


def _subs(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Fingerprints in rows of SUB (the last repeated to fill up), and the rows' masks and patterns."""
    rows = np.concatenate((fps, np.repeat(fps[-1:], -len(fps) % SUB))).reshape(-1, SUB)
    ones, zeros = np.bitwise_and.reduce(rows, axis=1), np.bitwise_and.reduce(~rows, axis=1)
    return rows, ones | zeros, ones


def leaf_links(a: np.ndarray, b: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions in the two leaves of the fingerprints within the distance."""
    (ra, ma, pa_), (rb, mb, pb) = _subs(a), _subs(b)
    near = np.bitwise_count((pa_[:, None] ^ pb[None]) & ma[:, None] & mb[None]) <= distance
    i, j = np.nonzero(near)
    found = [(np.zeros(0, np.int64), np.zeros(0, np.int64))]
    for k in range(0, len(i), 4096):
        x, y = i[k : k + 4096], j[k : k + 4096]
        hit, u, v = np.nonzero(np.bitwise_count(ra[x][:, :, None] ^ rb[y][:, None, :]) <= distance)
        found.append((x[hit] * SUB + u, y[hit] * SUB + v))
    p, q = (np.concatenate(c) for c in zip(*found, strict=True))
    real = (p < len(a)) & (q < len(b))
    return p[real], q[real]


def gray_index(distinct: DataFrame, path: str) -> DataFrame:
    """The leaves of the hierarchy: ``node, mask, bits, fps, reps`` from ``fp, rep``, numbered in Gray order."""
    spark = distinct.sparkSession
    ranked = distinct.select("fp", "rep", gray_rank(F.col("fp")).alias("rank"))
    placed = ranked.repartitionByRange(common.shuffle_partitions(spark), "rank").sortWithinPartitions("rank")

    def cut(batches):
        part, seq, held = TaskContext.get().partitionId(), 0, [np.zeros(0, np.int64)] * 2

        def leaf(fps, reps):
            mask, ones = shared_bits(fps)
            return pa.RecordBatch.from_pylist([{"part": part, "seq": seq, "mask": int(mask), "bits": int(ones), "fps": fps.tobytes(), "reps": reps.tobytes()}], schema)

        schema = pa.schema([("part", pa.int32()), ("seq", pa.int64()), ("mask", pa.int64()), ("bits", pa.int64()), ("fps", pa.binary()), ("reps", pa.binary())])
        for b in batches:
            held = [np.concatenate((h, b.column(k).to_numpy())) for k, h in enumerate(held)]
            while len(held[0]) >= LEAF:
                yield leaf(held[0][:LEAF], held[1][:LEAF])
                seq, held = seq + 1, [h[LEAF:] for h in held]
        if len(held[0]):
            yield leaf(*held)

    leaves = common.table(placed.select("fp", "rep").mapInArrow(cut, "part int, seq long, mask long, bits long, fps binary, reps binary"), f"{path}/leaves")
    begins, total = {}, 0
    for r in leaves.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect():  # as many rows as shuffle partitions
        begins[r["part"]], total = total, total + r["n"]
    if not begins:
        return leaves.select(F.col("seq").alias("node"), "mask", "bits", "fps", "reps")
    first = F.element_at(F.create_map(*[F.lit(x) for kv in begins.items() for x in kv]), F.col("part"))
    return leaves.select((first + F.col("seq")).cast("long").alias("node"), "mask", "bits", "fps", "reps")


def near_leaves(leaves: DataFrame, distance: int, path: str) -> DataFrame:
    """``a <= b``: the pairs of leaves whose shared bits allow the distance, found from the top of the hierarchy down."""
    levels = [common.table(leaves.select("node", "mask", "bits"), f"{path}/level0")]
    while levels[-1].count() > 1:
        up = levels[-1].groupBy(F.shiftright("node", FAN.bit_length() - 1).alias("node")).agg(F.expr("bit_and(bits & mask)").alias("bits"), F.expr("bit_and(~bits & mask)").alias("zeros"))
        levels.append(common.table(up.select("node", F.col("bits").bitwiseOR(F.col("zeros")).alias("mask"), "bits"), f"{path}/level{len(levels)}"))
    pairs = levels[-1].select(F.col("node").alias("a"), F.col("node").alias("b"))
    for depth in range(len(levels) - 2, -1, -1):
        child = levels[depth].withColumn("up", F.shiftright("node", FAN.bit_length() - 1))
        side = lambda x: child.select(F.col("up").alias(x), F.col("node").alias(f"{x}_node"), F.col("mask").alias(f"{x}_mask"), F.col("bits").alias(f"{x}_bits"))  # noqa: E731, B023
        left = pairs.join(side("a"), "a")
        right = side("b").withColumnRenamed("b", "b_up")
        differ = F.bit_count(F.col("a_bits").bitwiseXOR(F.col("b_bits")).bitwiseAND(F.col("a_mask")).bitwiseAND(F.col("b_mask")))
        both = left.join(right, (left.b == right.b_up) & (F.col("a_node") <= F.col("b_node")) & (differ <= distance))
        pairs = common.table(both.select(F.col("a_node").alias("a"), F.col("b_node").alias("b")), f"{path}/pairs{depth}")
    return pairs


def link_fingerprints(distinct: DataFrame, distance: int = 2) -> DataFrame:
    """``node, component`` of the linked representatives among ``fp, rep`` (fingerprints distinct)."""
    spark = distinct.sparkSession
    path = common.workdir(spark, "gray")
    leaves = gray_index(distinct, path)
    pairs = near_leaves(leaves, distance, path)
    side = lambda x: leaves.select(F.col("node").alias(x), F.col("fps").alias(f"{x}_fps"), F.col("reps").alias(f"{x}_reps"))
    items = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "a_fps", "a_reps", "b_fps", "b_reps")

    def run(batches):
        for batch in batches:
            for a, b, fa, ra, fb, rb in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                x, y = np.frombuffer(fa, np.uint64), np.frombuffer(fb, np.uint64)
                i, j = leaf_links(x, y, distance)
                if a == b:
                    i, j = i[i < j], j[i < j]
                    reps = np.frombuffer(ra, np.int64)
                else:
                    j = j + len(x)
                    reps = np.concatenate((np.frombuffer(ra, np.int64), np.frombuffer(rb, np.int64)))
                if len(i):
                    p, q = stars(i, j, len(reps))
                    yield pa.RecordBatch.from_arrays([pa.array(reps[p]), pa.array(reps[q])], names=["a", "b"])

    with common.settings(spark, spark__sql__execution__arrow__maxRecordsPerBatch="256"):
        links = common.table(items.mapInArrow(run, "a long, b long"), f"{path}/links")
    return components(links)


def _grouped(docs: DataFrame, distance: int, doc_id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """``doc_id, fp`` per row, and ``fp, group, component_id`` per fingerprint: fingerprints are the nodes, so rows that share
    an id but not the fingerprint are not linked by it."""
    spark = docs.sparkSession
    path = common.workdir(spark, "simhash")
    rows = common.table(fingerprints(docs, doc_id, text), f"{path}/rows")
    distinct = common.table(rows.where("doc_id IS NOT NULL").groupBy("fp").agg(F.min("doc_id").alias("least")), f"{path}/distinct")
    found = link_fingerprints(distinct.select("fp", F.col("fp").alias("rep")), distance).withColumnRenamed("node", "fp")
    grouped = common.table(distinct.join(found, "fp", "left").select("fp", "least", F.coalesce("component", "fp").alias("group")), f"{path}/grouped")
    least = grouped.groupBy("group").agg(F.min("least").alias("component_id"))
    return rows, common.table(grouped.join(least, "group").select("fp", "group", "component_id"), f"{path}/known")


def near_duplicates(docs: DataFrame, distance: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` per row of ``docs``; ``component_id`` is the least doc_id that links reach."""
    rows, known = _grouped(docs, distance, doc_id, text)
    component = F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")
    return rows.join(known, "fp", "left").select("doc_id", "fp", component)


def keep_one(docs: DataFrame, distance: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay when one document of each group does: the one with the least doc_id, of equal ids that
    of the least fingerprint, and of rows equal in both the one whose text sorts first. Rows with a null doc_id belong to
    no group and stay."""
    rows, known = _grouped(docs, distance, doc_id, text)
    least = rows.where("doc_id IS NOT NULL").distinct().join(known, "fp").groupBy("group").agg(F.min(F.struct("doc_id", "fp")).alias("r"))
    kept = common.table(least.select(F.col("r.doc_id").alias("id"), F.col("r.fp").alias("fp")), common.workdir(docs.sparkSession, "kept"))
    rest = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    packed = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), F.col(text).cast("string").alias("text"), rest.alias("row"))

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint((t or "").encode("utf-8", "surrogatepass")) for t in b.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(fps.view(np.int64))], names=["id", "text", "row", "fp"])

    marked = packed.mapInArrow(run, f"id long, text string, row {docs.schema.simpleString()}, fp long")
    order = F.struct(F.coalesce("text", F.lit("")), F.xxhash64(F.to_json("row")))
    once = marked.join(kept, ["id", "fp"], "left_semi").groupBy("id", "fp").agg(F.min_by("row", order).alias("row"))
    return once.select("row.*").unionByName(docs.where(F.col(doc_id).isNull()))


def op8_simhash(spark, sf_dir: str) -> DataFrame:
    """All ``documents``: fingerprints in hex and components at two differing bits."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
