"""Embedding near-dedup: spherical-cap filters from random product codes, joined on filters and verified exactly.

A filter is a direction put together from one random codeword per block of coordinates (after a random rotation). A
vector lies in the caps of all filters whose direction it meets with at least a threshold; these are found by list
decoding: partial sums that cannot reach it are dropped, and the others look up their completions in the sorted scores of
the other block, so the directions are never enumerated. The threshold follows from the number of vectors: it rises so
that a filter holds about ``MEMBERS`` of vectors spread at random, and the number of filters of a vector stays the same,
so candidates grow with the vectors and not with their square. Vectors that share a filter are verified in double
precision.

Copies of a vector are one class, with a number of its own, before anything is joined. A filter's members are dealt by
hash into cells of about ``CELL``, and each pair of cells is a work item of its own, so a filter that holds a third of all
vectors is many items of bounded size. An item counts a pair only if its filter is the first that both vectors share, and
gives back the number of links per vector and a spanning forest of its links: pairs are never written out.

Vectors that are null, empty, zero, or hold null or non-finite components link with nothing. Vectors of different
lengths never link. Every row is a vector of its own, also where rows share a vec_id; rows with a null vec_id link with
nothing.
"""

from __future__ import annotations

import functools
import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import common
from vellum.llm.components import components, stars

#: Members of a filter among vectors spread at random, on average.
MEMBERS = 8.0
#: Least inner product of a unit vector with a filter's direction, however few the vectors are.
LEAST_ALPHA = 0.35
#: Product codes, each with a rotation of its own: a vector that meets few directions of one meets more of another.
CODES = 6
#: Filters of each code that a random vector falls in, on average.
FILTERS = 8.0
#: Blocks of a product code.
BLOCKS = 2
#: Codewords of a block at most: beyond, vectors of few coordinates have fewer filters.
MOST_WORDS = 1 << 15
#: Members of a filter's cell, about.
CELL = 512


def cap_measure(dim: int, alpha: float) -> float:
    """Share of the unit sphere with first coordinate at least alpha."""
    if dim < 2:
        return 0.5
    t = np.linspace(-1, 1, 200_001)[1:-1]
    w = (1 - t * t) ** ((dim - 3) / 2)
    return float(w[t >= alpha].sum() / w.sum())


@functools.lru_cache(maxsize=64)
def alpha_for(dim: int, n: int) -> float:
    """The threshold at which a filter holds ``MEMBERS`` of ``n`` vectors spread at random."""
    grid = np.arange(LEAST_ALPHA, 0.9, 0.005)
    fits = [a for a in grid if cap_measure(dim, float(a)) * n <= MEMBERS]
    return float(round(fits[0] if fits else grid[-1], 3))


@functools.lru_cache(maxsize=64)
def code(dim: int, number: int, alpha: float, filters: float = FILTERS) -> tuple[np.ndarray, list[np.ndarray]]:
    """Rotation and the codewords of each block of one of the codes for vectors of this length."""
    rng = np.random.default_rng([dim, number])
    rotation = np.linalg.qr(rng.normal(size=(dim, dim)))[0]
    blocks = min(BLOCKS, dim)
    size = min(max(2, math.ceil((filters / max(cap_measure(dim, alpha), 1e-12)) ** (1 / blocks))), MOST_WORDS)
    words = []
    for part in np.array_split(np.arange(dim), blocks):
        c = rng.normal(size=(size, len(part)))
        words.append(c / np.linalg.norm(c, axis=1, keepdims=True) / math.sqrt(blocks))
    return rotation, words


def decode_all(unit: np.ndarray, alpha: float) -> tuple[np.ndarray, np.ndarray]:
    """``(row, filter)`` over all codes."""
    found = [decode(unit, k, alpha) for k in range(CODES)]
    return np.concatenate([r for r, _ in found]), np.concatenate([f * CODES + k for k, (_, f) in enumerate(found)])


def decode(unit: np.ndarray, number: int, alpha: float, filters: float = FILTERS) -> tuple[np.ndarray, np.ndarray]:
    """``(row, filter)`` of every filter of one code that a row's unit vector exceeds, rows ascending."""
    n, dim = unit.shape
    rotation, words = code(dim, number, alpha, filters)
    turned = unit @ rotation
    parts = np.array_split(np.arange(dim), len(words))
    scores = [turned[:, p] @ w.T for p, w in zip(parts, words, strict=True)]
    if len(scores) == 1:
        row, word = np.nonzero(scores[0] >= alpha)
        return row, word
    first, second = scores
    width = second.shape[1]
    order = np.argsort(second, axis=1)
    ranked = np.take_along_axis(second, order, axis=1)
    row, one = np.nonzero(first >= alpha - ranked[:, -1:])
    shift = 4.0 * np.arange(n)  # puts the rows' sorted scores one behind the other
    begin = np.searchsorted((ranked + shift[:, None]).ravel(), alpha - first[row, one] + shift[row])
    fits = (row + 1) * width - begin
    which = np.repeat(np.arange(len(row)), fits)
    at = np.arange(len(which)) - np.repeat(np.cumsum(fits) - fits - begin, fits)
    row, ident = row[which], one[which] * width + order.ravel()[at]
    order = np.lexsort((ident, row))
    return row[order], ident[order]


def _matrix(column) -> np.ndarray:
    """Rows of a list column of equal lengths as doubles."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def assign(classes: DataFrame) -> DataFrame:
    """``rep, dim, filter`` of every class of equal vectors and every filter that it exceeds."""
    counted = classes.groupBy(F.size("vector").alias("dim")).agg(F.count("*").alias("n")).collect()  # one row for each length
    alphas = {r["dim"]: alpha_for(r["dim"], r["n"]) for r in counted}

    def run(batches):
        for b in batches:
            reps, vectors = b.column(0).to_numpy(), b.column(1)
            sizes = pc.list_value_length(vectors).to_numpy()
            for dim in np.unique(sizes):
                mine = np.flatnonzero(sizes == dim)
                for a in range(0, len(mine), 2048):
                    some = mine[a : a + 2048]
                    row, ident = decode_all(_unit(_matrix(vectors.take(pa.array(some)))), alphas[int(dim)])
                    yield pa.RecordBatch.from_arrays([pa.array(reps[some][row]), pa.array(np.full(len(row), dim, np.int32)), pa.array(ident)], names=["rep", "dim", "filter"])

    return classes.select("rep", "vector").mapInArrow(run, "rep long, dim int, filter long")


def verify(filter_id: int, cells: np.ndarray, reps: np.ndarray, counts: np.ndarray, x: np.ndarray, lists: list[np.ndarray], threshold: float):
    """Links of one work item: ``(rep, links)`` arrays and the two sides of a spanning forest."""
    unit = _unit(x)
    linked = unit @ unit.T >= threshold
    np.fill_diagonal(linked, False)
    if cells[0] != cells[-1]:  # two cells: pairs across them only
        linked &= cells[:, None] != cells[None, :]
    if not linked.any():
        return None
    touched = np.flatnonzero(linked.any(1))
    earlier = np.concatenate([lists[k][lists[k] < filter_id] for k in touched])
    if len(earlier):
        names, column = np.unique(earlier, return_inverse=True)
        member = np.zeros((len(touched), len(names)), np.float32)
        member[np.repeat(np.arange(len(touched)), [int((lists[k] < filter_id).sum()) for k in touched]), column] = 1
        linked[np.ix_(touched, touched)] &= ~(member @ member.T > 0)
    i, j = np.nonzero(np.triu(linked))
    a, b = stars(i, j, len(reps))
    return reps[touched], (linked @ counts)[touched], reps[a], reps[b]


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, vec_id: str = "vec_id", embedding: str = "embedding", cell: int = CELL) -> DataFrame:
    """``vec_id, n_links, component_id, kept`` per row of ``vectors``."""
    spark = vectors.sparkSession
    path = common.workdir(spark, "caps")
    n_parts = common.shuffle_partitions(spark)
    x = F.col("vector")
    fine = x.isNotNull() & F.forall(x, lambda v: v.isNotNull() & (F.abs(v) < float("inf"))) & F.exists(x, lambda v: v != 0)
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("vector")).withColumn("fine", F.coalesce(fine, F.lit(False)))
    good = rows.where("fine AND vec_id IS NOT NULL").select("vec_id", "vector")
    classes = good.groupBy("vector").agg(F.min("vec_id").alias("least"), F.count("*").alias("n"))
    classes = common.table(classes.withColumn("rep", F.monotonically_increasing_id()), f"{path}/classes")  # numbers stay as written
    filters = common.table(assign(classes), f"{path}/filters")
    sizes = filters.groupBy("dim", "filter").agg(F.count("*").alias("size")).where("size > 1").withColumn("cells", F.ceil(F.col("size") / cell).cast("int"))
    mine = F.pmod(F.xxhash64("rep", "filter"), F.col("cells")).cast("int")
    dealt = filters.join(sizes, ["dim", "filter"]).select("dim", "filter", "rep", mine.alias("mine"), F.explode(F.sequence(F.lit(0), F.col("cells") - 1)).alias("other"))
    items = dealt.select("dim", "filter", F.least("mine", "other").alias("s"), F.greatest("mine", "other").alias("t"), "mine", "rep")
    lists = filters.groupBy("rep").agg(F.array_sort(F.collect_list("filter")).alias("filters"))  # bounded: the filters of one vector
    loaded = items.join(classes.select("rep", "n", "vector").join(lists, "rep"), "rep").repartition(n_parts, "dim", "filter", "s", "t").sortWithinPartitions("dim", "filter", "s", "t", "mine", "rep")

    def run(batches):
        held: list[pa.RecordBatch] = []

        def flush(chunks):
            b = pa.Table.from_batches(chunks).combine_chunks()
            if b.num_rows < 2:
                return
            col = lambda k: b.column(k).combine_chunks()
            got = verify(b.column("filter")[0].as_py(), col("mine").to_numpy(), col("rep").to_numpy(), col("n").to_numpy().astype(float), _matrix(col("vector")), [np.array(f) for f in col("filters").to_pylist()], threshold)
            if got:
                reps, links, left, right = got
                yield pa.RecordBatch.from_arrays([pa.array(reps), pa.nulls(len(reps), pa.int64()), pa.array(links.astype(np.int64))], schema=schema)
                yield pa.RecordBatch.from_arrays([pa.array(left), pa.array(right), pa.nulls(len(left), pa.int64())], schema=schema)

        schema = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("links", pa.int64())])
        key = None
        for b in batches:
            keys = np.stack([b.column(k).to_numpy() for k in ("dim", "filter", "s", "t")], axis=1)
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(1)) + 1).tolist(), b.num_rows]
            for p, q in zip(cuts, cuts[1:], strict=False):
                if held and tuple(keys[p]) != key:
                    yield from flush(held)
                    held = []
                key = tuple(keys[p])
                held.append(b.slice(p, q - p))
        if held:
            yield from flush(held)

    found = common.table(loaded.select("dim", "filter", "s", "t", "mine", "rep", "n", "vector", "filters").mapInArrow(run, "a long, b long, links long"), f"{path}/links")
    counted = found.where("links IS NOT NULL").groupBy(F.col("a").alias("rep")).agg(F.sum("links").alias("links"))
    parts = components(found.where("b IS NOT NULL")).withColumnRenamed("node", "rep")
    grouped = classes.join(counted, "rep", "left").join(parts, "rep", "left").withColumn("group", F.coalesce("component", "rep"))
    grouped = common.table(grouped.select("vector", "least", "n", "links", "group"), f"{path}/grouped")
    least = grouped.groupBy("group").agg(F.min("least").alias("component_id"))
    known = grouped.join(least, "group").select(F.col("vector").alias("v"), (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), "component_id")
    known = common.table(known, f"{path}/known")
    common.remove(spark, *[f"{path}/{x}" for x in ("classes", "filters", "links", "grouped")])
    marked = good.join(known, good.vector == known.v).select("vec_id", "n_links", "component_id")
    alone = rows.where("NOT (fine AND vec_id IS NOT NULL)").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return marked.unionByName(alone).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(True)))


def op9_embedding_caps(spark, sf_dir: str) -> DataFrame:
    """Every row of ``embeddings`` at cosine 0.95."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: All pairs compared, then what links reach; for small tables.
OP9_SQL = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings),
fine AS (SELECT r, vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE vec_id IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS MATERIALIZED (SELECT a.r AS a, b.r AS b FROM fine a JOIN fine b ON a.r <> b.r AND len(a.e) = len(b.e) WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.95),
reach AS (SELECT r, r AS s FROM fine UNION SELECT reach.r, links.b FROM reach JOIN links ON reach.s = links.a),
comp AS (SELECT reach.r, min(f.vec_id) AS component_id FROM reach JOIN fine f ON f.r = reach.s GROUP BY reach.r),
n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT v.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, coalesce(c.component_id, v.vec_id) AS component_id, coalesce(v.vec_id = c.component_id, true) AS kept
FROM v LEFT JOIN comp c ON c.r = v.r LEFT JOIN n ON n.a = v.r
"""
