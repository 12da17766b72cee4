"""Retrieval: vector top-k, hypothetical answers, query expansion, memories, and the context of chunks."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.functions import fixed, vectors
from vellum.functions import text as T


def top_k(docs: DataFrame, query: list[float], k: int = 5, vector: str = "embedding", ident: str = "vec_id", digits: int | None = None) -> DataFrame:
    """The ``k`` rows with the largest inner product with one query vector (a literal, so nothing is joined): partial
    top rows per task, then one merge."""
    score = vectors.dot(F.col(vector), F.array(*[F.lit(float(x)) for x in query]))
    scored = docs.withColumn("score", F.round(score, digits) if digits is not None else score)
    return scored.orderBy(F.desc_nulls_last("score"), ident).limit(k)


def top_k_each(docs: DataFrame, queries: DataFrame, k: int = 5, vector: str = "embedding", ident: str = "vec_id", query_id: str = "query_id", block: int = 4096) -> DataFrame:
    """Top ``k`` of every query: ``query_id, ident, score, rank``. Queries go to the tasks in blocks of about
    ``QUERY_BLOCK``, by the hash of their ids; tasks multiply blocks of vectors with a block of queries and keep ``k`` each,
    and a window merges the partial lists."""
    blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    part = F.pmod(F.xxhash64(query_id), F.lit(blocks))
    return reduce(DataFrame.unionByName, [_top_k_block(docs, queries.where(part == b), k, vector, ident, query_id, block) for b in range(blocks)])


#: Queries that go to the tasks together, about.
QUERY_BLOCK = 5000
#: Scores that a task holds at once, about.
CELLS = 1 << 19


def _top_k_block(docs: DataFrame, queries: DataFrame, k: int, vector: str, ident: str, query_id: str, block: int) -> DataFrame:
    found = queries.select(query_id, vector).limit(4 * QUERY_BLOCK + 1).collect()
    if len(found) > 4 * QUERY_BLOCK:
        raise ValueError(f"more than {4 * QUERY_BLOCK} queries have ids that hash alike; ids are to be distinct")
    names, q = [r[0] for r in found], np.array([r[1] for r in found], float)

    def run(batches):
        import pandas as pd

        most = max(1, CELLS // block)  # queries that are scored at once
        for b in batches:
            for a in range(0, len(b), block):
                part = b.iloc[a : a + block]
                m = np.stack(part[vector]).astype(float).T
                ids = part[ident].to_numpy()
                for first in range(0, len(q), most):
                    s = q[first : first + most] @ m
                    order = np.lexsort((np.broadcast_to(ids, s.shape), -s), axis=1)[:, :k]
                    yield pd.DataFrame({query_id: np.repeat(names[first : first + most], order.shape[1]), ident: ids[order].ravel(), "score": np.take_along_axis(s, order, 1).ravel()})

    kinds = f"{query_id} {queries.schema[query_id].dataType.simpleString()}, {ident} {docs.schema[ident].dataType.simpleString()}, score double"
    if not found:
        return docs.sparkSession.createDataFrame([], kinds + ", rank int")
    partial = docs.where(F.col(vector).isNotNull()).select(ident, vector).mapInPandas(run, kinds)
    rank = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), ident))
    return partial.withColumn("rank", rank).where(F.col("rank") <= k)


def index_texts(docs: DataFrame, text: str = "text", encoder: str = "hashing", dimensions: int = 1024) -> DataFrame:
    """Texts with their vectors in ``embedding``."""
    return docs.withColumn("embedding", vectors.encode(F.col(text), encoder, dimensions))


def hypothetical_search(indexed: DataFrame, query: str, answer: Callable[[str], str], k: int = 5, ident: str = "doc_id", encoder: str = "hashing", dimensions: int = 1024) -> DataFrame:
    """Top ``k`` by the vector of an answer that ``answer(query)`` (a language model) makes up."""
    vector = vectors.encoder(encoder, dimensions)([answer(query)])[0]
    return top_k(indexed, vector.tolist(), k, "embedding", ident)


def expand_query(queries: DataFrame, synonyms: DataFrame | None = None, query: str = "query") -> DataFrame:
    """``query, term`` for each query and every synonym of a dictionary term that it contains. The dictionary is
    broadcast; its size is checked."""
    spark = queries.sparkSession
    words = spark.createDataFrame(fixed.SYNONYMS, "word string, synonym string") if synonyms is None else synonyms
    if words.limit(100_001).count() > 100_000:
        raise ValueError("the dictionary of a containment join holds at most 100,000 rows")
    hit = queries.join(F.broadcast(words), F.contains(F.col(query), F.col("word"))).select(query, F.col("synonym").alias("term"))
    return hit.unionByName(queries.select(query, F.col(query).alias("term"))).distinct()


def search_memories(memories: DataFrame, query: str, namespace: str, now: str, limit: int = 6, minimum_confidence: float = 0.5, pool: int = 200) -> DataFrame:
    """The best memories of a namespace: the ``pool`` most important ones that still hold, by a score of shared words,
    importance and confidence. ``now`` is a timestamp, so that a search can be repeated."""
    lexical, importance, confidence = fixed.MEMORY_WEIGHTS
    live = memories.where((F.col("namespace") == namespace) & (F.col("confidence") >= minimum_confidence) & (F.col("expires_at").isNull() | (F.col("expires_at") > F.lit(now).cast("timestamp"))))
    first = live.orderBy(F.desc("importance"), F.desc("created_at"), "id").limit(pool)
    asked, words = T.word_set(F.lit(query)), T.word_set(F.col("content"))
    shared = F.size(F.array_intersect(asked, words))
    score = shared / F.greatest(F.size(F.array_union(asked, words)), F.lit(1)) * lexical + F.col("importance") * importance + F.col("confidence") * confidence
    score = F.when((shared == 0) & (F.size(asked) > 0), score * fixed.MEMORY_NO_OVERLAP).otherwise(score)
    return first.withColumn("score", score).orderBy(F.desc("score"), F.desc("importance"), F.desc("created_at"), "id").limit(limit)


def add_memory(spark, namespace: str, kind: str, content: str, importance: float, confidence: float, created_at: str, ident: int, metadata: str = "{}", expires_at: str | None = None) -> DataFrame:
    """One memory as a row to append; importance and confidence are held in [0, 1], blank content raises."""
    if not content.strip():
        raise ValueError("a memory has content")
    hold = lambda x: min(max(float(x), 0.0), 1.0)
    row = spark.createDataFrame([(ident, namespace, kind, content.strip(), hold(importance), hold(confidence), metadata, created_at, expires_at)], "id long, namespace string, kind string, content string, importance double, confidence double, metadata_json string, created_at string, expires_at string")
    return row.withColumns({c: F.col(c).cast("timestamp") for c in ("created_at", "expires_at")})


def parent_context(children: DataFrame, parents: DataFrame) -> DataFrame:
    """Children with their parent's content; a child without one raises."""
    p = parents.select(F.col("parent_id").alias("__p"), F.col("content").alias("parent_content"))
    joined = children.join(p, F.col("parent_id") == F.col("__p"), "left")
    content = F.when(F.col("__p").isNull(), F.raise_error(F.concat(F.lit("no parent of "), F.col("child_id")))).otherwise(F.col("parent_content"))
    return joined.withColumn("parent_content", content).drop("__p")
