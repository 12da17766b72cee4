"""Queries of the tabular, windowing, diff, retrieval and matrix operators, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as T
from vellum.functions import vectors
from vellum.operators import chunking, diff, matrix, retrieval, tabular

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def query(sql: str | None = None):
    """Register a query under its function's name, with the SQL that gives the same rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


CENTS = "decimal(18,2)"


@query("SELECT o_orderkey, o_custkey, CAST(o_totalprice AS DECIMAL(18,2)) AS price FROM orders WHERE o_orderstatus = 'F' AND CAST(o_totalprice AS DECIMAL(18,2)) > 100000")
def q_filter_paid_high_value(spark, d):
    """F28 filters pushed to the scan."""
    return read(spark, d, "orders").where("o_orderstatus = 'F'").select("o_orderkey", "o_custkey", F.col("o_totalprice").cast(CENTS).alias("price")).where("price > 100000")


@query("SELECT coalesce(sum(CAST(o_totalprice AS DECIMAL(18,2))), 0) AS total FROM orders WHERE o_orderstatus = 'F'")
def q_total_paid(spark, d):
    return tabular.total(read(spark, d, "orders").where("o_orderstatus = 'F'"), F.col("o_totalprice").cast(CENTS))


@query("SELECT o_custkey, list_sort(list(o_orderkey)) AS orders FROM orders GROUP BY o_custkey")
def q_orders_by_user(spark, d):
    """Groups as arrays."""
    return tabular.group_rows(read(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", ["o_orderkey"]).select("o_custkey", F.transform("rows", lambda r: r.o_orderkey).alias("orders"))


@query("SELECT l_orderkey, sum(CAST(l_quantity AS DECIMAL(18,2)) * CAST(p_retailprice AS DECIMAL(18,2))) AS total FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY l_orderkey")
def q_cart_total(spark, d):
    items = tabular.cart(read(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_quantity"), read(spark, d, "part").select("p_partkey", "p_retailprice"), "l_partkey", "p_partkey", strict=False)
    return tabular.sum_by(items, "l_orderkey", F.col("l_quantity").cast(CENTS) * F.col("p_retailprice").cast(CENTS))


@query("SELECT bool_and(l_quantity <= p_size * 100) AS available FROM lineitem JOIN part ON l_partkey = p_partkey")
def q_cart_available(spark, d):
    items = tabular.cart(read(spark, d, "lineitem").select("l_partkey", "l_quantity"), read(spark, d, "part").select("p_partkey", (F.col("p_size") * 100).alias("stock")), "l_partkey", "p_partkey", strict=False)
    return tabular.all_available(items, "l_quantity", "stock")


@query("SELECT p_brand, CAST(sum(p_size) AS BIGINT) AS total FROM part GROUP BY p_brand")
def q_category_stock(spark, d):
    return tabular.sum_by(read(spark, d, "part"), "p_brand", F.col("p_size").cast("long"))


@query("SELECT p_partkey, p_retailprice FROM part ORDER BY p_retailprice DESC, p_partkey LIMIT 10")
def q_top_expensive(spark, d):
    """A top-k report."""
    return tabular.top(read(spark, d, "part").select("p_partkey", "p_retailprice"), 10, "p_retailprice", "p_partkey")


@query("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def q_count_by_type(spark, d):
    return tabular.count_by(read(spark, d, "events"), "event_type")


@query("SELECT event_type, sum(CAST(value AS DECIMAL(18,4))) / count(value) AS average FROM events GROUP BY event_type")
def q_avg_by_type(spark, d):
    return tabular.avg_by(read(spark, d, "events"), "event_type", F.col("value").cast("decimal(18,4)")).select("event_type", F.col("average").cast("double").alias("average"))


@query("SELECT CAST(sum(CAST(value AS DECIMAL(18,4))) / count(value) AS DOUBLE) AS average FROM events")
def q_global_mean(spark, d):
    return tabular.mean(read(spark, d, "events"), F.col("value").cast("decimal(18,4)")).select(F.col("average").cast("double").alias("average"))


@query("SELECT event_id, value FROM events WHERE value > 100 ORDER BY value DESC, event_id LIMIT 20")
def q_slow_events(spark, d):
    return tabular.top(read(spark, d, "events").where("value > 100").select("event_id", "value"), 20, "value", "event_id")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id ORDER BY n DESC, user_id LIMIT 1")
def q_most_frequent(spark, d):
    return tabular.most_frequent(read(spark, d, "events"), "user_id")


@query("SELECT DISTINCT event_type FROM events")
def q_distinct_types(spark, d):
    return read(spark, d, "events").select("event_type").distinct()


@query("SELECT count(DISTINCT user_id) AS users, count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END) AS converted, count(DISTINCT CASE WHEN event_type = 'purchase' THEN user_id END) / nullif(count(DISTINCT user_id), 0) AS rate FROM events")
def q_conversion(spark, d):
    return tabular.conversion(read(spark, d, "events"), "user_id", F.col("event_type") == "purchase")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS r FROM events) WHERE r = 1")
def q_first_event(spark, d):
    return tabular.first_per(read(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id").drop("ts")


@query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id) AS r FROM events) WHERE r = 1")
def q_last_event(spark, d):
    return tabular.last_per(read(spark, d, "events").select("user_id", "ts", "event_id", "event_type"), "user_id", "ts", "event_id").drop("ts")


@query("SELECT user_id, list(event_type ORDER BY ts, event_id) AS sequence FROM events GROUP BY user_id")
def q_event_sequence(spark, d):
    return tabular.sequence_per(read(spark, d, "events"), "user_id", ["ts", "event_id"], "event_type")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) >= 5")
def q_active_users(spark, d):
    return tabular.having(read(spark, d, "events"), "user_id", 5)


@query(
    "SELECT b.bucket, coalesce(c.n, 0) AS n FROM (VALUES ('over 9000'), ('5000-9000'), ('0-5000'), ('below 0'), ('over 20000')) b(bucket) LEFT JOIN (SELECT CASE WHEN c_acctbal >= 20000 THEN 'over 20000' "
    "WHEN c_acctbal >= 9000 THEN 'over 9000' WHEN c_acctbal >= 5000 THEN '5000-9000' WHEN c_acctbal >= 0 THEN '0-5000' ELSE 'below 0' END AS bucket, count(*) AS n FROM customer GROUP BY 1) c ON b.bucket = c.bucket"
)
def q_score_distribution(spark, d):
    """Buckets, empty ones too."""
    edges = [("over 20000", 20000), ("over 9000", 9000), ("5000-9000", 5000), ("0-5000", 0), ("below 0", None)]
    return tabular.buckets(read(spark, d, "customer"), F.col("c_acctbal"), edges)


@query(
    "SELECT conv_id, turn, lag(turn) OVER w AS previous_turn, lead(turn) OVER w AS next_turn, row_number() OVER w - 1 AS chunk_index FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"
)
def q_sibling_links(spark, d):
    """Links between neighbours and ordinals."""
    from pyspark.sql.window import Window

    linked = chunking.link_siblings(read(spark, d, "conversations").select("conv_id", "turn"), "conv_id", "turn", "turn")
    index = (F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1).cast("long").alias("chunk_index")
    return linked.select("conv_id", "turn", F.col("previous_child_id").alias("previous_turn"), F.col("next_child_id").alias("next_turn"), index)


@query(
    "SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], (SELECT embedding FROM embeddings ORDER BY vec_id LIMIT 1)::DOUBLE[]), 6) AS score FROM embeddings "
    "ORDER BY score DESC, vec_id LIMIT 5"
)
def q_topk_similarity(spark, d):
    """One query vector against all."""
    e = read(spark, d, "embeddings")
    vector = e.orderBy("vec_id").select("embedding").first()
    return retrieval.top_k(e, list(vector[0]) if vector else [0.0], 5, digits=6).select("vec_id", "score")


@query(
    "SELECT query_id, vec_id, round(score, 6) AS score, r AS rank FROM (SELECT q.vec_id AS query_id, e.vec_id, list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS score, "
    "row_number() OVER (PARTITION BY q.vec_id ORDER BY list_dot_product(e.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, e.vec_id) AS r FROM embeddings e, (SELECT * FROM embeddings WHERE vec_id % 50 = 0) q) WHERE r <= 5"
)
def q_topk_each(spark, d):
    """J11 for a stated query set, in blocks."""
    e = read(spark, d, "embeddings")
    found = retrieval.top_k_each(e, e.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 5)
    return found.select("query_id", "vec_id", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))


@query(
    "SELECT vec_id, round(list_dot_product(embedding::DOUBLE[], nxt::DOUBLE[]), 6) AS similarity FROM (SELECT vec_id, embedding, lead(embedding) OVER (PARTITION BY label ORDER BY vec_id) AS nxt FROM embeddings) WHERE nxt IS NOT NULL"
)
def q_adjacent_similarity(spark, d):
    """Similarity of neighbours."""
    from pyspark.sql.window import Window

    following = F.lead("embedding").over(Window.partitionBy("label").orderBy("vec_id"))
    e = read(spark, d, "embeddings").withColumn("following", following).where("following IS NOT NULL")
    return e.select("vec_id", F.round(vectors.dot(F.col("embedding"), F.col("following")), 6).alias("similarity"))


WORDS = "list_distinct(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9_]+') || regexp_extract_all(coalesce(text, ''), '[一-鿿]'))"


@query(
    f"WITH m AS (SELECT conv_id * 1000 + turn AS id, {WORDS} AS words, (conv_id * 37 % 101) / 100.0 AS importance, 0.5 + (turn * 13 % 51) / 100.0 AS confidence, conv_id AS age FROM conversations WHERE role = 'user'), "
    "pool AS (SELECT * FROM m WHERE confidence >= 0.6 ORDER BY importance DESC, age DESC, id LIMIT 200), q AS (SELECT ['the', 'and', 'of'] AS asked), "
    "s AS (SELECT id, importance, age, len(list_intersect(words, asked)) AS shared, len(list_distinct(words || asked)) AS every, confidence FROM pool, q) "
    "SELECT id, round((CASE WHEN shared = 0 THEN 0.25 ELSE 1 END) * (shared / every * 0.65 + importance * 0.2 + confidence * 0.15), 6) AS score FROM s ORDER BY (CASE WHEN shared = 0 THEN 0.25 ELSE 1 END) * (shared / every * 0.65 + importance * 0.2 + confidence * 0.15) DESC, importance DESC, age DESC, id LIMIT 6"
)
def q_memory_search(spark, d):
    """A pool by importance, ranked by shared words."""
    c = read(spark, d, "conversations").where("role = 'user'")
    m = c.select(
        (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.lit("chat").alias("namespace"), F.col("text").alias("content"), ((F.col("conv_id") * 37 % 101) / 100.0).alias("importance"),
        (0.5 + (F.col("turn") * 13 % 51) / 100.0).alias("confidence"), F.timestamp_seconds("conv_id").alias("created_at"), F.lit(None).cast("timestamp").alias("expires_at"),
    )
    return retrieval.search_memories(m, "the and of", "chat", "2024-01-01 00:00:00", minimum_confidence=0.6).select("id", F.round("score", 6).alias("score"))


@query(
    "WITH q AS (SELECT * FROM (VALUES ('保险理赔'), ('理赔'), ('other')) t(query)), s AS (SELECT * FROM (VALUES ('保险理赔', '保险索赔'), ('保险理赔', '理赔'), ('保险理赔', '索赔流程'), ('保险理赔', '理赔流程'), ('理赔', '索赔'), ('理赔', '赔付')) t(word, synonym)) "
    "SELECT query, synonym AS term FROM q JOIN s ON contains(query, word) UNION SELECT query, query FROM q"
)
def q_query_expand(spark, d):
    """J10, U4."""
    return retrieval.expand_query(spark.createDataFrame([("保险理赔",), ("理赔",), ("other",)], "query string"))


@query("SELECT * FROM (VALUES ('怎么报销保险费用？', '保险费用报销流程是什么？'), ('请问一下流程呢', '流程？'), ('怎样申请?', '申请是什么？'), ('', '？')) t(query, rewritten)")
def q_query_rewrite(spark, d):
    """F25."""
    df = spark.createDataFrame([("怎么报销保险费用？",), ("请问一下流程呢",), ("怎样申请?",), ("",)], "query string")
    return df.select("query", T.rewrite_query(F.col("query")).alias("rewritten"))


DIFF = "a AS (SELECT doc_id, lang, n_chars FROM documents WHERE source <> 'src1'), b AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN upper(lang) ELSE lang END AS lang, n_chars FROM documents WHERE source <> 'src2')"


def _snapshots(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "lang", "n_chars", "source")
    new = docs.where("source <> 'src2'").withColumn("lang", F.when(F.col("doc_id") % 7 == 0, F.upper("lang")).otherwise(F.col("lang")))
    return docs.where("source <> 'src1'").drop("source"), new.drop("source")


@query(f"WITH {DIFF} SELECT CAST(coalesce(a.doc_id, b.doc_id) AS VARCHAR) AS doc_id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' WHEN a.lang = b.lang AND a.n_chars = b.n_chars THEN 'same' ELSE 'changed' END AS status FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id")
def q_diff_snapshots(spark, d):
    """J8, U2."""
    return diff.compare(*_snapshots(spark, d), "doc_id")


@query(
    f"WITH {DIFF}, c AS (SELECT CAST(coalesce(a.doc_id, b.doc_id) AS VARCHAR) AS id, CASE WHEN a.doc_id IS NULL THEN 'added' WHEN b.doc_id IS NULL THEN 'removed' WHEN a.lang = b.lang AND a.n_chars = b.n_chars THEN 'same' ELSE 'changed' END AS s FROM a FULL OUTER JOIN b ON a.doc_id = b.doc_id) "
    "SELECT count(*) FILTER (s <> 'added') AS old_count, count(*) FILTER (s <> 'removed') AS new_count, count(*) FILTER (s IN ('added', 'removed')) = 0 AS same_id_set, count(*) FILTER (s IN ('same', 'changed')) AS common_count, "
    "count(*) FILTER (s = 'same') AS normalized_identical_count, round(count(*) FILTER (s = 'same') / greatest(count(*) FILTER (s IN ('same', 'changed')), 1), 6) AS normalized_identical_ratio, count(*) FILTER (s <> 'same') = 0 AS behaviorally_identical, "
    "coalesce(list_sort(list(id) FILTER (s = 'added'))[1:20], []) AS added_ids, coalesce(list_sort(list(id) FILTER (s = 'removed'))[1:20], []) AS removed_ids, coalesce(list_sort(list(id) FILTER (s = 'changed'))[1:20], []) AS changed_ids FROM c"
)
def q_diff_summary(spark, d):
    """A16, O9."""
    return diff.summary(diff.compare(*_snapshots(spark, d), "doc_id"), "doc_id")


@query("SELECT j, round(sum(v), 4) AS total, round(avg(v), 6) AS mean, min(v) AS least, max(v) AS greatest FROM (SELECT vec_id, unnest(range(64)) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings) GROUP BY j")
def q_matrix_axis_stats(spark, d):
    """Statistics of each column."""
    m = matrix.from_arrays(read(spark, d, "embeddings"), "vec_id", "embedding")
    return matrix.reduce(m, 0).select("j", F.round("total", 4).alias("total"), F.round("mean", 6).alias("mean"), "least", "greatest")


@query("SELECT a.j AS i, b.j AS j, round(sum(a.v * b.v), 4) AS v FROM (SELECT vec_id, unnest(range(64)) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings) a JOIN (SELECT vec_id, unnest(range(64)) AS j, unnest(embedding)::DOUBLE AS v FROM embeddings) b ON a.vec_id = b.vec_id GROUP BY 1, 2")
def q_matrix_gram(spark, d):
    """the product of the transposed matrix with itself."""
    m = matrix.from_arrays(read(spark, d, "embeddings"), "vec_id", "embedding")
    return matrix.matmul(matrix.transpose(m), m).select("i", "j", F.round("v", 4).alias("v"))


@query("SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS argmax, round(embedding[64]::DOUBLE, 6) AS last, len(list_filter(embedding, lambda x: x > 0)) AS positive, round(least(greatest(embedding[1]::DOUBLE, -0.05), 0.05), 6) AS clipped FROM embeddings")
def q_vector_functions(spark, d):
    """F30, F32, O13."""
    v = F.col("embedding")
    clipped = matrix.clip(v[0].cast("double"), -0.05, 0.05)
    return read(spark, d, "embeddings").select("vec_id", matrix.argmax(v).cast("long").alias("argmax"), F.round(matrix.item(v, -1).cast("double"), 6).alias("last"), F.size(F.filter(v, lambda x: x > 0)).cast("long").alias("positive"), F.round(clipped, 6).alias("clipped"))


@query("SELECT c_mktsegment, count(*) AS n, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal), 6) AS deviation, min(c_acctbal) AS least, quantile_cont(c_acctbal, 0.5) AS median, max(c_acctbal) AS greatest FROM customer GROUP BY c_mktsegment")
def q_describe(spark, d):
    """Sample statistics."""
    b = F.col("c_acctbal")
    return read(spark, d, "customer").groupBy("c_mktsegment").agg(F.count("*").alias("n"), F.round(F.avg(b), 6).alias("mean"), F.round(F.stddev_samp(b), 6).alias("deviation"), F.min(b).alias("least"), F.percentile(b, 0.5).alias("median"), F.max(b).alias("greatest"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS r FROM orders) WHERE r = 1")
def q_latest_upsert(spark, d):
    """The newest row of each key."""
    return tabular.latest(read(spark, d, "orders").select("o_custkey", "o_orderkey"), "o_custkey", "o_orderkey")


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_partkey = l_partkey AND p_size <= 25)")
def q_anti_join(spark, d):
    """Rows without a partner."""
    small = read(spark, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("l_partkey"))
    return read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(small, "l_partkey", "left_anti").select("l_orderkey", "l_linenumber")
