"""Queries of the text rules and the document pipeline over ``documents``, with SQL where SQL can express them.

White space in these oracles is ASCII white space: the test texts hold no other.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.functions import text as T
from vellum.functions import fixed, vectors
from vellum.operators import ml, quality
from vellum.plans import pipeline
from vellum.plans.relational import query, read
from vellum.sources import readers
from vellum.sources.writers import shared_dir

# SQL counterparts of the text functions.
S = r"[\s\x{00A0}\x{3000}]"
VISIBLE = r"length(regexp_replace(coalesce({0}, ''), '\s', '', 'g'))"
WIDE = r"length(regexp_replace(coalesce({0}, ''), '[^\x{{3400}}-\x{{4DBF}}\x{{4E00}}-\x{{9FFF}}\x{{3040}}-\x{{30FF}}\x{{AC00}}-\x{{D7AF}}]', '', 'g'))"
TOKENS = "CAST({w} + ceil(({v} - {w}) / 4.0) AS BIGINT)"
LINES = "SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents"
KEY = r"regexp_replace(regexp_replace(regexp_replace(lower(line), '\d+', '#', 'g'), '\s+', '', 'g'), '[-–—_/\\|·•]+', '', 'g')"


def sql_tokens(c: str) -> str:
    return TOKENS.format(w=WIDE.format(c), v=VISIBLE.format(c))


def lines_of(spark, d):
    """Every line of every document: ``doc_id, line``. Documents break lines at newlines only."""
    docs = read(spark, d, "documents")
    return docs.select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line"))


@query(
    f"WITH t AS (SELECT source, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) AS body, {sql_tokens('text')} AS n FROM documents) "
    "SELECT source, count(*) AS n_texts, CAST(sum(n) AS BIGINT) AS n_tokens, (count(*) FILTER (body <> '') - count(DISTINCT sha256(body)) FILTER (body <> '')) / count(*) AS duplicate_ratio, "
    "count(*) FILTER (n < 100) / count(*) AS short_ratio, count(*) FILTER (n < 180) / count(*) AS under_min_ratio, count(*) FILTER (n > 500) / count(*) AS over_target_ratio, min(n) AS tokens_min, "
    "quantile_cont(n, 0.10) AS tokens_p10, quantile_cont(n, 0.25) AS tokens_p25, quantile_cont(n, 0.5) AS tokens_median, quantile_cont(n, 0.75) AS tokens_p75, quantile_cont(n, 0.90) AS tokens_p90, max(n) AS tokens_max, "
    "CASE WHEN count(*) >= 10 AND ((count(*) FILTER (body <> '') - count(DISTINCT sha256(body)) FILTER (body <> '')) / count(*) > 0.05 OR count(*) FILTER (n < 100) / count(*) > 0.10 OR count(*) FILTER (n < 180) / count(*) > 0.25) THEN 'review' ELSE 'ready' END AS readiness "
    "FROM t GROUP BY source"
)
def q_quality_report(spark, d):
    """The quality report of every source."""
    return quality.corpus_report(read(spark, d, "documents"), "source")


@query(f"SELECT doc_id, {sql_tokens('text')} AS tokens, {VISIBLE.format('text')} AS visible FROM documents")
def q_token_estimates(spark, d):
    """F4, F6."""
    return read(spark, d, "documents").select("doc_id", T.estimate_tokens(F.col("text")).alias("tokens"), T.visible_chars(F.col("text")).cast("long").alias("visible"))


@query(
    f"WITH l AS ({LINES}), k AS (SELECT doc_id, CASE WHEN {VISIBLE.format('line')} > 120 THEN '' ELSE {KEY} END AS pattern FROM l) "
    "SELECT pattern, count(DISTINCT doc_id) AS documents FROM k WHERE pattern <> '' GROUP BY pattern HAVING count(DISTINCT doc_id) >= 3"
)
def q_repeated_lines(spark, d):
    """Lines that several documents share."""
    keyed = lines_of(spark, d).select("doc_id", T.boilerplate_key(F.col("line")).alias("pattern")).where("pattern <> ''").distinct()
    return keyed.groupBy("pattern").agg(F.count("*").alias("documents")).where("documents >= 3")


@query(
    f"WITH l AS ({LINES}), k AS (SELECT doc_id, line, CASE WHEN {VISIBLE.format('line')} > 120 THEN '' ELSE {KEY} END AS pattern FROM l), r AS (SELECT pattern FROM k WHERE pattern <> '' GROUP BY pattern HAVING count(DISTINCT doc_id) >= 3) "
    "SELECT doc_id, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM k WHERE pattern NOT IN (SELECT pattern FROM r) GROUP BY doc_id"
)
def q_lines_without_boilerplate(spark, d):
    """Lines that no pattern of other documents removes."""
    keyed = lines_of(spark, d).select("doc_id", T.boilerplate_key(F.col("line")).alias("pattern"), F.length("line").alias("size"))
    each = keyed.groupBy("doc_id", "pattern").agg(F.count("*").alias("n_lines"), F.sum("size").alias("n_chars"))  # no text but the pattern is shuffled
    named = each.where("pattern <> ''")
    repeated = named.groupBy("pattern").agg(F.count("*").alias("n")).where("n >= 3").select("pattern")
    kept = each.where("pattern = ''").unionByName(named.join(repeated, "pattern", "left_anti").select(*each.columns))  # long and blank lines repeat nothing
    return kept.groupBy("doc_id").agg(F.sum("n_lines").alias("n_lines"), F.sum("n_chars").alias("n_chars"))


LIST = r"^(?:[-*•·]\s+|\(?\d{1,3}[.)、]\s*|[一二三四五六七八九十百]+[、.]\s*|[（(][一二三四五六七八九十百0-9]+[）)]\s*)"


@query(
    f"WITH l AS ({LINES}) SELECT doc_id, count(*) AS n_lines, count(*) FILTER (regexp_matches(trim(line, ' ' || chr(9) || chr(13)), '{LIST}')) AS list_lines, count(*) FILTER (regexp_full_match(line, '(?i)(?:page\\s*)?\\d{{1,4}}(?:\\s*/\\s*\\d{{1,4}})?')) AS page_numbers, "
    "count(*) FILTER (regexp_matches(trim(line, ' ' || chr(9) || chr(13)), '[。！？!?；;]$')) AS sentence_ends, count(*) FILTER (regexp_matches(line, '[\\x{3400}-\\x{4DBF}\\x{4E00}-\\x{9FFF}]')) AS cjk_lines, "
    "count(*) FILTER (regexp_matches(line, '^(?:们|种|序|限|案|码|拆开|强|达|合|询|问|而|且|以及|并且|其中|同时|此外|因此|所以)') OR regexp_matches(line, '^[a-z,.;:)\\]]')) AS mid_sentence FROM l GROUP BY doc_id"
)
def q_line_predicates(spark, d):
    """P2, P4, P6, P9, F5."""
    line = F.col("line")
    return lines_of(spark, d).groupBy("doc_id").agg(
        F.count("*").alias("n_lines"), F.count_if(T.is_list_line(line)).alias("list_lines"), F.count_if(T.is_page_number(line)).alias("page_numbers"), F.count_if(T.ends_sentence(line)).alias("sentence_ends"),
        F.count_if(T.contains_cjk(line)).alias("cjk_lines"), F.count_if(T.starts_mid_sentence(line)).alias("mid_sentence"),
    )


@query("WITH t AS (SELECT doc_id, trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)) AS body FROM documents) SELECT sha256(body) AS digest, count(*) AS copies, min(doc_id) AS first_id FROM t WHERE body <> '' GROUP BY body HAVING count(*) > 1")
def q_duplicate_texts(spark, d):
    """Exact copies, by digest."""
    body = T.strip(T.text_of(F.col("text")))
    docs = read(spark, d, "documents").select("doc_id", F.when(body != "", F.sha2(body, 256)).alias("digest")).where("digest IS NOT NULL")
    return docs.groupBy("digest").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query("SELECT doc_id, 'doc_' || substr(sha256(CAST(doc_id AS VARCHAR) || chr(31) || lang || chr(31) || source), 1, 24) AS id FROM documents")
def q_stable_ids(spark, d):
    """F8."""
    return read(spark, d, "documents").select("doc_id", T.stable_id("doc", F.col("doc_id"), F.col("lang"), F.col("source")).alias("id"))


@query(
    "WITH l AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS pos, line FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos FROM documents)), "
    "m AS (SELECT doc_id, pos, line, length(line) <= 12 AS short, sum(CASE WHEN length(line) <= 12 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS section FROM l) "
    "SELECT doc_id, section, count(*) AS n_lines, CAST(sum(length(line)) AS BIGINT) AS n_chars FROM m WHERE NOT short GROUP BY doc_id, section"
)
def q_sections_by_running_count(spark, d):
    """Lines grouped by the number of short lines before them."""
    docs = read(spark, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("pos", "line"))
    by = Window.partitionBy("doc_id").orderBy("pos")
    marked = docs.withColumn("section", F.sum((F.length("line") <= 12).cast("long")).over(by))
    return marked.where(F.length("line") > 12).groupBy("doc_id", "section").agg(F.count("*").alias("n_lines"), F.sum(F.length("line")).alias("n_chars"))


@query("SELECT conv_id, list(role || ':' || CAST(length(coalesce(text, '')) AS VARCHAR) ORDER BY turn) AS turns, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY turn) AS text FROM conversations GROUP BY conv_id")
def q_page_assembly(spark, d):
    """A4, K4: parts joined in order."""
    c = read(spark, d, "conversations")
    size = F.concat(F.col("role"), F.lit(":"), F.length(F.coalesce("text", F.lit(""))).cast("string"))
    ordered = F.array_sort(F.collect_list(F.struct("turn", size.alias("size"), F.coalesce("text", F.lit("")).alias("text"))))
    return c.groupBy("conv_id").agg(F.transform(ordered, lambda x: x.size).alias("turns"), F.array_join(F.transform(ordered, lambda x: x.text), "\n\n").alias("text"))


NOISE = (
    f"line = '' OR regexp_matches(line, '{fixed.BULLETS}') OR regexp_matches(line, '(?i){fixed.UI_LABEL}') OR regexp_matches(line, '{fixed.NUMBER_STRIP}') OR CASE WHEN regexp_matches(line, '{fixed.NUMBER_RUN}') "
    r"THEN len(list_filter(range(1, len(string_split_regex(line, '\s+'))), lambda i: TRY_CAST(string_split_regex(line, '\s+')[i + 1] AS INT) - TRY_CAST(string_split_regex(line, '\s+')[i] AS INT) <> 1)) = 0 ELSE false END"
)


@query(
    rf"WITH l AS (SELECT doc_id, pos, trim(regexp_replace(line, '[\t\x0b\f\r ]+', ' ', 'g')) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents)), "
    rf"c AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY pos) AS t FROM l WHERE NOT ({NOISE}) GROUP BY doc_id), "
    r"m AS (SELECT doc_id, regexp_replace(regexp_replace(t, '([。！？!?；;])\s*', '\1' || chr(1), 'g'), '\.\s+([A-Z0-9])', '.' || chr(1) || '\1', 'g') AS t FROM c) "
    "SELECT d.doc_id, CAST(coalesce(len(list_filter(string_split(m.t, chr(1)), lambda x: trim(x, ' ' || chr(10)) <> '')), 0) AS INT) AS sentences FROM documents d LEFT JOIN m ON m.doc_id = d.doc_id"
)
def q_sentence_split(spark, d):
    """sentences per document; in the SQL boundaries that look behind are marked first."""
    cleaned = T.clean(F.col("text"))
    return read(spark, d, "documents").select("doc_id", F.size(T.split_sentences(cleaned)).alias("sentences"))


@query()
def q_hashing_encoder(spark, d):
    """Vectors of the benchmark texts."""
    return read(spark, d, "benchmark").select("item_id", vectors.encode(F.col("text"), "hashing", 64).alias("vector"))


def _run(spark, d):
    """The document pipeline over all texts; intermediate tables in the folder that the cluster shares. Queries of one
    application over one folder share a run."""
    key = (spark.sparkContext.applicationId, d)
    if key in _runs:
        return _runs[key]
    path = f"{shared_dir(spark)}/documents-{uuid.uuid4().hex[:12]}"

    def table(df, name):
        df.write.mode("overwrite").parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    _runs.clear()
    _runs[key] = pipeline.run(*readers.text_layout(read(spark, d, "documents")), table=table)
    return _runs[key]


_runs: dict[tuple[str, str], object] = {}


@query()
def q_chunks(spark, d):
    """H1-H14 over all documents: children with their links."""
    return _run(spark, d).children.select("document_id", "child_id", "parent_id", "chunk_index", "token_estimate", "previous_child_id", "next_child_id", "content_type", "index_enabled")


@query()
def q_document_quality(spark, d):
    """The report of every document."""
    return _run(spark, d).report


@query("SELECT 0 AS too_large, 0 AS orphans, 0 AS broken_links, 0 AS gaps")
def q_chunk_invariants(spark, d):
    """What must hold of all children: size, parents, links, numbering."""
    r = _run(spark, d)
    c = r.children
    count = lambda df, name: df.agg(F.count("*").alias(name)).withColumn("k", F.lit(1))
    spans = c.groupBy("parent_id").agg(F.count("*").alias("n"), F.max("chunk_index").alias("last"), F.min("chunk_index").alias("first")).where("last <> n - 1 OR first <> 0")
    rows = [count(c.where("token_estimate > 800"), "too_large"), count(c.join(r.parents, "parent_id", "left_anti"), "orphans"), count(quality.broken_links(c), "broken_links"), count(spans, "gaps")]
    out = rows[0]
    for x in rows[1:]:
        out = out.join(x, "k")
    return out.drop("k")


@query()
def q_sentiment_nb(spark, d):
    """Naive Bayes on character n-grams, fitted to the labelled documents, applied to all benchmark texts."""
    labels = read(spark, d, "labels").where("quality IS NOT NULL").select("doc_id", F.col("quality").cast("string").alias("label"))
    docs = read(spark, d, "documents").join(labels, "doc_id").select("doc_id", "text", "label")
    model = ml.train_text_classifier(docs)
    return ml.classify_texts(model, read(spark, d, "benchmark")).select("item_id", "predicted")
