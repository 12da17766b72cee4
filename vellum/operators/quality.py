"""Quality of chunked documents: ratios, percentiles, issues and a verdict, per document, without leaving the JVM
(except for the syntax check of code units)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.config import ChunkConfig, QualityConfig
from vellum.functions import text as T
from vellum.functions.code import analyse_column

PERCENTILES = {"p10": 0.10, "p25": 0.25, "median": 0.5, "p75": 0.75, "p90": 0.90}
MULTI_LEVEL = r"(?U)^\d+(?:\.\d+)+[、.]?\s+"


def share(condition: Column, of: Column | None = None) -> Column:
    """Rows that meet a condition over all rows (or those of ``of``); 0 of none is 0."""
    whole = F.count("*") if of is None else F.count_if(of)
    return F.count_if(condition) / F.greatest(whole, F.lit(1))


def duplicate_ratio(text: Column, of: Column | None = None) -> Column:
    """Texts that repeat another one, ends stripped and empty ones left out, over all rows."""
    body = T.strip(T.text_of(text))
    live = (body != "") if of is None else (body != "") & of
    whole = F.count("*") if of is None else F.count_if(of)
    return (F.count_if(live) - F.countDistinct(F.when(live, F.sha2(body, 256)))) / F.greatest(whole, F.lit(1))


def percentiles(value: Column) -> list[Column]:
    """Linearly interpolated percentiles, least and greatest value."""
    return [F.min(value).alias("min"), *[F.percentile(value, q).alias(name) for name, q in PERCENTILES.items()], F.max(value).alias("max")]


def corpus_report(docs: DataFrame, by: str, text: str = "text", min_tokens: int = 180, target_tokens: int = 500, config: QualityConfig | None = None) -> DataFrame:
    """The quality report of plain texts per group: counts, ratios, token percentiles and a verdict."""
    config = config or QualityConfig()
    t = docs.withColumn("__n", T.estimate_tokens(F.col(text))).groupBy(by).agg(
        F.count("*").alias("n_texts"), F.sum("__n").alias("n_tokens"), duplicate_ratio(F.col(text)).alias("duplicate_ratio"), share(F.col("__n") < 100).alias("short_ratio"),
        share(F.col("__n") < min_tokens).alias("under_min_ratio"), share(F.col("__n") > target_tokens).alias("over_target_ratio"), *[c.alias(f"tokens_{n}") for c, n in zip(percentiles(F.col("__n")), ["min", *PERCENTILES, "max"], strict=True)],
    )
    many = F.col("n_texts") >= 10
    warned = many & ((F.col("duplicate_ratio") > config.max_duplicate_ratio) | (F.col("short_ratio") > config.max_short_child_ratio) | (F.col("under_min_ratio") > config.max_under_min_ratio))
    return t.withColumn("readiness", F.when(F.col("n_texts") == 0, "blocked").when(warned, "review").otherwise("ready"))


def _evaluated(children: DataFrame) -> DataFrame:
    """Children that count: the indexed ones, or all where none is."""
    any_indexed = children.groupBy("document_id").agg(F.bool_or("index_enabled").alias("__any"))
    return children.join(any_indexed, "document_id").where("index_enabled OR NOT __any").drop("__any")


def _code_children(children: DataFrame, pieces: DataFrame) -> DataFrame:
    """``child_id`` of children that hold a code unit of their own."""
    code = pieces.where("kind = 'code'").select("unit_id").distinct()
    return children.select("child_id", F.explode("unit_ids").alias("unit_id")).join(code, "unit_id", "left_semi").select("child_id").distinct()


def metrics(documents: DataFrame, pages: DataFrame, parents: DataFrame, children: DataFrame, pieces: DataFrame, chunk: ChunkConfig) -> DataFrame:
    """One row per document with all metrics."""
    ev = _evaluated(children).join(_code_children(children, pieces).withColumn("is_code", F.lit(True)), "child_id", "left").withColumn("is_code", F.coalesce("is_code", F.lit(False)))
    body, n = F.col("text"), F.col("token_estimate")
    per_child = ev.groupBy("document_id").agg(
        F.count("*").alias("evaluated"), duplicate_ratio(body).alias("duplicate_child_ratio"), share(n < 100).alias("short_child_ratio"), share(n < chunk.min_tokens).alias("under_min_ratio"),
        share(n > chunk.target_tokens).alias("over_target_ratio"), share(F.size("heading_path") <= 1).alias("flat_path_ratio"), share(~F.col("is_code") & T.starts_mid_sentence(T.squeeze(body)), ~F.col("is_code")).alias("mid_sentence_ratio"),
        share(T.has_broken_cjk_line(body)).alias("broken_line_ratio"), share(F.col("is_code") & T.is_malformed_code(body), F.col("is_code")).alias("malformed_code_ratio"), share(T.has_glued_list(body)).alias("glued_list_ratio"),
        *[c.alias(f"child_tokens_{name}") for c, name in zip(percentiles(n), ["min", *PERCENTILES, "max"], strict=True)],
    )
    counts = children.groupBy("document_id").agg(F.count("*").alias("child_count"), F.count_if("index_enabled").alias("indexable_child_count"), share(~F.col("index_enabled")).alias("non_indexable_ratio"), F.percentile(F.size("unit_ids"), 0.5).alias("units_per_child_median"))
    kids = children.where("index_enabled").groupBy("parent_id").agg(F.count("*").alias("__kids"))
    p = parents.join(kids, "parent_id", "left").fillna(0, ["__kids"])
    some = p.groupBy("document_id").agg(F.max(F.col("__kids") > 0).alias("__some"))
    per_parent = p.join(some, "document_id").where("__kids > 0 OR NOT __some").groupBy("document_id").agg(
        F.count("*").alias("evaluated_parents"), share(F.col("__kids") == 1).alias("single_child_parent_ratio"), F.percentile("__kids", 0.5).alias("children_per_parent_median"),
        F.count_if(T.strip(F.col("title")).rlike(MULTI_LEVEL)).alias("hierarchical_titles"), share(T.is_suspicious_heading(F.col("title"))).alias("suspicious_heading_ratio"),
    )
    programs = pieces.where("kind = 'code'").withColumn("a", analyse_column(F.col("text"))).where("a.is_python").groupBy("document_id").agg(
        F.count("*").alias("python_units"), share(F.col("a.ast_parseable")).alias("ast_parseable_ratio"), share(F.col("a.indentation_issues") > 0).alias("indentation_issue_ratio"), share(F.col("a.split_identifiers") > 0).alias("split_identifier_ratio"),
        share(F.col("a.boundary_violations") > 0).alias("boundary_violation_ratio"),
    )
    cuts = pieces.groupBy("document_id").agg(F.count("*").alias("unit_count"), F.count_if(F.col("split_strategy") == "code_top_level").alias("function_level_pieces"))
    per_page = pages.groupBy("document_id").agg(F.count("*").alias("page_rows"), F.count_if("used_ocr").alias("ocr_pages"), F.count_if((F.col("layout_kind") == "complex") & (F.col("page_role") != "toc")).alias("complex_pages"), F.count_if(F.col("page_role") == "toc").alias("toc_pages"))
    all_parents = parents.groupBy("document_id").agg(F.count("*").alias("parent_count"))
    parts = [per_child, counts, per_parent, all_parents, programs, cuts, per_page]
    out = reduce(lambda a, b: a.join(b, "document_id", "left"), parts, documents.select("document_id", "file_name", "page_count"))
    return out.fillna(0).withColumn("ocr_page_ratio", F.col("ocr_pages") / F.greatest("page_count", F.lit(1)))


# Fixed values: (code, metric, setting, guard) of the warnings; a warning stands when the metric exceeds the setting.
RULES = [
    ("HIGH_DUPLICATE_RATIO", "duplicate_child_ratio", "max_duplicate_ratio", "child_count >= 10"),
    ("HIGH_OCR_RATIO", "ocr_page_ratio", "max_ocr_ratio", "true"),
    ("HIGH_SHORT_CHILD_RATIO", "short_child_ratio", "max_short_child_ratio", "child_count >= 10 AND target >= 200"),
    ("HIGH_UNDER_MIN_TOKEN_RATIO", "under_min_ratio", "max_under_min_ratio", "child_count >= 10"),
    ("HIGH_SINGLE_CHILD_PARENT_RATIO", "single_child_parent_ratio", "max_single_child_parent_ratio", "evaluated_parents >= 8"),
    ("FLAT_HEADING_HIERARCHY", "flat_path_ratio", "max_flat_path_ratio", "hierarchical_titles >= 3"),
    ("SUSPICIOUS_HEADING_RATIO", "suspicious_heading_ratio", "max_suspicious_heading_ratio", "evaluated_parents >= 5"),
    ("MID_SENTENCE_CHUNK_STARTS", "mid_sentence_ratio", "max_mid_sentence_ratio", "true"),
    ("BROKEN_CJK_LINE_RATIO", "broken_line_ratio", "max_broken_line_ratio", "true"),
    ("MALFORMED_CODE_CHUNK_RATIO", "malformed_code_ratio", "max_malformed_code_ratio", "true"),
    ("PYTHON_AST_FAILURE_RATIO", "1 - ast_parseable_ratio", "max_ast_failure_ratio", "python_units > 0"),
    ("CODE_INDENTATION_ISSUE_RATIO", "indentation_issue_ratio", "max_indentation_issue_ratio", "python_units > 0"),
    ("SPLIT_IDENTIFIER_CANDIDATE_RATIO", "split_identifier_ratio", "max_split_identifier_ratio", "python_units > 0"),
    ("FUNCTION_BOUNDARY_VIOLATION_RATIO", "boundary_violation_ratio", "max_boundary_violation_ratio", "python_units > 0"),
    ("GLUED_LIST_PARAGRAPH_RATIO", "glued_list_ratio", "max_glued_list_ratio", "true"),
    ("COMPLEX_LAYOUT_PAGES", "complex_pages", "0", "true"),
]
ISSUE = ["document_id", "severity", "code", "message", "context"]


def warnings(m: DataFrame, chunk: ChunkConfig, config: QualityConfig) -> DataFrame:
    """The warnings and notes that metrics give rise to; the OCR share warns from its threshold on, others beyond it."""
    found = []
    for code, metric, setting, guard in RULES:
        limit = 0 if setting == "0" else getattr(config, setting)
        sign = ">=" if code == "HIGH_OCR_RATIO" else ">"
        holds = F.expr(f"({guard.replace('target', str(chunk.target_tokens))}) AND ({metric}) {sign} {limit}")
        detail = F.to_json(F.struct(F.expr(metric).cast("double").alias("value"), F.lit(float(limit)).alias("limit")))
        found.append(F.when(holds, F.struct(F.lit("warning").alias("severity"), F.lit(code).alias("code"), F.lit(f"{metric} {sign} {limit}").alias("message"), detail.alias("context"))))
    note = F.when(F.col("non_indexable_ratio") > 0, F.struct(F.lit("info").alias("severity"), F.lit("NON_INDEXABLE_NAVIGATION_CHUNKS").alias("code"), F.lit("some children are not indexed").alias("message"), F.to_json(F.struct(F.col("non_indexable_ratio").alias("value"))).alias("context")))
    return m.select("document_id", F.explode(F.array_compact(F.array(*found, note))).alias("i")).select("document_id", "i.*")


def broken_links(children: DataFrame) -> DataFrame:
    """Links of children to a neighbour that does not exist: ``child_id, document_id, code``."""
    ids = children.select(F.col("child_id").alias("__id"))
    side = lambda c, code: children.where(F.col(c).isNotNull()).join(ids, F.col(c) == F.col("__id"), "left_anti").select("child_id", "document_id", F.lit(code).alias("code"))
    return side("previous_child_id", "BROKEN_PREVIOUS_LINK").unionByName(side("next_child_id", "BROKEN_NEXT_LINK"))


def errors(documents: DataFrame, parents: DataFrame, children: DataFrame, pieces: DataFrame, chunk: ChunkConfig) -> DataFrame:
    """What must not be: empty documents, orphans, children too large or empty, broken links."""
    issue = lambda df, code, key: df.select("document_id", F.lit("error").alias("severity"), (F.lit(code) if isinstance(code, str) else code).alias("code"), F.lit("").alias("message"), F.to_json(F.struct(key)).alias("context"))
    missing = lambda df: documents.join(df, "document_id", "left_anti")
    return reduce(DataFrame.unionByName, [
        issue(documents.where("coalesce(page_count, 0) <= 0"), "EMPTY_DOCUMENT", "document_id"), issue(missing(pieces), "NO_ATOMIC_UNITS", "document_id"), issue(missing(children), "NO_CHILD_CHUNKS", "document_id"),
        issue(children.join(parents, "parent_id", "left_anti"), "ORPHAN_CHILD", "child_id"), issue(children.where(F.col("token_estimate") > chunk.max_tokens), "CHILD_TOO_LARGE", "child_id"),
        issue(children.where(T.strip(T.text_of(F.col("text"))) == ""), "EMPTY_CHILD", "child_id"), issue(broken_links(children), F.col("code"), "child_id"),
    ])


def validate(documents: DataFrame, pages: DataFrame, parents: DataFrame, children: DataFrame, pieces: DataFrame, chunk: ChunkConfig, config: QualityConfig | None = None) -> tuple[DataFrame, DataFrame]:
    """The report, one row per document with ``readiness``, and the long table of issues. With ``fail_on_error`` any
    error raises when the report is computed."""
    config = config or QualityConfig()
    m = metrics(documents, pages, parents, children, pieces, chunk)
    issues = errors(documents, parents, children, pieces, chunk).unionByName(warnings(m, chunk, config))
    worst = issues.groupBy("document_id").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    report = m.join(worst, "document_id", "left").fillna(0, ["errors", "warnings"])
    ready = F.when(F.col("errors") > 0, "blocked").when(F.col("warnings") > 0, "review").otherwise("ready")
    if config.fail_on_error:
        ready = F.when(F.col("errors") > 0, F.raise_error(F.concat(F.lit("quality errors in "), F.col("document_id")))).otherwise(ready)
    return report.withColumn("readiness", ready), issues


AUDIT_CHILD = "child_id string, parent_id string, token_estimate int, heading_path array<string>, text string, unit_ids array<string>, metadata struct<index_enabled:boolean>"
AUDIT_PARENT = "parent_id string, title string"
AUDIT_UNIT = "unit_id string, kind string, text string"


#: Examples that an audit gives of each kind.
EXAMPLES = 10


def _listed(few: DataFrame, item: Column, name: str) -> DataFrame:
    """One row with the ``x`` of a few items, in the order of their ids."""
    return few.agg(F.transform(F.array_sort(F.collect_list(item)), lambda s: s.x).alias(name))


def audit(children: DataFrame, parents: DataFrame, units: DataFrame | None = None, min_tokens: int = 180, target_tokens: int = 500, max_tokens: int = 800) -> DataFrame:
    """One row that judges stored chunks: counts, ratios (6 digits), percentiles (3 digits), examples and a verdict."""
    c = children.withColumn("__on", F.coalesce("metadata.index_enabled", F.lit(True))) if "metadata" in children.columns else children.withColumn("__on", F.lit(True))
    c = c.withColumns({"n": F.coalesce("token_estimate", F.lit(0)), "t": T.text_of(F.col("text"))})
    some = c.agg(F.coalesce(F.bool_or("__on"), F.lit(False)).alias("some"))
    ev = c.join(F.broadcast(some), F.col("__on") | ~F.col("some")).drop("some")  # one row
    program = None
    if units is not None:
        code = units.where("kind = 'code'")
        holds = ev.select("child_id", F.explode("unit_ids").alias("unit_id")).join(code, "unit_id", "left_semi").select("child_id").distinct().withColumn("is_code", F.lit(True))
        ev = ev.join(holds, "child_id", "left")
        a = code.withColumn("a", analyse_column(F.col("text"))).where("a.is_python")
        ratio = lambda cond: F.when(F.count("*") > 0, F.bround(share(cond), 6))
        program = a.agg(
            F.count("*").alias("python_code_unit_count"), ratio(F.col("a.ast_parseable")).alias("python_ast_parseable_ratio"), ratio(F.col("a.indentation_issues") > 0).alias("code_indentation_issue_ratio"),
            ratio(F.col("a.split_identifiers") > 0).alias("split_identifier_candidate_ratio"), ratio(F.col("a.boundary_violations") > 0).alias("function_boundary_violation_ratio"),
        )
        wrong = a.where("a.syntax_error IS NOT NULL").orderBy("unit_id").limit(EXAMPLES)
        program = program.join(F.broadcast(_listed(wrong, F.struct("unit_id", F.col("a.syntax_error").alias("x")), "python_syntax_errors")))
    else:
        ev = ev.withColumn("is_code", F.lit(None).cast("boolean"))
    mid = F.col("is_code").isNull() & T.starts_mid_sentence(T.squeeze(F.col("t")))
    r6 = lambda x: F.bround(x, 6)
    first = lambda cond, size, name: _listed(ev.where(cond).orderBy("child_id").limit(EXAMPLES), F.struct("child_id", F.substring("t", 1, size).alias("x")), name)
    shortest = ev.orderBy("n", "child_id").limit(EXAMPLES).agg(F.array_sort(F.collect_list(F.struct(F.col("n").alias("tokens"), "child_id", F.substring("t", 1, 100).alias("text")))).alias("short_children"))
    one = ev.agg(
        F.count("*").alias("indexable_child_count"), r6(duplicate_ratio(F.col("t"))).alias("duplicate_child_ratio"), r6(share(F.col("n") < 100)).alias("short_child_ratio_lt_100"), r6(share(F.col("n") < min_tokens)).alias("under_min_tokens_ratio"),
        r6(share(F.col("n") > target_tokens)).alias("over_target_tokens_ratio"), F.count_if(F.col("n") > max_tokens).alias("over_max_tokens_count"), r6(share(F.coalesce(F.size("heading_path"), F.lit(0)) <= 1)).alias("flat_heading_path_ratio"),
        r6(share(mid)).alias("mid_sentence_start_ratio"), r6(share(T.has_broken_cjk_line(F.col("t")))).alias("broken_line_candidate_ratio"),
        *[F.bround(F.coalesce(x, F.lit(0)).cast("double"), 3).alias(f"child_token_{name}") for x, name in zip(percentiles(F.col("n")), ["min", *PERCENTILES, "max"], strict=True)],
    )
    kids = ev.groupBy("parent_id").agg(F.count("*").alias("kids"))
    p = parents.join(kids, "parent_id", "left").fillna(0, ["kids"])
    linked = p.agg(F.coalesce(F.bool_or(F.col("kids") > 0), F.lit(False)).alias("some"))
    p = p.join(F.broadcast(linked), (F.col("kids") > 0) | ~F.col("some"))  # one row
    two = p.agg(
        F.count("*").alias("indexable_parent_count"), r6(share(F.col("kids") == 1)).alias("single_child_parent_ratio"), F.count_if(T.strip(F.col("title")).rlike(MULTI_LEVEL)).alias("multi_level_numbered_parent_count"),
        r6(share(T.is_suspicious_heading(F.col("title")))).alias("suspicious_heading_ratio"), F.coalesce(F.percentile("kids", 0.5), F.lit(0.0)).alias("children_per_parent_median"),
    )
    rows = [one, shortest, first(mid, 120, "mid_sentence_starts"), first(T.has_broken_cjk_line(F.col("t")), 160, "broken_line_candidates"), two, children.agg(F.count("*").alias("child_count")), parents.agg(F.count("*").alias("parent_count")), *([program] if program is not None else [])]
    key = F.lit(1).alias("__k")
    whole = reduce(lambda a, b: a.join(b.select("*", key), "__k"), rows[1:], rows[0].select("*", key)).drop("__k")
    if program is None:
        none = lambda kind: F.lit(None).cast(kind)
        whole = whole.withColumns({"python_code_unit_count": F.lit(0).cast("long"), **{k: none("double") for k in ("python_ast_parseable_ratio", "code_indentation_issue_ratio", "split_identifier_candidate_ratio", "function_boundary_violation_ratio")}, "python_syntax_errors": F.array().cast("array<string>")})
    return whole.withColumn("verdict", audit_verdict())


def audit_verdict() -> Column:
    """``not_ready``, ``review`` or ``ready`` from an audit's columns."""
    # The limits of the verdict.
    severe = "over_max_tokens_count > 0 OR short_child_ratio_lt_100 > 0.15 OR single_child_parent_ratio > 0.7 OR mid_sentence_start_ratio > 0.08 OR broken_line_candidate_ratio > 0.25"
    doubtful = (
        "short_child_ratio_lt_100 > 0.10 OR under_min_tokens_ratio > 0.25 OR single_child_parent_ratio > 0.60 OR suspicious_heading_ratio > 0.12 OR mid_sentence_start_ratio > 0.03 OR broken_line_candidate_ratio > 0.10 "
        "OR (multi_level_numbered_parent_count >= 3 AND flat_heading_path_ratio > 0.95) OR (python_ast_parseable_ratio IS NOT NULL AND (python_ast_parseable_ratio < 0.65 OR code_indentation_issue_ratio > 0.20 "
        "OR split_identifier_candidate_ratio > 0.10 OR function_boundary_violation_ratio > 0.10))"
    )
    return F.when(F.expr(severe), "not_ready").when(F.expr(doubtful), "review").otherwise("ready")
