"""Queries of the layout, structure, audit and program text operators over a layout made from ``orders``.

The tables hold no page layouts, so every order stands for a block whose place, fonts and text follow from its key. The
same expressions make it here and in the SQL, which then states what the operators are to give.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from vellum.config import ChunkConfig, ParserConfig
from vellum.functions import code, fixed
from vellum.functions import geometry as G
from vellum.functions import text as T
from vellum.operators import chunking, layout, quality, retrieval, structure
from vellum.plans.relational import query, read
from vellum.sources import writers

K = "o_orderkey"
TEXTS = [
    "第三章 总则", "2.1 Scope of the report", "3. Payment", "一、概述", "（二）范围", "Page 4", "Confidential copy 12", "The service is used, among others, by partners, and it may take long.",
    "Short title", "def area(w, h):\n    return w * h;\nx = area(1, 2);", "1.1 First entry", "- item one\n- item two", "Q: what is it?\nA: a thing", "注意：需要说明", "plain words that go on without any end", "●●",
]
_quote = lambda t: "concat(" + ", chr(10), ".join(f"'{x}'" for x in t.split("\n")) + ")" if "\n" in t else f"'{t}'"
TEXT = f"CASE {K} % {len(TEXTS)} " + " ".join(f"WHEN {k} THEN {_quote(t)}" for k, t in enumerate(TEXTS)) + " END"
#: Columns of a block as expressions that Spark and DuckDB both read.
BLOCK = {
    "document_id": "concat('d', CAST(o_custkey % 300 AS STRING))", "page_number": f"CAST({K} % 3 + 1 AS INT)", "block_no": f"CAST({K} AS INT)", "x0": f"CAST({K} * 37 % 400 AS DOUBLE)", "y0": f"CAST({K} * 53 % 800 AS DOUBLE)",
    "x1": f"CAST({K} * 37 % 400 + 20 + {K} % 150 AS DOUBLE)", "y1": f"CAST({K} * 53 % 800 + 12 + {K} % 3 * 10 AS DOUBLE)", "text": TEXT, "max_font_size": f"CAST(10 + {K} % 9 AS DOUBLE)",
    "avg_font_size": f"CAST(10 + {K} % 5 AS DOUBLE)", "bold": f"({K} % 4 = 0)", "monospace": f"({K} % 16 = 9)",
}
PAGE_OF = {"width": "CAST(595 AS DOUBLE)", "height": "CAST(842 AS DOUBLE)"}
_list = lambda columns: ", ".join(f"{e} AS {c}" for c, e in columns.items())
B = f"b AS (SELECT {_list(BLOCK)} FROM orders), p AS (SELECT document_id, page_number, {_list(PAGE_OF)}, count(*) AS n_blocks FROM b GROUP BY ALL)"
#: Settings under which pages of contents and repeated lines occur in this layout.
CONFIG = ParserConfig(toc_min_numbered_entries=3)

_any = lambda words: "(?:" + "|".join(words) + ")"
V = r"length(regexp_replace({0}, '\s', '', 'g'))"
COMMAS = "(length({0}) - length(translate({0}, '，,', '')))"
MATCH = "regexp_matches({0}, '{1}')"
PROSE = (
    f"({MATCH.format('{0}', '[。！？!?；;，,]$')} OR {COMMAS} >= 2 OR ({MATCH.format('{0}', '[：:]')} AND {V.format(r'''regexp_extract({0}, '^[^：:]*[：:]((?:.|\n)*)$', 1)''')} >= 12) "
    f"OR ({V} > 36 AND {MATCH.format('{0}', _any(fixed.EXPLANATORY))}) OR {V} > 52)"
)
LIST_LINE = MATCH.format("{0}", fixed.LIST_ITEM)


def blocks_of(spark, d):
    made = read(spark, d, "orders").selectExpr(*[f"{e} AS {c}" for c, e in BLOCK.items()])
    return made.withColumns({"heading_level": F.lit(None).cast("int"), "heading_source": F.lit(None).cast("string"), "source": F.lit("native"), "lines": F.array().cast("array<struct<text:string,x0:double>>")})


def pages_of(blocks):
    return blocks.groupBy("document_id", "page_number").agg(F.count("*").alias("n_blocks")).selectExpr("document_id", "page_number", "n_blocks", *[f"{e} AS {c}" for c, e in PAGE_OF.items()])


@query(f"WITH {B}, s AS (SELECT document_id, page_number, sum({V.format('text')}) AS chars FROM b GROUP BY ALL) SELECT document_id, page_number, chars < 30 AS needs_ocr FROM s")
def q_ocr_gate(spark, d):
    """S3: pages with few characters go to recognition."""
    chars = blocks_of(spark, d).groupBy("document_id", "page_number").agg(F.sum(T.visible_chars(F.col("text"))).alias("chars"))
    return chars.select("document_id", "page_number", layout.needs_ocr(F.col("chars"), CONFIG).alias("needs_ocr"))


BOX = {"x0": "CAST(50 AS DOUBLE)", "y0": "CAST(100 + p_partkey % 300 AS DOUBLE)", "x1": "CAST(400 AS DOUBLE)", "y1": "CAST(300 + p_partkey % 300 + p_partkey % 200 AS DOUBLE)"}
#: Rows of a table, one to four of them, some with holes, one ragged.
ROWS = ["array(p_name, p_brand, p_type)", "array(CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END, CAST(p_size AS STRING), repeat('long cell ', CAST(p_partkey % 25 AS INT)))", "array(p_name, '', CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'x|y' END)", "array(p_brand)"]
TABLE_ROWS = f"slice(array({', '.join(ROWS)}), 1, CAST(p_partkey % 4 + 1 AS INT))"
SQL_ROWS = f"list_slice([{', '.join(r.replace('array(', '[', 1)[:-1] + ']' for r in ROWS)}], 1, CAST(p_partkey % 4 + 1 AS INT))"


@query(
    f"""WITH t AS (SELECT p_partkey, {SQL_ROWS} AS r, {_list(BOX)} FROM part),
    f AS (SELECT *, len(r) AS n, list_transform(r, lambda x: len(x)) AS w, list_filter(flatten(r), lambda c: trim(c) <> '') AS cells, list_transform(r, lambda x: len(list_filter(x, lambda c: trim(c) <> ''))) AS live FROM t),
    g AS (SELECT *, list_max(w) AS m, list_transform(cells, lambda c: {V.format('c')}) AS sizes FROM f),
    h AS (SELECT *, len(cells) / greatest(n * m, 1) AS filled, len(list_filter(live, lambda x: x <= 1)) / n AS single, len(list_filter(sizes, lambda x: x > 160)) / greatest(len(cells), 1) AS long,
          coalesce(list_sum(sizes), 0) / greatest(len(cells), 1) AS mean, list_max(list_transform(w, lambda a: len(list_filter(w, lambda b: b = a)))) / n AS modal, (x1 - x0) * (y1 - y0) / (595.0 * 842.0) AS area FROM g),
    i AS (SELECT *, CASE WHEN n < 2 OR m < 2 THEN ['rows_or_columns_too_few'] WHEN filled < 0.45 THEN ['nonempty_ratio_too_low'] ELSE list_filter([CASE WHEN single > 0.5 THEN 'too_many_single_cell_rows' END,
          CASE WHEN long > 0.35 THEN 'too_many_narrative_cells' END, CASE WHEN n <= 3 AND mean > 65 THEN 'small_narrative_layout' END, CASE WHEN area > 0.72 AND n <= 3 THEN 'large_page_textbox_like' END,
          CASE WHEN filled < 0.6 THEN 'sparse_cells' END, CASE WHEN modal < 0.7 THEN 'inconsistent_columns' END], lambda x: x IS NOT NULL) END AS reasons FROM h)
    SELECT p_partkey, reasons, CASE WHEN n < 2 OR m < 2 OR filled < 0.45 THEN 0.0 ELSE round(greatest(0.0, least(1.0, 0.42 + least(filled, 1.0) * 0.18 + modal * 0.16 + CASE WHEN n >= 3 THEN 0.12 ELSE 0.05 END
      + CASE WHEN m >= 3 THEN 0.12 ELSE 0.06 END - CASE WHEN single > 0.5 THEN 0.32 ELSE 0 END - CASE WHEN long > 0.35 THEN 0.28 ELSE 0 END - CASE WHEN n <= 3 AND mean > 65 THEN 0.25 ELSE 0 END
      - CASE WHEN area > 0.72 AND n <= 3 THEN 0.25 ELSE 0 END - CASE WHEN filled < 0.6 THEN 0.08 ELSE 0 END - CASE WHEN modal < 0.7 THEN 0.08 ELSE 0 END)), 6) END AS score FROM i"""
)
def q_table_scores(spark, d):
    """How much tables made of parts look like tables."""
    t = read(spark, d, "part").selectExpr("p_partkey", f"{TABLE_ROWS} AS rows", *[f"{e} AS {c}" for c, e in BOX.items()])
    scored = t.withColumn("s", layout.score_table(F.col("rows"), tuple(map(F.col, BOX)), F.lit(595.0 * 842.0), CONFIG))
    return scored.select("p_partkey", F.col("s.reasons").alias("reasons"), F.round("s.score", 6).alias("score"))


CELL = "replace(replace(c, '|', '\\|'), chr(10), '<br>')"


@query(
    f"""WITH t AS (SELECT p_partkey, {SQL_ROWS} AS r FROM part), m AS (SELECT *, list_max(list_transform(r, lambda x: len(x))) AS w FROM t),
    l AS (SELECT p_partkey, w, list_transform(r, lambda x: '| ' || array_to_string(list_transform(list_resize(x, w, ''), lambda c: {CELL}), ' | ') || ' |') AS lines FROM m)
    SELECT p_partkey, array_to_string(list_concat([lines[1], '| ' || array_to_string(list_transform(range(w), lambda i: '---'), ' | ') || ' |'], lines[2:]), chr(10)) AS markdown FROM l"""
)
def q_table_markdown(spark, d):
    """Tables as Markdown."""
    return read(spark, d, "part").selectExpr("p_partkey", f"{TABLE_ROWS} AS rows").select("p_partkey", T.table_to_markdown(F.col("rows")).alias("markdown"))


TABLE = {"document_id": "concat('d', CAST(c_custkey % 300 AS STRING))", "page_number": "CAST(c_custkey % 3 + 1 AS INT)", "x0": "CAST(c_custkey % 100 AS DOUBLE)", "y0": "CAST(c_custkey * 7 % 500 AS DOUBLE)", "x1": "CAST(c_custkey % 100 + 300 AS DOUBLE)", "y1": "CAST(c_custkey * 7 % 500 + 120 AS DOUBLE)"}
SHARE = "(greatest(least(b.x1, t.x1) - greatest(b.x0, t.x0), 0) * greatest(least(b.y1, t.y1) - greatest(b.y0, t.y0), 0) / ((b.x1 - b.x0) * (b.y1 - b.y0)))"


@query(
    f"WITH {B}, t AS (SELECT {_list(TABLE)} FROM customer) SELECT document_id, page_number, block_no FROM b WHERE NOT EXISTS "
    f"(SELECT 1 FROM t WHERE t.document_id = b.document_id AND t.page_number = b.page_number AND {SHARE} >= 0.72)"
)
def q_blocks_outside_tables(spark, d):
    """Blocks that no table covers."""
    tables = read(spark, d, "customer").selectExpr(*[f"{e} AS {c}" for c, e in TABLE.items()])
    return layout.drop_blocks_in_tables(blocks_of(spark, d), tables, 0.72).select("document_id", "page_number", "block_no")


@query(
    f"WITH {B}, t AS (SELECT {_list(TABLE)} FROM customer) SELECT b.block_no, round(max({SHARE}), 9) AS share, round(max(greatest(least(b.x1, t.x1) - greatest(b.x0, t.x0), 0) / least(b.x1 - b.x0, t.x1 - t.x0)), 9) AS across "
    "FROM b JOIN t USING (document_id, page_number) GROUP BY b.block_no"
)
def q_overlaps(spark, d):
    """the largest shares that blocks have in common with tables of their page."""
    b, t = blocks_of(spark, d).alias("b"), read(spark, d, "customer").selectExpr(*[f"{e} AS {c}" for c, e in TABLE.items()]).distinct().alias("t")  # equal boxes cover alike
    box = lambda x: tuple(F.col(f"{x}.{c}") for c in ("x0", "y0", "x1", "y1"))
    across = G.horizontal_overlap(F.col("b.x0"), F.col("b.x1"), F.col("t.x0"), F.col("t.x1"))
    return b.join(t, ["document_id", "page_number"]).groupBy("block_no").agg(F.round(F.max(G.overlap_share(box("b"), box("t"))), 9).alias("share"), F.round(F.max(across), 9).alias("across"))


PATTERN = r"CASE WHEN {v} > 120 THEN '' ELSE regexp_replace(regexp_replace(regexp_replace(lower(text), '\d+', '#', 'g'), '\s+', '', 'g'), '[-–—_/\\|·•]+', '', 'g') END".format(v=V.format("text"))
ZONED = f"z AS (SELECT b.*, CASE WHEN y0 <= height * 0.08 OR y1 >= height * (1 - 0.08) THEN {PATTERN} END AS pattern FROM b JOIN p USING (document_id, page_number))"
REPEATED = (
    "c AS (SELECT document_id, count(*) AS n FROM p GROUP BY ALL), r AS (SELECT document_id, pattern, any_value(n) AS n, count(DISTINCT page_number) AS pages FROM z JOIN c USING (document_id) WHERE pattern <> '' GROUP BY document_id, pattern "
    "HAVING any_value(n) >= 2 AND count(DISTINCT page_number) >= greatest(2, ceil(any_value(n) * 0.35)))"
)


@query(f"WITH {B}, {ZONED}, {REPEATED} SELECT document_id, pattern FROM r")
def q_repeated_patterns(spark, d):
    """What tops and bottoms of pages repeat."""
    b = blocks_of(spark, d)
    return layout.repeated_patterns(b, pages_of(b), CONFIG)


@query(f"WITH {B}, {ZONED}, {REPEATED} SELECT document_id, page_number, block_no FROM z WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.document_id = z.document_id AND r.pattern = z.pattern)")
def q_without_headers_footers(spark, d):
    """Blocks without repeated headers and footers."""
    b = blocks_of(spark, d)
    return layout.drop_headers_footers(b, pages_of(b), CONFIG).select("document_id", "page_number", "block_no")


FONTS = (
    f"w AS (SELECT document_id, avg_font_size, sum(least(greatest({V.format('text')}, 1), 200)) AS w FROM b WHERE avg_font_size > 0 AND NOT monospace GROUP BY ALL), "
    "u AS (SELECT *, sum(w) OVER (PARTITION BY document_id ORDER BY avg_font_size) AS upto, sum(w) OVER (PARTITION BY document_id) AS total FROM w), "
    "f AS (SELECT document_id, min(avg_font_size) AS body_font_size FROM u WHERE 2 * upto >= total GROUP BY ALL)"
)


@query(f"WITH {B}, {FONTS} SELECT document_id, body_font_size FROM f")
def q_body_font(spark, d):
    """A2: body font sizes as weighted medians."""
    return layout.body_font_size(blocks_of(spark, d))


FLAT = "list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')"
KINDS = (
    f"q AS (SELECT b.*, width, {V.format('text')} AS size, (x0 + x1) / 2 AS center, {FLAT} AS flat FROM b JOIN p USING (document_id, page_number)), "
    f"facts AS (SELECT document_id, page_number, count(*) AS n, sum(size) AS chars, sum(CASE WHEN monospace THEN size ELSE 0 END) AS mono_chars, count(*) FILTER (monospace) AS mono, count(*) FILTER (size <= 24) AS short, "
    f"(max(center) - min(center)) / max(width) AS spread, quantile_cont(size, 0.5) AS median, count(DISTINCT round_even(center / width * 6, 0)) AS bands, count(*) FILTER ({MATCH.format('text', fixed.MULTI_NUMBER)} AND size <= 55) AS short_numbered, "
    f"sum(len(flat)) AS lines, sum(len(list_filter(flat, lambda x: {MATCH.format('x', fixed.TOC_ENTRY)}))) AS entries, sum(len(list_filter(flat, lambda x: {MATCH.format('x', fixed.MULTI_NUMBER)}))) AS entry_lines, "
    f"sum(coalesce(list_sum(list_transform(list_filter(flat, lambda x: {MATCH.format('x', fixed.MULTI_NUMBER)}), lambda x: {V.format('x')})), 0)) AS entry_chars FROM q GROUP BY ALL), "
    "kinds AS (SELECT *, CASE WHEN n <= 3 AND chars < 100 THEN 'sparse' WHEN n < 5 OR (mono >= 3 AND mono_chars >= greatest(chars, 1) * 0.55) THEN 'normal' "
    "WHEN (short >= n * 0.5 AND spread >= 0.28 AND median <= 36 AND bands >= 3) OR (page_number <= 2 AND short >= 4 AND bands >= 3 AND (spread >= 0.22 OR short_numbered >= 3)) THEN 'complex' ELSE 'normal' END AS layout_kind FROM facts), "
    "roles AS (SELECT *, CASE WHEN page_number <= 5 AND entries >= 3 AND coalesce(entry_chars / nullif(entry_lines, 0), 0) <= 42 THEN 'toc' WHEN page_number = 1 AND layout_kind = 'sparse' AND lines <= 4 THEN 'cover' "
    "WHEN layout_kind = 'complex' THEN 'complex' ELSE 'body' END AS page_role FROM kinds)"
)


@query(f"WITH {B}, {KINDS} SELECT document_id, page_number, layout_kind, page_role, page_role NOT IN ('toc', 'cover') AS index_enabled FROM roles")
def q_page_kinds(spark, d):
    """Kinds and roles of pages."""
    b = blocks_of(spark, d)
    return layout.classify_pages(pages_of(b), b, CONFIG).select("document_id", "page_number", "layout_kind", "page_role", "index_enabled")


M = lambda pattern: MATCH.format("text", pattern)
HEADINGS = (
    f"hs AS (SELECT b.*, height, layout_kind, page_role, coalesce(body_font_size, 0) AS body, max(max_font_size) OVER (PARTITION BY b.document_id, b.page_number) AS top, {V.format('text')} AS n, {PROSE.format('text')} AS prose, "
    f"len(string_split(regexp_extract(text, '{fixed.MULTI_NUMBER}', 1), '.')) AS depth FROM b JOIN p USING (document_id, page_number) JOIN roles USING (document_id, page_number) LEFT JOIN f USING (document_id)), "
    "hr AS (SELECT *, CASE WHEN body > 0 THEN max_font_size / body ELSE 0 END AS ratio FROM hs), "
    "ht AS (SELECT *, ratio >= 1.12 OR (bold AND ratio >= 1.04) AS styled FROM hr), "
    f"hd AS (SELECT *, CASE WHEN text = '' OR contains(text, chr(10)) OR n > 80 OR monospace OR {M(fixed.BULLETS)} THEN NULL "
    "WHEN layout_kind = 'complex' OR (layout_kind = 'sparse' AND page_number <= 2) THEN CASE WHEN top > 0 AND max_font_size >= top * 0.94 AND y0 <= height * 0.28 AND n <= 50 THEN '1complex_layout_dominant_title' END "
    f"WHEN {M(fixed.CHAPTER)} THEN CASE WHEN styled OR n <= 28 THEN '1chapter_pattern' END WHEN {M(fixed.CHAPTER_SECTION)} THEN CASE WHEN styled OR n <= 28 THEN '2section_pattern' END "
    f"WHEN {M(fixed.MULTI_NUMBER)} THEN CASE WHEN NOT prose AND (styled OR n <= 52) THEN CAST(least(depth, 6) AS STRING) || 'numeric_hierarchy' END "
    f"WHEN {M(fixed.SINGLE_NUMBER)} THEN CASE WHEN styled AND n <= 38 AND NOT prose THEN '1single_numeric_styled' END WHEN {M(fixed.NUMERAL_ITEM)} OR {M(fixed.PAREN_ITEM)} THEN CASE WHEN styled AND n <= 32 AND NOT prose THEN '2styled_chinese_number' END "
    "WHEN body <= 0 THEN CASE WHEN bold AND n <= 40 THEN '3bold_fallback' END WHEN ratio >= 1.60 AND n <= 60 THEN '1font_ratio' WHEN ratio >= 1.35 AND n <= 60 THEN '2font_ratio' WHEN ratio >= 1.16 AND n <= 52 AND NOT prose THEN '3font_ratio' "
    "WHEN bold AND ratio >= 1.03 AND n <= 42 AND NOT prose THEN '3bold_style' END AS h FROM ht)"
)


def _laid_out(spark, d):
    """Blocks with headings, and the kinds of their pages."""
    b = blocks_of(spark, d)
    kinds = layout.classify_pages(pages_of(b), b, CONFIG)
    return layout.detect_headings(b, kinds, layout.body_font_size(b), CONFIG), kinds


@query(f"WITH {B}, {FONTS}, {KINDS}, {HEADINGS} SELECT block_no, CAST(left(h, 1) AS INT) AS heading_level, substr(h, 2) AS heading_source FROM hd")
def q_headings(spark, d):
    """Headings by pattern, style and font size."""
    return _laid_out(spark, d)[0].select("block_no", "heading_level", "heading_source")


#: Accepted headings, the document's parts that share no headings, and paths: the last heading of each level that no later one of a lower level has closed.
ACCEPTED = (
    "ha AS (SELECT *, CAST(left(h, 1) AS INT) AS level, substr(h, 2) AS source, coalesce(h IS NOT NULL AND CASE WHEN layout_kind = 'complex' THEN substr(h, 2) = 'complex_layout_dominant_title' ELSE NOT prose AND "
    "CASE substr(h, 2) WHEN 'single_numeric_styled' THEN n <= 32 WHEN 'numeric_hierarchy' THEN n <= 60 WHEN 'font_ratio' THEN n <= 48 WHEN 'bold_style' THEN n <= 48 WHEN 'bold_fallback' THEN n <= 48 ELSE true END END, false) AS heading FROM hd)"
)
PATHS = (
    "po AS (SELECT document_id, page_number, sum(CASE WHEN odd THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY page_number) AS epoch FROM (SELECT document_id, page_number, "
    "lag(layout_kind IN ('complex', 'sparse') OR page_role IN ('toc', 'cover')) OVER w AND lag(page_number) OVER w <= 2 AS odd FROM roles WINDOW w AS (PARTITION BY document_id ORDER BY page_number))), "
    "e AS (SELECT ha.*, epoch, row_number() OVER (PARTITION BY document_id ORDER BY page_number, y0, x0, block_no) AS pos, CASE WHEN heading THEN lower(replace(text, ' ', '')) END AS canon FROM ha JOIN po USING (document_id, page_number)), "
    "e1 AS (SELECT *, last_value(canon IGNORE NULLS) OVER (PARTITION BY document_id, epoch ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM e), "
    "e2 AS (SELECT *, heading AND (before IS NULL OR before <> canon) AS starts FROM e1), "
    "e3 AS (SELECT *, " + ", ".join(f"max(CASE WHEN starts AND level = {k} THEN pos END) OVER o AS l{k}" for k in range(1, 7)) + ", max(CASE WHEN starts THEN pos END) OVER o AS newest, "
    "sum(CASE WHEN starts OR epoch <> coalesce(previous, 0) THEN 1 ELSE 0 END) OVER (PARTITION BY document_id ORDER BY pos) AS section_seq FROM (SELECT *, lag(epoch) OVER (PARTITION BY document_id ORDER BY pos) AS previous FROM e2) "
    "WINDOW o AS (PARTITION BY document_id, epoch ORDER BY pos)), "
    "e4 AS (SELECT document_id, block_no, pos, section_seq, newest, unnest([" + ", ".join(f"CASE WHEN l{k} IS NOT NULL" + "".join(f" AND (l{j} IS NULL OR l{j} < l{k})" for j in range(1, k)) + f" THEN l{k} END" for k in range(1, 7)) + "]) AS at, "
    "unnest([1, 2, 3, 4, 5, 6]) AS k FROM e3 WHERE NOT heading)"
)


@query(
    f"WITH {B}, {FONTS}, {KINDS}, {HEADINGS}, {ACCEPTED}, {PATHS} SELECT e4.block_no, any_value(e4.section_seq) AS section_seq, coalesce(string_agg(t.text, ' > ' ORDER BY k) FILTER (e4.at IS NOT NULL), '') AS path, "
    f"coalesce(any_value(s.text), '{fixed.DEFAULT_TITLE}') AS title FROM e4 LEFT JOIN e AS t ON t.document_id = e4.document_id AND t.pos = e4.at LEFT JOIN e AS s ON s.document_id = e4.document_id AND s.pos = e4.newest GROUP BY e4.block_no"
)
def q_heading_paths(spark, d):
    """The heading path of every block."""
    blocks, kinds = _laid_out(spark, d)
    tables = spark.createDataFrame([], layout.TABLES)
    placed = structure.heading_paths(structure.elements(blocks, tables, kinds, CONFIG))
    return placed.select(F.col("no").alias("block_no"), F.col("section_seq").cast("long").alias("section_seq"), F.array_join("heading_path", " > ").alias("path"), "title")


DENSE = (
    f"(len({FLAT}) >= 3 AND (len(list_filter({FLAT}, lambda x: regexp_matches(trim(x), '(?i){fixed.CODE_SIGN}'))) + len(list_filter({FLAT}, lambda x: regexp_matches(trim(x), '^(?:```|\\$ |>>> )'))) >= len({FLAT}) * 0.45 "
    "OR length(text) - length(translate(text, '{}[]();=<>', '')) >= greatest(length(text), 1) * 0.08))"
)


@query(
    f"WITH {B}, {KINDS} SELECT block_no, CASE WHEN monospace OR {DENSE} THEN 'code' WHEN layout_kind IN ('complex', 'sparse') AND {V.format('text')} <= 80 THEN 'layout' "
    f"WHEN regexp_matches(text, '(?i){fixed.QUESTION}') AND regexp_matches(text, '(?i){fixed.ANSWER}') THEN 'faq' WHEN regexp_matches(text, '(?i){fixed.CALLOUT}') THEN 'callout' "
    f"WHEN len(list_filter(string_split(text, chr(10)), lambda x: {LIST_LINE.replace('{0}', 'trim(x)')})) >= 1 THEN 'list' ELSE 'paragraph' END AS kind FROM b JOIN kinds USING (document_id, page_number)"
)
def q_unit_kinds(spark, d):
    """Kinds of units of text."""
    blocks, kinds = _laid_out(spark, d)
    return blocks.join(kinds.select("document_id", "page_number", "layout_kind"), ["document_id", "page_number"]).select("block_no", structure.classify(F.col("text")).alias("kind"))


RULES = {
    "promotion": (T.is_promotion, fixed.PROMOTION, "(?i)"), "page_number": (T.is_page_number, fixed.PAGE_NUMBER, "(?i)"), "opens": (T.opens_paragraph, "^" + _any(fixed.PARAGRAPH_OPENERS), ""), "ends": (T.ends_sentence, fixed.SENTENCE_END, ""),
    "list_line": (T.is_list_line, fixed.LIST_ITEM, ""), "cjk": (T.contains_cjk, fixed.CJK, ""), "broken_cjk": (T.has_broken_cjk_line, rf"{fixed.CJK_WIDE}\n{{2,}}{fixed.CJK_WIDE}", ""),
    "glued": (T.has_glued_list, rf"(?:^|\n)\s*\d+[.)、]\s*[^\n。！？!?]{{18,}}{_any(fixed.GLUED_OPENERS)}", ""), "mid_sentence": (T.starts_mid_sentence, f"^{_any(fixed.SUSPICIOUS_OPENINGS)}|{fixed.LATIN_CONTINUATION}", ""),
}
LINES = [
    "更多课程联系微信:abcd1234", "扫码关注公众号 name-1", "12 / 40", "page 7", "因此，结果如下。", "所以", "1) 第一步处理输入的数据并且把结果写到指定的表格里面然后上述流程结束", "翻\n\n阅", "们的", "lower start", "Upper start.", "(3) item",
    "一、标题", "done!", "", "1 2 3", "4 6 7", "Copy code", "问题：这是什么，那是什么，还有什么", "3. 第三个要点，需要说明，很长的一段文字用于测试这里的规则是否成立吗这样可以了",
]
LINE = f"CASE {K} % {len(LINES)} " + " ".join(f"WHEN {k} THEN {_quote(t)}" for k, t in enumerate(LINES)) + " END"


def _lines(spark, d):
    return read(spark, d, "orders").selectExpr(K, f"{LINE} AS line")


@query(f"WITH l AS (SELECT {K}, {LINE} AS line FROM orders) SELECT {K}, " + ", ".join(f"regexp_matches(line, '{flags}{pattern}') AS {name}" for name, (_, pattern, flags) in RULES.items()) + " FROM l")
def q_line_rules(spark, d):
    """Patterns of lines."""
    return _lines(spark, d).select(K, *[rule(F.col("line")).alias(name) for name, (rule, _, _) in RULES.items()])


@query(
    f"WITH l AS (SELECT {K}, {LINE} AS line FROM orders) SELECT {K}, line <> '' AND {PROSE.format('line')} AS like_sentence, "
    f"line = '' OR {MATCH.format('line', fixed.SENTENCE_END)} OR (regexp_matches(line, '^\\d+[、.]\\s*') AND ({V.format('line')} > 38 OR (regexp_matches(line, '[:：]') AND {V.format('line')} > 28))) OR {COMMAS.format('line')} >= 2 AS suspicious, "
    f"line <> '' AND NOT {LIST_LINE.replace('{0}', 'line')} AND (regexp_matches(line, '^{_any(fixed.CONTINUATIONS)}') OR regexp_matches(line, '{fixed.LATIN_CONTINUATION}') OR regexp_matches(line, '^{fixed.CJK}')) AS continues, "
    f"line = '' OR regexp_matches(line, '{fixed.BULLETS}') OR regexp_matches(line, '(?i){fixed.UI_LABEL}') OR regexp_matches(line, '{fixed.NUMBER_STRIP}') OR line = '1 2 3' AS noise FROM l"
)
def q_sentence_rules(spark, d):
    """Sentences, headings that look wrong, continuations and noise."""
    line = F.col("line")
    return _lines(spark, d).select(K, T.like_sentence(line).alias("like_sentence"), T.is_suspicious_heading(line).alias("suspicious"), T.continues(line).alias("continues"), T.is_noise(line).alias("noise"))


#: Lines with tabs, spaces at both ends, invisible characters and full-width signs.
RAW = f"concat('  a', chr(9), ' b', repeat(' ', CAST({K} % 4 AS INT)), 'c', chr(173), 'd', chr(10), CASE WHEN {K} % 3 = 0 THEN '  ' WHEN {K} % 3 = 1 THEN '●' ELSE concat('x', chr(9), 'y ') END, chr(10), 'Ａ', CAST({K} % 100 AS STRING), '  ')"
A = f"('a b' || CASE {K} % 4 WHEN 0 THEN '' ELSE ' ' END || 'cd')"
TAIL = f"'A' || CAST({K} % 100 AS STRING)"


@query(
    f"SELECT {K}, {A} || chr(10) || CASE {K} % 3 WHEN 0 THEN ' ' WHEN 1 THEN '●' ELSE 'x y ' END || chr(10) || {TAIL} AS inline, "
    f"{A} || chr(10) || CASE {K} % 3 WHEN 0 THEN '' WHEN 1 THEN '●' || chr(10) ELSE 'x y' || chr(10) END || {TAIL} AS multiline, {A} || chr(10) || CASE {K} % 3 WHEN 2 THEN 'x y' || chr(10) ELSE '' END || {TAIL} AS clean, "
    f"'  a' || '     b' || repeat(' ', CAST({K} % 4 AS INT)) || 'cd' || chr(10) || CASE {K} % 3 WHEN 0 THEN '  ' WHEN 1 THEN '●' ELSE 'x    y ' END || chr(10) || {TAIL} AS code FROM orders"
)
def q_normalized_text(spark, d):
    """Normalised, cleaned and program text."""
    t = F.col("raw")
    return read(spark, d, "orders").selectExpr(K, f"{RAW} AS raw").select(K, T.normalize_inline(t).alias("inline"), T.normalize_multiline(t).alias("multiline"), T.clean(t).alias("clean"), T.normalize_code_line(t).alias("code"))


@query(
    "SELECT p_partkey, list_filter(list_transform(string_split(p_name || ' , ' || p_brand || ',, ' || p_type || ' ', ','), lambda x: trim(x)), lambda x: x <> '') AS names, "
    "CASE WHEN length(p_name) > 8 THEN left(p_name, 8) || chr(10) || '...[truncated]' ELSE p_name END AS short, contains(lower(p_name || CASE WHEN p_partkey % 2 = 0 THEN '@X' ELSE '' END), '@') AS email, "
    "'brand ' || p_brand AS asked, list_sort(list_distinct(regexp_extract_all(lower(p_name || ' ' || p_name || ' 中文' || p_size), '[a-z0-9_]+') || ['中', '文'])) AS words FROM part"
)
def q_small_functions(spark, d):
    """lists in settings, cut texts, addresses, fields of prompts and sets of words."""
    name = F.col("p_name")
    asked = T.prompt_field(F.concat(F.lit("SYSTEM: none\nQUESTION: brand "), F.col("p_brand"), F.lit("\nEND: x")), "QUESTION")
    return read(spark, d, "part").select(
        "p_partkey", T.split_env_list(F.concat(name, F.lit(" , "), F.col("p_brand"), F.lit(",, "), F.col("p_type"), F.lit(" "))).alias("names"), T.truncate(name, 8).alias("short"),
        T.is_email(F.concat(name, F.when(F.col("p_partkey") % 2 == 0, "@X").otherwise(""))).alias("email"), asked.alias("asked"),
        F.array_sort(T.word_set(F.concat(name, F.lit(" "), name, F.lit(" 中文"), F.col("p_size")))).alias("words"),
    )


#: Pieces of program text whose diagnostics are known: parses, issues of indentation, cut names, violations, definitions.
PROGRAMS = [
    ("def f(a):\n    return a", (True, 0, 0, 0, 1)), ("class A:\n    x = 1\n\n\ndef g():\n    pass", (True, 0, 0, 0, 2)), ("def f():\nreturn 1", (False, 1, 0, 1, 0)), ("import os\nvalue = resul\nt", (True, 0, 1, 0, 0)),
    ("break", (False, 0, 0, 1, 0)), ("for k in range(3):\n    print(k)", (True, 0, 0, 0, 0)), ("if x:\ny = 2", (False, 1, 0, 0, 0)), ("return blocks", (False, 0, 0, 1, 0)),
]
PROGRAM = f"CASE {K} % {len(PROGRAMS)} " + " ".join(f"WHEN {k} THEN {_quote(t)}" for k, (t, _) in enumerate(PROGRAMS)) + " END"
_known = lambda at: f"CASE {K} % {len(PROGRAMS)} " + " ".join(f"WHEN {k} THEN {str(v[at]).lower()}" for k, (_, v) in enumerate(PROGRAMS)) + " END"


@query(f"SELECT {K}, {_known(0)} AS parses, {_known(1)} AS indentation, {_known(2)} AS split, {_known(3)} AS violations, {_known(4)} AS definitions FROM orders")
def q_code_quality(spark, d):
    """F16: diagnostics of program text."""
    a = read(spark, d, "orders").selectExpr(K, f"{PROGRAM} AS t").withColumn("a", code.analyse_column(F.col("t")))
    return a.select(K, F.col("a.ast_parseable").alias("parses"), F.col("a.indentation_issues").alias("indentation"), F.col("a.split_identifiers").alias("split"), F.col("a.boundary_violations").alias("violations"), F.col("a.top_level_definitions").alias("definitions"))


@query(
    f"WITH t AS (SELECT {K}, CAST({K} % 50 AS STRING) AS n, 30 + {K} % 40 AS edge FROM orders) "
    f"SELECT {K}, 'import os' || chr(10) || 'def area_' || n || '(w):' || chr(10) || '    total = w * ' || n || chr(10) || '    if total:' || chr(10) || '        return total' || chr(10) || '    return 0' AS program FROM t"
)
def q_code_rebuilt(spark, d):
    """program text from lines and left edges, with a name cut in two and an indent that is missing."""
    n, x = F.col("n"), F.col("edge")
    lines = [
        (F.lit("import os"), x), (F.concat(F.lit("def area_"), n, F.lit("(w"), F.lit("")), x), (F.lit("):"), x), (F.concat(F.lit("total = w * "), n), x + 20), (F.lit("if tota"), x + 20), (F.lit("l:"), x + 20), (F.lit("return total"), x + 40), (F.lit("return 0"), x + 20),
    ]
    made = F.array(*[F.struct(t.alias("text"), e.cast("double").alias("x0")) for t, e in lines])
    return read(spark, d, "orders").selectExpr(K, f"CAST({K} % 50 AS STRING) AS n", f"30 + {K} % 40 AS edge").select(K, code.rebuild_column(made).alias("program"))


@query(
    f"SELECT {K}, CASE {K} % 3 WHEN 0 THEN ['import os', 'def a' || {K} || '():' || chr(10) || '    return 1', 'class B:' || chr(10) || '    pass'] WHEN 1 THEN ['x = ' || {K}] ELSE ['def broken(:', 'def c' || {K} || '():' || chr(10) || '  pass'] END AS blocks FROM orders"
)
def q_code_blocks(spark, d):
    """Program text cut at its definitions, by syntax or by the look of lines."""
    source = f"CASE {K} % 3 WHEN 0 THEN concat('import os', chr(10), 'def a', {K}, '():', chr(10), '    return 1', chr(10), chr(10), 'class B:', chr(10), '    pass') WHEN 1 THEN concat('x = ', {K}) ELSE concat('def broken(:', chr(10), 'def c', {K}, '():', chr(10), '  pass') END"
    return read(spark, d, "orders").selectExpr(K, f"{source} AS t").select(K, code.blocks_column(F.col("t")).alias("blocks"))


CHILD = {"child_id": f"CAST({K} AS STRING)", "parent_id": "concat('p', CAST(o_custkey AS STRING))", "token_estimate": f"CAST(30 + {K} * 13 % 900 AS INT)", "text": TEXT, "title": "CASE o_custkey % 4 WHEN 0 THEN '1.2 Terms' WHEN 1 THEN 'It ends here。' WHEN 2 THEN '总则' ELSE 'Plain title' END"}
AUDITED = (
    f"c AS (SELECT {_list(CHILD)}, {K} % 7 <> 0 AS on_, {K} % 3 AS depth FROM orders), ev AS (SELECT * FROM c WHERE on_), kids AS (SELECT parent_id, any_value(title) AS title, count(*) FILTER (on_) AS kids FROM c GROUP BY parent_id), "
    f"one AS (SELECT count(*) AS indexable_child_count, (count(*) FILTER (trim(text) <> '') - count(DISTINCT text) FILTER (trim(text) <> '')) / count(*) AS duplicate_child_ratio, count(*) FILTER (token_estimate < 100) / count(*) AS short_child_ratio_lt_100, "
    "count(*) FILTER (token_estimate < 180) / count(*) AS under_min_tokens_ratio, count(*) FILTER (token_estimate > 500) / count(*) AS over_target_tokens_ratio, count(*) FILTER (token_estimate > 800) AS over_max_tokens_count, count(*) FILTER (depth <= 1) / count(*) AS flat_heading_path_ratio, "
    f"count(*) FILTER (regexp_matches(text, '^{_any(fixed.SUSPICIOUS_OPENINGS)}|{fixed.LATIN_CONTINUATION}')) / count(*) AS mid_sentence_start_ratio, quantile_cont(token_estimate, 0.5) AS child_token_median, min(token_estimate) AS child_token_min, max(token_estimate) AS child_token_max FROM ev), "
    "two AS (SELECT count(*) AS indexable_parent_count, count(*) FILTER (kids = 1) / count(*) AS single_child_parent_ratio, count(*) FILTER (title = '1.2 Terms') AS multi_level_numbered_parent_count, "
    "count(*) FILTER (title = 'It ends here。') / count(*) AS suspicious_heading_ratio, quantile_cont(kids, 0.5) AS children_per_parent_median FROM kids WHERE kids > 0)"
)
AUDIT_RATIOS = ["duplicate_child_ratio", "short_child_ratio_lt_100", "under_min_tokens_ratio", "over_target_tokens_ratio", "flat_heading_path_ratio", "mid_sentence_start_ratio", "single_child_parent_ratio", "suspicious_heading_ratio"]
AUDIT_COUNTS = ["indexable_child_count", "indexable_parent_count", "over_max_tokens_count", "multi_level_numbered_parent_count", "child_token_min", "child_token_median", "child_token_max", "children_per_parent_median"]


@query(
    f"WITH {AUDITED} SELECT {', '.join(f'round_even({c}, 6) AS {c}' for c in AUDIT_RATIOS)}, {', '.join(f'CAST({c} AS DOUBLE) AS {c}' for c in AUDIT_COUNTS)}, "
    "CASE WHEN over_max_tokens_count > 0 OR short_child_ratio_lt_100 > 0.15 OR single_child_parent_ratio > 0.7 OR mid_sentence_start_ratio > 0.08 THEN 'not_ready' ELSE 'review' END AS verdict FROM one, two"
)
def q_audit(spark, d):
    """Stored chunks judged as a whole."""
    c = read(spark, d, "orders").selectExpr(*[f"{e} AS {c}" for c, e in CHILD.items()], f"struct({K} % 7 <> 0 AS index_enabled) AS metadata", f"array_repeat('x', CAST({K} % 3 AS INT)) AS heading_path", f"array(concat('u', {K})) AS unit_ids")
    parents = c.groupBy("parent_id").agg(F.first("title").alias("title"))
    got = quality.audit(c.drop("title"), parents)
    return got.select(*AUDIT_RATIOS, *[F.col(x).cast("double").alias(x) for x in AUDIT_COUNTS], "verdict")


@query(
    f"WITH c AS (SELECT CAST({K} AS STRING) AS child_id, CASE WHEN {K} % 5 > 0 THEN CAST({K} - 1 AS STRING) END AS previous_child_id, CASE WHEN {K} % 5 < 4 THEN CAST({K} + 1 AS STRING) END AS next_child_id FROM orders WHERE {K} % 11 > 0) "
    "SELECT child_id, 'BROKEN_PREVIOUS_LINK' AS code FROM c WHERE previous_child_id NOT IN (SELECT child_id FROM c) UNION ALL SELECT child_id, 'BROKEN_NEXT_LINK' FROM c WHERE next_child_id NOT IN (SELECT child_id FROM c)"
)
def q_broken_links(spark, d):
    """Links of children to neighbours that do not exist."""
    c = read(spark, d, "orders").where(f"{K} % 11 > 0").selectExpr(f"CAST({K} AS STRING) AS child_id", f"CASE WHEN {K} % 5 > 0 THEN CAST({K} - 1 AS STRING) END AS previous_child_id", f"CASE WHEN {K} % 5 < 4 THEN CAST({K} + 1 AS STRING) END AS next_child_id", "'d' AS document_id")
    return quality.broken_links(c).select("child_id", "code")


@query(
    f"WITH c AS (SELECT {K} AS child_id, concat('p', o_custkey) AS parent_id, CAST({K} % 1000 AS INT) AS token_estimate, CASE WHEN {K} % 9 = 0 THEN '' ELSE 'x' END AS text FROM orders), p AS (SELECT concat('p', c_custkey) AS parent_id FROM customer WHERE c_custkey % 4 > 0) "
    "SELECT 'ORPHAN_CHILD' AS code, count(*) AS n FROM c WHERE parent_id NOT IN (SELECT parent_id FROM p) UNION ALL SELECT 'CHILD_TOO_LARGE', count(*) FROM c WHERE token_estimate > 800 UNION ALL SELECT 'EMPTY_CHILD', count(*) FROM c WHERE text = ''"
)
def q_structural_errors(spark, d):
    """Orphans, children too large and empty ones."""
    c = read(spark, d, "orders").selectExpr(f"CAST({K} AS STRING) AS child_id", "concat('p', o_custkey) AS parent_id", f"CAST({K} % 1000 AS INT) AS token_estimate", f"CASE WHEN {K} % 9 = 0 THEN '' ELSE 'x' END AS text", "'d' AS document_id", "CAST(NULL AS STRING) AS previous_child_id", "CAST(NULL AS STRING) AS next_child_id")
    parents = read(spark, d, "customer").where("c_custkey % 4 > 0").selectExpr("concat('p', c_custkey) AS parent_id")
    documents = spark.createDataFrame([("d", 1)], "document_id string, page_count int")
    found = quality.errors(documents, parents, c, c.select("document_id"), ChunkConfig())
    return found.groupBy("code").agg(F.count("*").alias("n"))


@query(f"SELECT DISTINCT CAST(c.{K} AS STRING) AS child_id FROM orders c, orders u WHERE (u.{K} = c.{K} OR u.{K} = c.{K} + 7) AND u.{K} % 16 = 9")
def q_code_children(spark, d):
    """Children that hold a unit of program text."""
    o = read(spark, d, "orders")
    children = o.selectExpr(f"CAST({K} AS STRING) AS child_id", f"array({K}, {K} + 7) AS unit_ids")
    return quality._code_children(children, o.selectExpr(f"{K} AS unit_id", f"CASE WHEN {K} % 16 = 9 THEN 'code' ELSE 'paragraph' END AS kind"))


@query("SELECT c.c_custkey AS child_id, o_orderkey AS parent_id, o_orderstatus AS parent_content FROM customer c JOIN orders o ON o_orderkey = c_custkey * 3")
def q_parent_context(spark, d):
    """Children with the text of their parents."""
    children = read(spark, d, "customer").selectExpr("c_custkey AS child_id", "c_custkey * 3 AS parent_id", "c_name AS text")
    parents = read(spark, d, "orders").selectExpr("o_orderkey AS parent_id", "o_orderstatus AS content")
    found = retrieval.parent_context(children, parents)
    return found.select("child_id", "parent_id", "parent_content")


@query(f"WITH {B} SELECT document_id, 1 AS one FROM b GROUP BY document_id HAVING count(*) > 0")
def q_flat_chunks(spark, d):
    """First-generation chunks; every document has some, none is larger than the size, and numbers have no gaps."""
    c = chunking.flat_chunks(blocks_of(spark, d), 120, 20, 10).groupBy("document_id").agg(F.count("*").alias("n"), F.max("chunk_index").alias("last"), F.max("token_estimate").alias("most"))
    return c.where("last = n - 1 AND most <= 140").select("document_id", F.lit(1).alias("one"))


@query(
    f"WITH {B} SELECT document_id, page_number, string_agg(text, chr(10) || chr(10) ORDER BY y0, x0, block_no) AS text FROM b GROUP BY document_id, page_number"
)
def q_page_text(spark, d):
    """A4: the text of pages in reading order."""
    b = blocks_of(spark, d)
    return layout.page_text(b, spark.createDataFrame([], layout.TABLES))


@query("SELECT c_custkey, '文档：' || c_name || chr(10) || '记录类型：child' || CASE WHEN c_custkey % 3 > 0 THEN chr(10) || '章节：A > ' || c_mktsegment ELSE '' END || chr(10) || '页码：' || CASE WHEN c_custkey % 2 = 0 THEN '4' ELSE '4-5' END AS prefix FROM customer")
def q_source_prefix(spark, d):
    """the lines in front of a chunk."""
    path = F.when(F.col("c_custkey") % 3 > 0, F.array(F.lit("A"), F.col("c_mktsegment"))).otherwise(F.array().cast("array<string>"))
    last = F.when(F.col("c_custkey") % 2 == 0, 4).otherwise(5)
    return read(spark, d, "customer").select("c_custkey", T.source_prefix(F.col("c_name"), "child", path, F.lit(4), last).alias("prefix"))


@query("SELECT p_partkey, CAST((p_size + p_partkey) * 3 - p_size // 2 AS DOUBLE) AS value FROM part")
def q_calculator(spark, d):
    """arithmetic expressions evaluated."""
    said = F.concat(F.lit("("), F.col("p_size"), F.lit(" + "), F.col("p_partkey"), F.lit(") * 3 - "), F.col("p_size"), F.lit(" // 2"))
    return read(spark, d, "part").select("p_partkey", F.pandas_udf(lambda s: s.map(lambda x: float(code.calculate(x))), "double")(said).alias("value"))


@query(
    "SELECT c_custkey AS document_id, to_json({'c_custkey': c_custkey, 'c_name': c_name, 'c_nationkey': c_nationkey}) AS value FROM customer"
)
def q_json_lines(spark, d):
    """Rows as JSON lines."""
    c = read(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey")
    lines = writers.to_jsonl(c)
    return lines.select(F.get_json_object(F.col(lines.columns[0]), "$.c_custkey").cast("long").alias("document_id"), F.col(lines.columns[0]).alias("value"))
