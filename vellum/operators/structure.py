"""Structure: heading paths by windows, typed units, sections, and the joining of units that belong together.

The heading stack is computed without a fold: for each level the last heading of that level is carried forward, and it
is on the path if it is newer than every lower level's. Only the joining of neighbouring units, whose outcome decides
the next step, is a fold, over one section at a time.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

from vellum.config import ParserConfig
from vellum.functions import fixed, rules
from vellum.functions import text as T
from vellum.functions.code import analyse_column
from vellum.operators.folds import by_group, late
from vellum.operators.layout import PAGE

LEVELS = range(1, 7)
#: The order in which the elements of a document are read.
READING = ["page_number", "y0", "x0", "is_table", "no"]
UNIT = (
    "unit_id string, document_id string, section_seq long, unit_seq long, kind string, text string, page_start int, page_end int, heading_path array<string>, protected boolean, group_id string, "
    "x0 double, y0 double, x1 double, y1 double, font_size double, page_height double, page_role string, index_enabled boolean, demoted boolean, rows array<array<string>>, merged_unit_ids array<string>"
)
UNIT_COLUMNS = [f.split()[0] for f in UNIT.split(", ")]


def accept_heading(config: ParserConfig) -> Column:
    """Whether a heading of the layout stands: a second look at its text by the rule that found it."""
    t, source = T.squeeze(F.col("text")), F.coalesce("heading_source", F.lit(""))
    n = T.visible_chars(t)
    whole = (t != "") & ~t.contains("\n") & ~T.is_noise(t) & (n <= config.heading_max_chars)
    by_source = (
        F.when(source == "single_numeric_styled", n <= min(config.single_level_heading_max_chars, 32)).when(source == "numeric_hierarchy", n <= 60)
        .when(source.isin("font_ratio", "bold_style", "bold_fallback"), n <= 48).otherwise(True)
    )
    stands = whole & F.when(F.col("layout_kind") == "complex", source == "complex_layout_dominant_title").otherwise(~T.like_sentence(t) & by_source)
    return F.when(F.coalesce("heading_level", F.lit(0)) > 0, stands | F.lit(not config.revalidate_headings_in_structure)).otherwise(F.lit(False))


def elements(blocks: DataFrame, tables: DataFrame, pages: DataFrame, config: ParserConfig) -> DataFrame:
    """Blocks and tables of all pages in reading order, with their page's kind and role, ``heading`` where one stands,
    and ``epoch``: parts of a document that share no headings, because a cover or diagram page lies between them."""
    by = Window.partitionBy("document_id").orderBy("page_number")
    odd = F.lag(F.col("layout_kind").isin("complex", "sparse") | F.col("page_role").isin("toc", "cover")).over(by) & (F.lag("page_number").over(by) <= 2)
    p = pages.select(*PAGE, "width", "height", "layout_kind", "page_role", "index_enabled", F.sum(F.coalesce(odd, F.lit(False)).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)).alias("epoch"))
    if config.complex_layout_strategy == "skip":
        p = p.where("layout_kind <> 'complex'")
    b = blocks.select(*PAGE, "x0", "y0", "x1", "y1", F.lit(False).alias("is_table"), F.col("block_no").alias("no"), "text", "avg_font_size", "monospace", "heading_level", "heading_source", F.lit(None).cast("array<array<string>>").alias("rows"))
    t = tables.select(*PAGE, "x0", "y0", "x1", "y1", F.lit(True).alias("is_table"), F.col("table_index").alias("no"), F.col("markdown").alias("text"), F.lit(None).cast("double").alias("avg_font_size"), F.lit(False).alias("monospace"), F.lit(None).cast("int").alias("heading_level"), F.lit(None).cast("string").alias("heading_source"), "rows")
    both = b.unionByName(t).join(p, PAGE)
    order = Window.partitionBy("document_id").orderBy(*READING)
    return both.withColumn("heading", accept_heading(config)).withColumn("pos", F.row_number().over(order))


def heading_paths(e: DataFrame) -> DataFrame:
    """``e`` with ``heading_path, title, section_seq``; repeated headings and heading rows themselves are left out.

    ``section_seq`` counts headings and epochs that begin, so rows between two of them share it. All windows keep the
    order of ``pos``, so a document is sorted once; epochs follow each other in it, so what is carried forward names its
    epoch and counts no longer in the next one.
    """
    by = Window.partitionBy("document_id").orderBy(*READING)
    title = T.squeeze(F.col("text"))
    canon = F.lower(F.regexp_replace(title, r"(?U)\s+", ""))
    last = F.last(F.when(F.col("heading"), F.struct("epoch", canon.alias("canon"))), ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = e.withColumns({"__last": last, "__before": F.lag("epoch", 1, 0).over(by)})
    repeated = (F.col("__last.epoch") == F.col("epoch")) & (F.col("__last.canon") == canon)
    marked = marked.withColumn("__new", F.col("heading") & ~F.coalesce(repeated, F.lit(False))).drop("__last")
    level = F.least(F.greatest("heading_level", F.lit(1)), F.lit(6))
    carried = by.rowsBetween(Window.unboundedPreceding, 0)
    held = {f"__l{k}": F.when(F.col("__new") & (level == k), F.struct("epoch", "pos", title.alias("title"))) for k in LEVELS} | {"__newest": F.when(F.col("__new"), F.struct("epoch", title.alias("title")))}
    begins = (F.col("__new") | (F.col("epoch") != F.col("__before"))).cast("long")
    marked = marked.withColumns({name: F.last(x, ignorenulls=True).over(carried) for name, x in held.items()} | {"section_seq": F.sum(begins).over(carried)})
    marked = marked.withColumns({name: F.when(F.col(name).epoch == F.col("epoch"), F.col(name)) for name in held})
    on_path = []
    for k in LEVELS:
        here = F.col(f"__l{k}")
        newer = F.lit(True)
        for j in range(1, k):
            newer = newer & (F.col(f"__l{j}").isNull() | (F.col(f"__l{j}.pos") < here.pos))
        on_path.append(F.when(here.isNotNull() & newer, here.title))
    newest = F.col("__newest.title")
    marked = marked.withColumn("heading_path", F.array_compact(F.array(*on_path))).withColumn("title", F.coalesce(newest, F.lit(fixed.DEFAULT_TITLE)))
    return marked.where("NOT heading").drop(*[c for c in marked.columns if c.startswith("__")])


def classify(text: Column) -> Column:
    """Kind of a unit of text: code, layout, faq, callout, list or paragraph. Needs ``monospace`` and ``layout_kind``."""
    u = "(?Ui)"
    items = F.size(F.filter(T.lines(text), T.is_list_line))
    return (
        F.when(F.col("monospace") | T.dense_code(text), "code")
        .when(F.col("layout_kind").isin("complex", "sparse") & (T.visible_chars(text) <= 80), "layout")
        .when(text.rlike(u + fixed.QUESTION) & text.rlike(u + fixed.ANSWER), "faq")
        .when(text.rlike(u + fixed.CALLOUT), "callout").when(items >= 1, "list").otherwise("paragraph")
    )


@F.pandas_udf(StringType())
def _prepare(texts: pd.Series, monospace: pd.Series) -> pd.Series:
    return pd.Series([t.strip() if m else rules.mend_blank_lines(rules.clean(t)) for t, m in zip(texts.fillna(""), monospace.fillna(False), strict=True)], index=texts.index)


def units(placed: DataFrame) -> DataFrame:
    """Units of the placed elements: text cleaned and typed, tables as they are."""
    body = placed.where("NOT is_table").withColumn("text", _prepare("text", "monospace"))
    body = body.where(~T.is_noise(F.col("text"))).withColumn("kind", F.when(F.col("page_role") == "toc", "toc").otherwise(classify(F.col("text"))))
    every = body.unionByName(placed.where("is_table").withColumn("kind", F.lit("table")))
    where = F.when(F.col("is_table"), F.concat(F.lit("table"), F.col("no"))).otherwise(F.col("no").cast("string"))
    ident = [F.col("document_id"), F.col("page_number"), where, F.col("text")]
    return every.select(
        T.stable_id("unit", *ident).alias("unit_id"), "document_id", "section_seq", F.col("pos").cast("long").alias("unit_seq"), "kind", "text", F.col("page_number").alias("page_start"), F.col("page_number").alias("page_end"),
        "heading_path", (F.col("kind") != "paragraph").alias("protected"), T.stable_id("group", *ident).alias("group_id"), "x0", "y0", "x1", "y1", F.col("avg_font_size").alias("font_size"), F.col("height").alias("page_height"),
        "page_role", "index_enabled", ((F.coalesce("heading_level", F.lit(0)) > 0) & ~F.col("heading")).alias("demoted"), "rows", F.lit(None).cast("array<string>").alias("merged_unit_ids"), "title",
    )


def with_code_diagnostics(u: DataFrame) -> DataFrame:
    """Units with ``code``: the Python diagnostics of those that are code, else null."""
    return u.withColumn("code", F.when(F.col("kind") == "code", analyse_column(F.when(F.col("kind") == "code", F.col("text")).otherwise(""))))


def _paragraph_goes_on(a: dict, b: dict, config: ParserConfig) -> bool:
    gap = b["page_start"] - a["page_end"]
    if a["kind"] != "paragraph" or b["kind"] != "paragraph" or gap not in (0, 1):
        return False
    if rules.ends_sentence(a["text"]) or a["text"].rstrip()[-1:] in ("：", ":") or rules.list_line(b["text"]) or not rules.continues(b["text"]):
        return False
    fa, fb = a["font_size"] or 0.0, b["font_size"] or 0.0
    if fa and fb and abs(fa - fb) / max(fa, fb) > 0.16:
        return False
    broken = rules.breaks_word(a["text"], b["text"])
    if rules.opens_paragraph(b["text"]) and not broken:
        return False
    aside = abs(a["x0"] - b["x0"])
    if gap == 0:
        below = -3 <= b["y0"] - a["y1"] <= max(fa, fb, 10.0) * 2.2
        return (below and aside <= config.max_block_x_offset) or (broken and aside <= config.max_block_x_offset * 1.5)
    high_a, high_b = a["page_height"] or 0.0, b["page_height"] or 0.0
    return bool(config.merge_cross_page_continuations and high_a > 0 and high_b > 0 and a["y1"] >= high_a * 0.72 and b["y0"] <= high_b * 0.30 and aside <= config.max_block_x_offset)


def _pairing(a: dict, b: dict, config: ParserConfig) -> tuple[str, str] | None:
    """Kind and separator of two neighbours that are one unit, or None. The first rule that holds counts."""
    pattern = lambda p, s: bool(rules.rx(p, rules.IGNORE).match(s))
    near = a["page_end"] <= b["page_start"] <= a["page_end"] + 1
    open_item = a["kind"] == "list" and b["kind"] == "paragraph" and a["demoted"] and not rules.ends_sentence(a["text"]) and rules.continues(b["text"])
    ways = (
        (a["kind"] == "paragraph" and pattern(fixed.QUESTION, a["text"]) and pattern(fixed.ANSWER, b["text"]), ("faq", "\n")),
        (a["kind"] == "paragraph" and a["text"].rstrip()[-1:] in ("：", ":") and b["kind"] == "list" and near, ("list", "\n")),
        (a["kind"] == b["kind"] == "list", ("list", "\n")), (open_item, ("list", "")), (_paragraph_goes_on(a, b, config), ("paragraph", "")),
    )
    return next((way for holds, way in ways if holds), None)


def _hash(prefix: str, *parts: str) -> str:
    import hashlib

    return f"{prefix}_" + hashlib.sha256("\x1f".join(parts).encode()).hexdigest()[:24]


def _merge(a: dict, b: dict, kind: str, between: str) -> dict:
    joined = a["text"].rstrip() + between + b["text"].lstrip() if between else rules.join(a["text"], b["text"])
    box = {k: b[k] for k in ("x0", "y0", "x1", "y1")}
    if a["page_end"] == b["page_start"]:
        box = {"x0": min(a["x0"], b["x0"]), "y0": min(a["y0"], b["y0"]), "x1": max(a["x1"], b["x1"]), "y1": max(a["y1"], b["y1"])}
    ids = [*(a["merged_unit_ids"] or [a["unit_id"]]), *(b["merged_unit_ids"] or [b["unit_id"]])]
    return a | box | {
        "unit_id": _hash("unit", a["unit_id"], b["unit_id"], joined), "group_id": _hash("merged_group", a["unit_id"], b["unit_id"]), "kind": kind, "text": joined, "page_end": max(a["page_end"], b["page_end"]),
        "protected": a["protected"] or b["protected"] or kind in ("faq", "list"), "page_height": b["page_height"], "merged_unit_ids": ids,
    }


def coalesce_rows(rows: list[dict], config: ParserConfig) -> list[dict]:
    """Neighbours joined pairwise from the left, again and again until nothing changes."""
    while True:
        out, k = [], 0
        while k < len(rows):
            way = _pairing(rows[k], rows[k + 1], config) if k + 1 < len(rows) else None
            out.append(_merge(rows[k], rows[k + 1], *way) if way else rows[k])
            k += 2 if way else 1
        if len(out) == len(rows):
            return out
        rows = out


def coalesce(u: DataFrame, config: ParserConfig) -> DataFrame:
    """Units joined within their section."""

    fold = lambda section: coalesce_rows(sorted(section, key=lambda r: late(r["unit_seq"])), config)
    return by_group(u.select(*UNIT_COLUMNS), ["document_id", "section_seq"], fold, UNIT)


def merge_sections(u: DataFrame, config: ParserConfig) -> DataFrame:
    """Neighbouring sections of one heading path, at most a page apart, become one, and their units are joined again."""
    spans = u.groupBy("document_id", "section_seq").agg(F.first("heading_path").alias("path"), F.min("page_start").alias("first"), F.max("page_end").alias("last"))
    by = Window.partitionBy("document_id").orderBy("section_seq")
    reach = F.max("last").over(by.rowsBetween(Window.unboundedPreceding, -1))
    apart = ~F.coalesce((F.lag("path").over(by) == F.col("path")) & (F.col("first") <= reach + 1), F.lit(False))
    group = F.sum(apart.cast("long")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    numbered = u.join(spans.select("document_id", "section_seq", group.alias("__g")), ["document_id", "section_seq"])
    return coalesce(numbered.withColumn("section_seq", F.col("__g")).drop("__g"), config)


def sections(u: DataFrame) -> DataFrame:
    """A row per section: id, title, path, pages, roles, whether it is indexed and whether it is a table of contents."""
    grouped = u.groupBy("document_id", "section_seq").agg(
        F.first("heading_path").alias("heading_path"), F.min("page_start").alias("page_start"), F.max("page_end").alias("page_end"),
        F.array_sort(F.collect_set("page_role")).alias("page_roles"), F.bool_or("index_enabled").alias("index_enabled"), F.count("*").alias("unit_count"),
    )
    title = F.coalesce(F.try_element_at("heading_path", F.lit(-1)), F.lit(fixed.DEFAULT_TITLE))
    kind = F.when(F.to_json("page_roles") == '["toc"]', "toc").otherwise("body")
    ident = T.stable_id("section", F.col("document_id"), F.to_json("heading_path"), F.col("page_start"), F.col("page_end"), F.col("section_seq"))
    return grouped.select(ident.alias("section_id"), "*", title.alias("title"), kind.alias("record_type"))


def build_structure(blocks: DataFrame, tables: DataFrame, pages: DataFrame, config: ParserConfig, table=lambda df, _: df) -> tuple[DataFrame, DataFrame]:
    """Sections and their units: all steps in their order. ``table(df, name)`` may write what is read twice."""
    placed = heading_paths(elements(blocks, tables, pages, config))
    u = merge_sections(table(coalesce(units(placed), config), "joined"), config)
    return sections(u), u
