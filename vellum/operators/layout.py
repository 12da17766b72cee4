"""Page layout: tables, repeated headers and footers, font sizes, kinds and roles of pages, headings, merged blocks.

Tables are keyed by ``document_id, page_number``. Everything but the merging of neighbouring blocks is expressions,
joins and windows; merging is a fold over one page in reading order, so a task holds a few pages.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from vellum.config import ParserConfig
from vellum.functions import fixed, rules
from vellum.functions import text as T
from vellum.functions.code import rebuild
from vellum.functions.geometry import overlap_share
from vellum.operators.folds import by_group, late

PAGE = ["document_id", "page_number"]
BLOCKS = (
    "document_id string, page_number int, block_no int, x0 double, y0 double, x1 double, y1 double, text string, source string, max_font_size double, avg_font_size double, "
    "bold boolean, monospace boolean, heading_level int, heading_source string, lines array<struct<text:string,x0:double>>"
)
MEASURES = ["x0", "y0", "x1", "y1", "max_font_size", "avg_font_size"]
PAGES = "document_id string, page_number int, width double, height double, rotation int, used_ocr boolean, native_text_char_count int"
TABLES = "document_id string, page_number int, table_index int, x0 double, y0 double, x1 double, y1 double, rows array<array<string>>, markdown string, quality_score double, quality_reasons array<string>"


def needs_ocr(native_chars: Column, config: ParserConfig) -> Column:
    """Whether a page goes to optical recognition."""
    if config.ocr_mode == "auto":
        return native_chars < config.min_native_text_chars
    return F.lit(config.ocr_mode == "always")


def score_table(rows: Column, box: tuple[Column, ...], page_area: Column, config: ParserConfig) -> Column:
    """``struct<score, reasons>``: how much an extracted table looks like one. What is counted in the cells is counted once."""
    live = F.transform(rows, lambda r: F.filter(r, lambda c: T.strip(T.text_of(c)) != ""))
    first = lambda a: F.struct(F.transform(rows, F.size).alias("widths"), F.transform(a, F.size).alias("per_row"), F.transform(F.flatten(a), T.visible_chars).alias("sizes"))
    return T.let(T.let(live, first), lambda m: T.let(_measures(rows, m, config), lambda n: _verdict(n, box, page_area, config)))


def _measures(rows: Column, m: Column, config: ParserConfig) -> Column:
    n_rows, widths, sizes = F.size(rows), m.widths, m.sizes
    n_columns = F.coalesce(F.array_max(widths), F.lit(0))
    filled = F.size(sizes) / F.greatest(n_rows * n_columns, F.lit(1))
    single = F.size(F.filter(m.per_row, lambda n: n <= 1)) / n_rows
    long = F.size(F.filter(sizes, lambda n: n > config.max_narrative_cell_chars)) / F.greatest(F.size(sizes), F.lit(1))
    mean = F.aggregate(sizes, F.lit(0), lambda a, b: a + b) / F.greatest(F.size(sizes), F.lit(1))
    modal = F.array_max(F.transform(widths, lambda w: F.size(F.filter(widths, lambda v: v == w)))) / n_rows
    return F.struct(*[x.alias(k) for k, x in {"n_rows": n_rows, "n_columns": n_columns, "filled": filled, "single": single, "long": long, "mean": mean, "modal": modal}.items()])


def _verdict(m: Column, box: tuple[Column, ...], page_area: Column, config: ParserConfig) -> Column:
    n_rows, n_columns, filled, single, long, mean, modal = (m[k] for k in ("n_rows", "n_columns", "filled", "single", "long", "mean", "modal"))
    area = F.greatest((box[2] - box[0]) * (box[3] - box[1]), F.lit(0.0)) / F.greatest(page_area, F.lit(1.0))
    # Parts of the score and what lowers it.
    penalties = [
        (single > 0.5, 0.32, "too_many_single_cell_rows"), (long > 0.35, 0.28, "too_many_narrative_cells"), ((n_rows <= 3) & (mean > 65), 0.25, "small_narrative_layout"),
        ((area > 0.72) & (n_rows <= 3), 0.25, "large_page_textbox_like"), (filled < 0.6, 0.08, "sparse_cells"), (modal < 0.7, 0.08, "inconsistent_columns"),
    ]
    score = F.lit(0.42) + F.least(filled, F.lit(1.0)) * 0.18 + modal * 0.16 + F.when(n_rows >= 3, 0.12).otherwise(0.05) + F.when(n_columns >= 3, 0.12).otherwise(0.06)
    for holds, weight, _ in penalties:
        score = score - F.when(holds, weight).otherwise(0.0)
    reasons = F.array_compact(F.array(*[F.when(holds, F.lit(name)) for holds, _, name in penalties]))
    verdict = lambda s, r: F.struct(s.cast("double").alias("score"), r.alias("reasons"))
    return (
        F.when((n_rows < config.min_table_rows) | (n_columns < config.min_table_columns), verdict(F.lit(0.0), F.array(F.lit("rows_or_columns_too_few"))))
        .when(filled < config.min_table_nonempty_ratio, verdict(F.lit(0.0), F.array(F.lit("nonempty_ratio_too_low"))))
        .otherwise(verdict(F.greatest(F.lit(0.0), F.least(score, F.lit(1.0))), reasons))
    )


def accept_tables(tables: DataFrame, pages: DataFrame, config: ParserConfig) -> tuple[DataFrame, DataFrame]:
    """Tables that score enough, with Markdown, and per page the number and reasons of those that do not."""
    sized = tables.join(pages.select(*PAGE, (F.col("width") * F.col("height")).alias("__area")), PAGE)
    scored = sized.withColumn("__s", score_table(F.col("rows"), tuple(map(F.col, ("x0", "y0", "x1", "y1"))), F.col("__area"), config))
    good = F.col("__s.score") >= config.min_table_quality_score
    kept = scored.where(good).withColumns({"quality_score": F.col("__s.score"), "quality_reasons": F.col("__s.reasons"), "markdown": T.table_to_markdown(F.col("rows"))}).drop("__s", "__area")
    return kept, scored.where(~good).select(*PAGE, F.explode_outer("__s.reasons").alias("reason"))


def rejection_reasons(rejected: DataFrame, n: int = 3) -> DataFrame:
    """The most frequent reasons: ``reason, count``."""
    return rejected.where("reason IS NOT NULL").groupBy("reason").count().orderBy(F.desc("count"), "reason").limit(n)


def drop_blocks_in_tables(blocks: DataFrame, tables: DataFrame, share: float = 0.72) -> DataFrame:
    """Blocks of which a table of the page covers less than ``share``."""
    b, t = blocks.alias("b"), tables.select(*PAGE, "x0", "y0", "x1", "y1").distinct().alias("t")  # equal boxes cover alike
    box = lambda x: tuple(F.col(f"{x}.{k}") for k in ("x0", "y0", "x1", "y1"))
    same = (F.col("b.document_id") == F.col("t.document_id")) & (F.col("b.page_number") == F.col("t.page_number"))
    return b.join(t, same & (overlap_share(box("b"), box("t")) >= share), "left_anti")


def _in_zone(zone: float) -> Column:
    return (F.col("y0") <= F.col("height") * zone) | (F.col("y1") >= F.col("height") * (1 - zone))


def repeated_patterns(blocks: DataFrame, pages: DataFrame, config: ParserConfig) -> DataFrame:
    """``document_id, pattern``: what the top or bottom zone of enough pages of a document repeats."""
    counts = pages.groupBy("document_id").agg(F.count("*").alias("n"))
    least = F.greatest(F.lit(config.min_repeated_header_footer_pages), F.ceil(F.col("n") * config.repeated_header_footer_ratio))
    keyed = blocks.join(pages.select(*PAGE, "height"), PAGE).where(_in_zone(config.header_footer_zone_ratio)).select("document_id", "page_number", T.boilerplate_key(T.squeeze(F.col("text"))).alias("pattern"))
    seen = keyed.where("pattern <> ''").distinct().groupBy("document_id", "pattern").agg(F.count("*").alias("pages"))
    return seen.join(counts, "document_id").where((F.col("n") >= config.min_repeated_header_footer_pages) & (F.col("pages") >= least)).select("document_id", "pattern")


def drop_headers_footers(blocks: DataFrame, pages: DataFrame, config: ParserConfig, patterns: DataFrame | None = None) -> DataFrame:
    """Blocks without those that repeat a pattern in their page's top or bottom zone."""
    patterns = repeated_patterns(blocks, pages, config) if patterns is None else patterns
    zoned = blocks.join(pages.select(*PAGE, "height"), PAGE).withColumn("pattern", F.when(_in_zone(config.header_footer_zone_ratio), T.boilerplate_key(T.squeeze(F.col("text")))))
    return zoned.join(patterns, ["document_id", "pattern"], "left_anti").select(*blocks.columns)


def body_font_size(blocks: DataFrame) -> DataFrame:
    """``document_id, body_font_size``: the lower median over proportional blocks, weighted by up to 200 characters."""
    live = blocks.where("avg_font_size > 0 AND NOT monospace")
    weight = F.least(F.greatest(T.visible_chars(F.col("text")), F.lit(1)), F.lit(200))
    sizes = live.groupBy("document_id", "avg_font_size").agg(F.sum(weight).alias("w"))  # one row per font size
    by = Window.partitionBy("document_id")
    ranked = sizes.select("document_id", "avg_font_size", F.sum("w").over(by.orderBy("avg_font_size")).alias("upto"), F.sum("w").over(by).alias("all"))
    return ranked.where("2 * upto >= all").groupBy("document_id").agg(F.min("avg_font_size").alias("body_font_size"))


def classify_pages(pages: DataFrame, blocks: DataFrame, config: ParserConfig) -> DataFrame:
    """``pages`` with ``layout_kind, page_role, index_enabled``."""
    b = blocks.join(pages.select(*PAGE, F.col("width").alias("page_width")), PAGE)
    pairs = F.transform(T.lines(F.col("text")), lambda x: F.struct(x.alias("raw"), T.squeeze(x).alias("line")))
    b = b.withColumns({"__size": T.visible_chars(F.col("text")), "__line": T.squeeze(F.col("text")), "__flat": F.filter(pairs, lambda x: x.line != "")})
    b = b.withColumn("__numbered", F.filter("__flat", lambda x: x.line.rlike("(?U)" + fixed.MULTI_NUMBER)))
    size, line, flat, numbered = F.col("__size"), F.col("__line"), F.col("__flat"), F.col("__numbered")
    center = (F.col("x0") + F.col("x1")) / 2
    width = F.greatest(F.col("page_width"), F.lit(1.0))
    short = size <= config.complex_layout_short_block_chars
    total = F.aggregate(numbered, F.lit(0), lambda a, x: a + T.visible_chars(x.raw))
    facts = b.groupBy(*PAGE).agg(
        F.count("*").alias("n"), F.sum(size).alias("chars"), F.sum(F.when(F.col("monospace"), size).otherwise(0)).alias("mono_chars"), F.count_if("monospace").alias("mono"),
        F.count_if(short).alias("short"), ((F.max(center) - F.min(center)) / F.max(width)).alias("spread"), F.percentile(size, 0.5).alias("median"),
        F.countDistinct(F.bround(center / width * 6)).alias("bands"), F.count_if(line.rlike("(?U)" + fixed.MULTI_NUMBER) & (size <= 55)).alias("short_numbered"),
        F.sum(F.size(flat)).alias("lines"), F.sum(F.size(F.filter(flat, lambda x: x.line.rlike("(?U)" + fixed.TOC_ENTRY)))).alias("entries"), F.sum(F.size(numbered)).alias("entry_lines"), F.sum(total).alias("entry_chars"),
    )
    out = pages.join(facts, PAGE, "left").fillna(0, ["n", "chars", "mono_chars", "mono", "short", "spread", "median", "bands", "short_numbered", "lines", "entries", "entry_lines", "entry_chars"])
    scattered = (
        (F.col("short") >= F.col("n") * config.complex_layout_short_block_ratio) & (F.col("spread") >= config.complex_layout_min_x_spread_ratio)
        & (F.col("median") <= config.complex_layout_short_block_chars * 1.5) & (F.col("bands") >= 3)
    )
    slide = (F.col("page_number") <= 2) & (F.col("short") >= 4) & (F.col("bands") >= 3) & ((F.col("spread") >= 0.22) | (F.col("short_numbered") >= 3))
    program = (F.col("mono") >= 3) & (F.col("mono_chars") >= F.greatest(F.col("chars"), F.lit(1)) * 0.55)
    kind = (
        F.when(F.lit(not config.detect_complex_layout), "normal").when((F.col("n") <= 3) & (F.col("chars") < 100), "sparse")
        .when((F.col("n") < config.complex_layout_min_blocks) | program, "normal").when(scattered | slide, "complex").otherwise("normal")
    )
    contents = (
        F.lit(config.detect_toc_pages) & (F.col("page_number") <= 5) & (F.col("entries") >= config.toc_min_numbered_entries)
        & (F.coalesce(F.try_divide(F.col("entry_chars"), F.col("entry_lines")), F.lit(0.0)) <= config.toc_max_average_entry_chars)
    )
    cover = (F.col("page_number") == 1) & (F.col("layout_kind") == "sparse") & (F.col("lines") <= 4)
    role = F.when(contents, "toc").when(cover, "cover").when(F.col("layout_kind") == "complex", "complex").otherwise("body")
    indexed = F.when(F.col("page_role") == "toc", F.lit(config.index_toc_pages)).otherwise(F.col("page_role") != "cover")
    base = [c for c in pages.columns if c not in ("layout_kind", "page_role", "index_enabled")]
    return out.withColumn("layout_kind", kind).withColumn("page_role", role).withColumn("index_enabled", indexed).select(*base, "layout_kind", "page_role", "index_enabled")


def detect_headings(blocks: DataFrame, pages: DataFrame, fonts: DataFrame, config: ParserConfig) -> DataFrame:
    """``blocks`` with ``heading_level, heading_source``."""
    b = blocks.join(pages.select(*PAGE, "height", "layout_kind"), PAGE).join(fonts, "document_id", "left").withColumn("__top", F.max("max_font_size").over(Window.partitionBy(*PAGE)))
    b = b.withColumn("__t", T.squeeze(F.col("text"))).withColumn("__n", T.visible_chars(F.col("__t")))
    t, n, u = F.col("__t"), F.col("__n"), "(?U)"
    ratio = F.when(F.coalesce("body_font_size", F.lit(0.0)) > 0, F.col("max_font_size") / F.col("body_font_size")).otherwise(0.0)
    styled = (ratio >= config.heading_min_font_ratio) | (F.col("bold") & (ratio >= config.heading_bold_min_font_ratio))
    prose = T.like_sentence(t)
    heading = lambda level, source: F.struct((F.lit(level) if isinstance(level, int) else level).cast("int").alias("level"), F.lit(source).alias("source"))
    none = F.lit(None).cast("struct<level:int,source:string>")
    pick = lambda ok, level, source: F.when(ok, heading(level, source)).otherwise(none)
    depth = F.least(F.size(F.split(F.regexp_extract(t, u + fixed.MULTI_NUMBER, 1), r"\.")), F.lit(6))
    special = (F.col("layout_kind") == "complex") | ((F.col("layout_kind") == "sparse") & (F.col("page_number") <= 2))
    dominant = (F.col("__top") > 0) & (F.col("max_font_size") >= F.col("__top") * 0.94) & (F.col("y0") <= F.col("height") * 0.28) & (n <= 50)
    short = n <= 28
    rule = (
        F.when((t == "") | t.contains("\n") | (n > config.heading_max_chars) | F.col("monospace") | T.is_noise(t), none)
        .when(special, pick(dominant & F.lit(config.complex_layout_strategy != "skip"), 1, "complex_layout_dominant_title"))
        .when(t.rlike(u + fixed.CHAPTER), pick(styled | short, 1, "chapter_pattern"))
        .when(t.rlike(u + fixed.CHAPTER_SECTION), pick(styled | short, 2, "section_pattern"))
        .when(t.rlike(u + fixed.MULTI_NUMBER), pick(~prose & (styled | (n <= 52)), depth, "numeric_hierarchy"))
        .when(t.rlike(u + fixed.SINGLE_NUMBER), pick(styled & (n <= config.single_level_heading_max_chars) & ~prose, 1, "single_numeric_styled"))
        .when(t.rlike(u + fixed.NUMERAL_ITEM) | t.rlike(u + fixed.PAREN_ITEM), pick(styled & (n <= 32) & ~prose, 2, "styled_chinese_number"))
        .when(F.coalesce("body_font_size", F.lit(0.0)) <= 0, pick(F.col("bold") & (n <= 40), 3, "bold_fallback"))
        .when((ratio >= 1.60) & (n <= 60), heading(1, "font_ratio"))
        .when((ratio >= 1.35) & (n <= 60), heading(2, "font_ratio"))
        .when((ratio >= 1.16) & (n <= 52) & ~prose, heading(3, "font_ratio"))
        .otherwise(pick(F.col("bold") & (ratio >= 1.03) & (n <= 42) & ~prose, 3, "bold_style"))
    )
    base = [c for c in blocks.columns if c not in ("heading_level", "heading_source")]
    return b.withColumn("__h", rule).select(*base, F.col("__h.level").alias("heading_level"), F.col("__h.source").alias("heading_source"))


@dataclass(frozen=True)
class Fit:
    """How far apart two blocks may be to be one: fixed values of the layout rules."""

    font: float  # share by which the smaller font may differ
    gap: float  # vertical gap in font sizes
    shift: float  # left edges, in points
    overlap: float = 0.0  # least share of the narrower block's width that both have

    def holds(self, a: dict, b: dict) -> bool:
        small, large = sorted(max(x["avg_font_size"], 1.0) for x in (a, b))
        common = max(0.0, min(a["x1"], b["x1"]) - max(a["x0"], b["x0"]))
        narrow = max(1e-9, min(x["x1"] - x["x0"] for x in (a, b)))
        return (large - small) / large <= self.font and -3 <= b["y0"] - a["y1"] <= large * self.gap and abs(a["x0"] - b["x0"]) <= self.shift and common / narrow >= self.overlap


PROGRAM = Fit(font=0.18, gap=2.4, shift=140)
#: A short line looks like a title from this size, over the body's; from that size where it is bold; up to so many characters.
TITLE_RATIO, BOLD_TITLE_RATIO, TITLE_CHARS = 1.22, 1.08, 52


def _paragraph_fit(config: ParserConfig) -> Fit:
    return Fit(font=0.14, gap=config.max_block_vertical_gap_ratio, shift=config.max_block_x_offset, overlap=0.55)


def _one_program(a: dict, b: dict) -> bool:
    return all(x["monospace"] and not x["heading_level"] for x in (a, b)) and PROGRAM.holds(a, b)


def _title_like(b: dict, body: float) -> bool:
    line = rules.inline(b["text"])
    needed = BOLD_TITLE_RATIO if b["bold"] else TITLE_RATIO
    loud = bool(rules.rx(fixed.MULTI_NUMBER).match(line)) or (body > 0 and b["max_font_size"] >= needed * body)
    return loud and rules.visible(line) <= TITLE_CHARS and not rules.like_sentence(line)


def _one_paragraph(a: dict, b: dict, body: float, headings: bool, config: ParserConfig) -> bool:
    """Two prose blocks close to each other, the first of which does not end and the second of which starts nothing."""
    apart = (lambda x: x["heading_level"]) if headings else (lambda x: _title_like(x, body))
    own = any(x["monospace"] or apart(x) for x in (a, b))
    ends = a["text"][-1:] in ("：", ":") or rules.ends_sentence(a["text"])
    after_list = any(rules.list_line(x) for x in a["text"].splitlines() if x.strip())
    starts = rules.list_line(b["text"]) or (after_list and rules.opens_paragraph(b["text"]))
    return not (own or ends or starts) and _paragraph_fit(config).holds(a, b)


def _together(a: dict, b: dict, program: bool, spaces: int) -> dict:
    wa, wb = max(rules.visible(a["text"]), 1), max(rules.visible(b["text"]), 1)
    lines = [*a["lines"], *b["lines"]]
    if program:
        lines = lines or [{"text": t, "x0": x["x0"]} for x in (a, b) for t in x["text"].splitlines()]
        wa = wb = 1
    return a | {
        "text": rebuild([x["text"] for x in lines], [x["x0"] for x in lines], spaces) if program else rules.join(a["text"], b["text"]), "lines": lines,
        "x0": min(a["x0"], b["x0"]), "y0": min(a["y0"], b["y0"]), "x1": max(a["x1"], b["x1"]), "y1": max(a["y1"], b["y1"]), "max_font_size": max(a["max_font_size"], b["max_font_size"]),
        "avg_font_size": round((a["avg_font_size"] * wa + b["avg_font_size"] * wb) / (wa + wb), 3), "bold": a["bold"] or b["bold"], "block_no": min(a["block_no"], b["block_no"]),
    }


def merge_blocks(blocks: DataFrame, pages: DataFrame, fonts: DataFrame, config: ParserConfig, headings: bool) -> DataFrame:
    """Neighbouring blocks of a page that are one paragraph or one piece of program text, in reading order. ``headings``:
    whether headings are known already and stay apart. On complex pages only program text is merged."""
    b = blocks.join(pages.select(*PAGE, "layout_kind"), PAGE).join(fonts, "document_id", "left")

    def fold(page: list[dict]) -> list[dict]:
        for r in page:  # a place or size that is missing compares as false
            r |= {c: float("nan") for c in MEASURES if r[c] is None}
        tops = np.round([r["y0"] for r in page], 1).tolist()
        order = sorted(range(len(page)), key=lambda k: (late(tops[k]), late(page[k]["x0"]), late(page[k]["block_no"])))
        out: list[dict] = []
        for r in (page[k] for k in order):
            r["lines"] = r["lines"] or []
            body = r["body_font_size"] or 0.0
            if out and _one_program(out[-1], r):
                out[-1] = _together(out[-1], r, True, config.code_indent_spaces)
            elif out and r["layout_kind"] != "complex" and _one_paragraph(out[-1], r, body, headings, config):
                out[-1] = _together(out[-1], r, False, config.code_indent_spaces)
            else:
                out.append(r)
        return [r | {c: None for c in MEASURES if r[c] != r[c]} for r in out]

    return by_group(b.select(*[f.split()[0] for f in BLOCKS.split(", ")], "layout_kind", "body_font_size"), PAGE, fold, BLOCKS)


def page_text(blocks: DataFrame, tables: DataFrame) -> DataFrame:
    """``document_id, page_number, text``: blocks and tables from top to bottom, headings with their number signs."""
    marked = F.when(F.col("heading_level") > 0, F.concat(F.expr("repeat('#', heading_level)"), F.lit(" "), F.col("text"))).otherwise(F.col("text"))
    parts = blocks.select(*PAGE, "y0", "x0", F.lit(0).alias("kind"), F.col("block_no").alias("no"), marked.alias("part")).unionByName(
        tables.select(*PAGE, "y0", "x0", F.lit(1).alias("kind"), F.col("table_index").alias("no"), F.col("markdown").alias("part"))
    )
    ordered = F.array_sort(F.collect_list(F.struct("y0", "x0", "kind", "no", "part")))
    return parts.groupBy(*PAGE).agg(F.array_join(F.transform(ordered, lambda x: x.part), "\n\n").alias("text"))


def parse_layout(blocks: DataFrame, pages: DataFrame, tables: DataFrame, config: ParserConfig, table=lambda df, _: df) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Blocks with headings, pages with kinds and roles, and the accepted tables: all layout steps in their order.
    ``table(df, name)`` may write what more than one step reads."""
    tables, _ = accept_tables(tables, pages, config)
    kept = table(drop_headers_footers(drop_blocks_in_tables(blocks, tables, config.table_overlap_ratio), pages, config), "kept")
    fonts = table(body_font_size(kept), "fonts")
    kinds = table(classify_pages(pages, kept, config), "pages")
    first = merge_blocks(kept, kinds, fonts, config, headings=False)
    second = merge_blocks(detect_headings(first, kinds, fonts, config), kinds, fonts, config, headings=True)
    return second, kinds, tables
