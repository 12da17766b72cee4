"""Layout, structure, chunks and quality on small fixtures."""

import pytest
from pyspark.sql import functions as F

from vellum.config import ChunkConfig, ParserConfig, PipelineConfig, SemanticConfig
from vellum.functions import rules
from vellum.operators import chunking, layout, quality, structure
from vellum.plans import pipeline


def block(text, page=1, no=1, x0=72.0, x1=520.0, y0=100.0, y1=120.0, font=12.0, avg=None, bold=False, mono=False, level=None, source=None, doc="d"):
    lines = [{"text": t, "x0": float(x0)} for t in text.splitlines()]
    return (doc, page, no, float(x0), float(y0), float(x1), float(y1), text, "native", float(font), float(avg or font), bold, mono, level, source, lines)


def frames(spark, blocks, pages=1, tables=(), doc="d"):
    return (
        spark.createDataFrame([(doc, "/x.pdf", "x.pdf", "0" * 64, pages)], "document_id string, source_path string, file_name string, sha256 string, page_count int"),
        spark.createDataFrame([(doc, p, 595.0, 842.0, 0, False, 100) for p in range(1, pages + 1)], layout.PAGES),
        spark.createDataFrame(list(blocks), layout.BLOCKS),
        spark.createDataFrame(list(tables), layout.TABLES),
    )


def test_heading_levels(spark):
    names = [("2.1 Query模块", 14, True), ("2.1.1 基于规则的方法", 12, False), ("3. 向量数据库:存储向量并提供检索能力给在线流程使用", 12, False)]
    _, pages, blocks, _ = frames(spark, [block(t, no=k, y0=100 + 30 * k, font=f, bold=b) for k, (t, f, b) in enumerate(names)])
    fonts = spark.createDataFrame([("d", 12.0)], "document_id string, body_font_size double")
    found = layout.detect_headings(blocks, pages.withColumn("layout_kind", F.lit("normal")), fonts, ParserConfig()).orderBy("block_no").collect()
    assert [r.heading_level for r in found] == [2, 3, None]


def test_page_kinds(spark):
    slide = [block("RAG流程图解", x0=220, x1=380, y0=30, font=24, no=1)] + [block(t, x0=x, x1=x + 110, y0=200, no=k) for k, (t, x) in enumerate([("Query模块", 40), ("离线解析模块", 220), ("检索召回模块", 400), ("生成阶段优化", 220)], 2)]
    _, pages, blocks, _ = frames(spark, slide)
    assert layout.classify_pages(pages, blocks, ParserConfig()).first().layout_kind == "complex"
    entries = ["1.1 整体流程", "1.2 离线处理流程", "1.3 在线处理流程", "2.1 Query模块", "2.2 Query重写", "2.3 Query扩写", "3.1 离线解析"]
    _, pages, blocks, _ = frames(spark, [block(t, x0=50 + k % 3 * 150, x1=190 + k % 3 * 150, y0=90 + 35 * k, no=k) for k, t in enumerate(entries)])
    row = layout.classify_pages(pages, blocks, ParserConfig(toc_min_numbered_entries=5)).first()
    assert row.page_role == "toc" and not row.index_enabled
    program = [block(t, no=k, y0=100 + 20 * k, mono=True) for k, t in enumerate(["import os", "def f():", "    x = 1", "    y = 2", "    return x", "print(f())"])]
    _, pages, blocks, _ = frames(spark, program)
    assert layout.classify_pages(pages, blocks, ParserConfig()).first().layout_kind == "normal"


def test_textbox_is_no_table(spark):
    long = "很长的说明文字" * 40
    _, pages, _, tables = frames(spark, [], tables=[("d", 1, 0, 10.0, 10.0, 590.0, 800.0, [[long, long], ["a", "b"]], None, None, None), ("d", 1, 1, 50.0, 100.0, 300.0, 200.0, [["a", "b", "c"]] * 4, None, None, None)])
    kept, rejected = layout.accept_tables(tables, pages, ParserConfig())
    assert [r.table_index for r in kept.collect()] == [1] and rejected.count() >= 1 and layout.rejection_reasons(rejected).count() >= 1


def test_blocks_in_tables_headers_and_fonts(spark):
    blocks = [b for p in (1, 2, 3) for b in (block("Repeated Header", page=p, y0=20, y1=35, no=1), block(f"正文 {p} 的内容。", page=p, y0=150, y1=170, no=2), block(f"Page {p}", page=p, y0=810, y1=830, no=3))]
    _, pages, b, tables = frames(spark, blocks, pages=3, tables=[("d", 1, 0, 60.0, 140.0, 530.0, 180.0, [["x"]], "x", 1.0, [])])
    assert {r.text for r in layout.drop_headers_footers(b, pages, ParserConfig()).collect()} == {"正文 1 的内容。", "正文 2 的内容。", "正文 3 的内容。"}
    assert layout.drop_blocks_in_tables(b, tables).where("page_number = 1").count() == 2
    assert layout.body_font_size(b).first().body_font_size == 12.0


def test_heading_path_by_windows(spark):
    titles = [("2.1 模块", 2, "numeric_hierarchy"), ("内容一在这里结束。", None, None), ("2.1.1 方法", 3, "numeric_hierarchy"), ("内容二在这里结束。", None, None), ("2.1.1 方法", 3, "numeric_hierarchy"), ("2.2 另一模块", 2, "numeric_hierarchy"), ("内容三在这里结束。", None, None)]
    _, pages, blocks, tables = frames(spark, [block(t, no=k, y0=100 + 30 * k, y1=120 + 30 * k, level=lv, source=s) for k, (t, lv, s) in enumerate(titles)])
    kinds = pages.withColumns({"layout_kind": F.lit("normal"), "page_role": F.lit("body"), "index_enabled": F.lit(True)})
    s, u = structure.build_structure(blocks, tables, kinds, ParserConfig())
    assert [r.heading_path for r in s.orderBy("section_seq").collect()] == [["2.1 模块"], ["2.1 模块", "2.1.1 方法"], ["2.2 另一模块"]]
    assert u.count() == 3


def test_cross_page_sentence_is_one_unit(spark):
    blocks = [block("1.1 示例", level=2, source="numeric_hierarchy", no=1), block("我们直", y0=760, y1=810, no=2), block("接使用本地模型进行向量化。", page=2, y0=40, y1=80, no=1)]
    _, pages, b, tables = frames(spark, blocks, pages=2)
    kinds = pages.withColumns({"layout_kind": F.lit("normal"), "page_role": F.lit("body"), "index_enabled": F.lit(True)})
    _, u = structure.build_structure(b, tables, kinds, ParserConfig())
    rows = u.collect()
    assert [(r.text, r.page_end) for r in rows] == [("我们直接使用本地模型进行向量化。", 2)] and len(rows[0].merged_unit_ids) == 2


def test_long_numbered_sentence_is_demoted(spark):
    title = "1. 多轮对话的语义连贯性不足:在用户多轮提问时,如果新问题是对上一轮回答的跟进(例如用户"
    blocks = [block(title, y0=100, y1=125, font=14, avg=12, bold=True, level=1, source="single_numeric_styled"), block("问:“这个怎么申请?”),系统需要理解“这个”指代什么。", y0=126, y1=150, no=2)]
    _, pages, b, tables = frames(spark, blocks)
    kinds = pages.withColumns({"layout_kind": F.lit("normal"), "page_role": F.lit("body"), "index_enabled": F.lit(True)})
    s, u = structure.build_structure(b, tables, kinds, ParserConfig())
    row = u.first()
    assert s.count() == u.count() == 1 and row.heading_path == [] and "例如用户问" in row.text and row.demoted


def unit(text, kind, rows=None, path=("标题",)):
    return {"unit_id": "u", "kind": kind, "text": text, "page_start": 1, "page_end": 1, "group_id": "g", "heading_path": list(path), "rows": rows, "unit_seq": 1}


def splitter(low, target, high):
    from vellum.functions.vectors import encoder

    return chunking.Splitter(ChunkConfig(low, target, high, 0), encoder("hashing", 256), target, high)


def test_splitters_keep_context():
    items = "请按以下步骤:\n" + "\n".join(f"{k}. 第{k}步需要打开设置页面并确认账号安全选项" for k in range(1, 36))
    pieces = splitter(70, 120, 180).split(unit(items, "list"))
    assert len(pieces) > 1 and all(p["split_strategy"] == "list_items" and "请按以下步骤" in p["text"] and rules.tokens(p["text"]) <= 180 for p in pieces)
    rows = [["产品", "版本", "说明"], *[[f"产品{k}", f"{k}.0", "支持权限管理与登录审计功能"] for k in range(30)]]
    pieces = splitter(70, 130, 190).split(unit(rules.markdown(rows), "table", rows))
    assert len(pieces) > 1 and all(p["text"].startswith("| 产品 | 版本 | 说明 |") and rules.tokens(p["text"]) <= 190 for p in pieces)
    huge = [["键", "值"], ["说明", "这是一个很长的单元格内容。" * 120]]
    assert all(rules.tokens(p["text"]) <= 160 and p["text"] for p in splitter(60, 110, 160).split(unit(rules.markdown(huge), "table", huge)))
    body = "def build_context(query):\n" + "\n".join(f"    value_{k} = '{'知识' * 20}'" for k in range(30)) + "\n    return query"
    pieces = splitter(40, 90, 130).split(unit(body, "code"))
    assert len(pieces) > 1 and all("def build_context(query):" in p["text"] for p in pieces) and any("PDF 代码续段" in p["text"] for p in pieces[1:])
    two = "import os\n\ndef first():\n    value = '账号权限登录安全' * 20\n    return value\n\ndef second():\n    value = '服务器网络容器部署' * 20\n    return value\n"
    pieces = splitter(40, 90, 150).split(unit(two, "code"))
    assert len(pieces) >= 2 and all(p["split_strategy"] == "code_top_level" for p in pieces) and any(p["break_before"] for p in pieces[1:])


def test_partition_bounds():
    config = ChunkConfig(40, 100, 150, 0)
    ranges = chunking.partition([10] * 60, [0.5] * 59, [None] * 60, 40, 100, 150, config)
    assert [a for a, _ in ranges[1:]] == [b for _, b in ranges[:-1]] and ranges[0][0] == 0 and ranges[-1][1] == 60 and all(b - a <= 15 for a, b in ranges)
    assert chunking.partition([], [], [], 1, 2, 3, config) == []
    with pytest.raises(ValueError):
        chunking.partition([500, 500], [0.1], [None, None], 40, 100, 150, config)


@pytest.fixture(scope="module")
def result(spark, tmp_path_factory):
    blocks = []
    for p, name in enumerate(["User Management", "Permission Management", "Audit Log"], 1):
        body = f"{name} explains accounts and roles. " * 12
        blocks += [block("Repeated Header", page=p, y0=30, y1=45, no=1), block(f"{p}. {name}", page=p, y0=100, y1=125, font=20, bold=True, no=2), block(body, page=p, y0=150, y1=300, no=3), block(f"Page {p}", page=p, y0=810, y1=825, no=4)]
    path = str(tmp_path_factory.mktemp("run"))

    def table(df, name):
        df.write.parquet(f"{path}/{name}")
        return spark.read.schema(df.schema).parquet(f"{path}/{name}")

    return pipeline.run(*frames(spark, blocks, pages=3), PipelineConfig(chunk=ChunkConfig(20, 60, 110, 10), semantic=SemanticConfig(hashing_dimensions=256)), table)


def test_end_to_end(result):
    assert result.parents.count() == 3 and result.children.count() >= 3
    assert not [r for r in result.page_texts.collect() if "Repeated Header" in r.text]
    rows = result.children.collect()
    assert all(r.token_estimate <= 110 and r.pipeline_version for r in rows)
    ids = {r.child_id for r in rows}
    assert all(x is None or x in ids for r in rows for x in (r.previous_child_id, r.next_child_id))
    pieces = result.pieces.orderBy("section_id", "piece_seq").collect()
    children = result.children.orderBy("section_id", "chunk_index").collect()
    assert [p.unit_id for p in pieces] == [u for c in children for u in c.unit_ids]
    report = result.report.first()
    assert report.errors == 0 and report.child_count == len(rows) and result.issues.where("severity = 'error'").count() == 0


def test_audit_fixture(spark):
    parents = spark.createDataFrame([(f"p{k}", f"标题{k}") for k in range(10)], quality.AUDIT_PARENT)
    children = spark.createDataFrame([(f"c{k}", f"p{k}", 40 if 1 <= k <= 4 else 220, ["一"], f"Text {k}", None, None) for k in range(10)], quality.AUDIT_CHILD)
    row = quality.audit(children, parents).first()
    assert (row.verdict, row.single_child_parent_ratio, row.flat_heading_path_ratio, row.short_child_ratio_lt_100) == ("not_ready", 1.0, 1.0, 0.4)
    units = spark.createDataFrame([("u", "code", "def f():\nreturn 1")], quality.AUDIT_UNIT)
    assert quality.audit(children, parents, units).first().python_ast_parseable_ratio == 0.0


def test_settings():
    assert PipelineConfig.from_dict({"chunk": {"max_tokens": 900}}).chunk.max_tokens == 900
    for wrong in ({"chunk": {"min_tokens": 900}}, {"nothing": {}}):
        with pytest.raises(ValueError):
            PipelineConfig.from_dict(wrong)
    with pytest.raises(TypeError):
        PipelineConfig.from_dict({"chunk": {"unknown": 1}})
