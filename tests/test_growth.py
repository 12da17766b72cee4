"""What must not grow faster than the input: work done once, rows that meet, memory of one task."""

import pytest
from pyspark.sql import functions as F

from vellum.config import ChunkConfig
from vellum.functions import rules
from vellum.operators import chunking, folds


def test_short_sections_are_not_encoded():
    def encode(texts):
        raise AssertionError("nothing to compare")

    piece = {"unit_id": "u", "text": "A short text.", "group_id": None, "break_before": False, "break_after": False}
    assert [len(own) for _, own in chunking.pack([piece, piece | {"unit_id": "v"}], 10, ChunkConfig(), encode)] == [2]


def test_folds_stay_apart(spark):
    rows = spark.range(40).select((F.col("id") % 8).alias("k"), "id", F.when(F.col("id") > 1, F.col("id")).alias("v"))
    got = folds.by_group(rows, ["k"], lambda group: [{"k": group[0]["k"], "ids": [r["id"] for r in sorted(group, key=lambda r: folds.late(r["v"]))]}], "k long, ids array<long>")
    assert {r.k: r.ids for r in got.collect()} == {k: [*range(k + 8, 40, 8), k] if k < 2 else [*range(k, 40, 8)] for k in range(8)}
    assert got.rdd.getNumPartitions() > 1  # a few bytes each, yet not put together


@pytest.mark.parametrize("text", ["a  b", "a\t b ", "ａ​ b\xad", "", None, "x\x0by"])
def test_inline_is_the_pattern(text):
    import re
    import unicodedata

    plain = unicodedata.normalize("NFKC", text or "").translate({0xAD: None, 0x200B: None, 0xFEFF: None})
    assert rules.inline(text) == re.sub(r"[\t\v\f\r ]+", " ", plain).strip()


def test_lines_do_not_meet_at_one_key(spark, tmp_path):
    from vellum.plans import texts

    long = "word " * 60
    spark.createDataFrame([(k, f"{long}{k}\n\nshared 1\nown {'abcdefgh'[k] * 3}") for k in range(5)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = texts.q_lines_without_boilerplate(spark, str(tmp_path))
    assert {tuple(r) for r in got.collect()} == {(k, 3, 301 + 7) for k in range(5)}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftAnti" in plan and "Union" in plan  # blank and long lines, all of pattern '', stay out of the join


def test_equal_tables_meet_blocks_once(spark):
    from vellum.operators import layout

    box = ["10.0D AS x0", "10.0D AS y0", "50.0D AS x1", "50.0D AS y1"]
    blocks = spark.range(3).selectExpr("'d' AS document_id", "CAST(id AS INT) AS page_number", *box)
    tables = spark.range(20).selectExpr("'d' AS document_id", "1 AS page_number", *box)
    got = layout.drop_blocks_in_tables(blocks, tables)
    assert sorted(r.page_number for r in got.collect()) == [0, 2]
    assert "Aggregate" in got._jdf.queryExecution().optimizedPlan().toString()  # equal boxes count once


def test_top_k_scores_few_queries_at_once(spark, monkeypatch):
    from vellum.operators import retrieval

    docs = spark.createDataFrame([(k, [float(k % 7), float(k % 5)]) for k in range(60)], "vec_id long, embedding array<float>")
    want = retrieval.top_k_each(docs, docs.withColumnRenamed("vec_id", "query_id"), 3).collect()
    monkeypatch.setattr(retrieval, "CELLS", 4096 * 7)  # seven queries at once
    assert sorted(retrieval.top_k_each(docs, docs.withColumnRenamed("vec_id", "query_id"), 3).collect()) == sorted(want) and len(want) == 180


def test_cells_of_a_table_are_counted_once(spark):
    from vellum.config import ParserConfig
    from vellum.operators import layout

    t = spark.createDataFrame([([["a", "b"], ["c", ""], ["d", "e"]],)], "rows array<array<string>>")
    got = t.select(layout.score_table(F.col("rows"), tuple(F.lit(float(x)) for x in (0, 0, 10, 10)), F.lit(1e4), ParserConfig()).alias("s"))
    assert got.first().s.score > 0.5 and got._jdf.queryExecution().optimizedPlan().toString().count("regexp_replace(") <= 2


def test_training_counts_grams_where_the_texts_lie(spark, monkeypatch):
    from collections import Counter

    from vellum.operators import ml

    texts = [("Ab  b", "x"), ("", "x"), (None, "y"), ("bÉ\n\tb𝒳中", "y"), ("ab", "x")]
    rows = spark.createDataFrame(texts, "text string, label string")
    want = {}
    for t, y in texts:
        t = (t or "").lower().replace("  ", " ").replace("\n\t", " ")
        want.setdefault(y, Counter()).update([*t, *(a + b for a, b in zip(t, t[1:], strict=False)), None])
    for pairs in (ml.PAIRS, 1):  # by a table of pairs, and by sorting them
        monkeypatch.setattr(ml, "PAIRS", pairs)
        assert {(r.label, r.gram): r.n for r in ml.count_ngrams(rows, "text", "label").collect()} == {(y, g): n for y, c in want.items() for g, n in c.items()}
    grams = ml.char_ngrams
    monkeypatch.setattr(ml, "char_ngrams", lambda *_: pytest.fail("an array of all grams of each text"))
    model = ml.train_text_classifier(rows)
    monkeypatch.setattr(ml, "char_ngrams", grams)
    total = want["x"] + want["y"]
    assert model.stages[1].vocabulary == sorted((g for g in total if g), key=lambda g: (-total[g], g.encode()))
    assert [round(2.718281828459045**p, 6) for p in model.stages[2].pi] == [round(4 / 7, 6), round(3 / 7, 6)]  # smoothed
    assert [r.predicted for r in ml.classify_texts(model, spark.createDataFrame([("中",), ("ab",)], "text string")).collect()] == ["y", "x"]


def test_equal_programs_are_rebuilt_once_a_batch(spark, monkeypatch):
    import pyarrow as pa

    from vellum.functions import code

    shape = pa.list_(pa.struct([("text", pa.string()), ("x0", pa.float64())]))
    pieces = [[("def f():", 1.0), ("retur", 19.0), ("n 1", 19.0)], [("def f():", 1.0), ("retur", 19.0), ("n 1", 19.0)], [("def f():", 1.0)], None, [], [("x = 1", 2.0), ("1", 3.0)], [("if a:", -0.0), ("b", 40.0)], [("if a:", 0.0), ("b", 40.0)]]
    rows = [p if p is None else [{"text": t, "x0": x} for t, x in p] for p in pieces]
    want = [p if p is None else code.rebuild([t for t, _ in p], [x for _, x in p]) for p in pieces]
    seen, plain = [], code.rebuild
    monkeypatch.setattr(code, "rebuild", lambda *a: seen.append(a) or plain(*a))
    assert code._rebuilt(pa.array([[{"text": "y", "x0": 1.0}], *rows], shape).slice(1), 4).to_pylist() == want  # an offset is kept
    assert len(seen) == 5 and want[0] == "def f():\n    return 1"
    df = spark.createDataFrame([(k, p) for k, p in enumerate(pieces)], "k int, p array<struct<text:string,x0:double>>")
    assert [r.t for r in df.select("k", code.rebuild_column(F.col("p")).alias("t")).orderBy("k").collect()] == want


def test_texts_are_cleaned_and_cut_a_text_at_a_time(spark):
    from vellum.functions import text as T

    cases = ["٢ ٣\n1 2 3\n1 3\n7\n12 13ἀ", "a.\x1fB. C\x1f! d", "Plain\tText\nCıode\n●●\nx\t\ty  z\x85​\r\n\n。；q", "A.b. C\n\n\nD", " \n", "", None]
    want = {  # cleaned by the expressions, cut by the pattern
        0: "1 3\n7\n12 13ἀ", 1: "a.\x1fB. C\x1f! d", 2: "Cıode\nx y z\n。;q", 3: "A.b. C\nD", 4: "", 5: "", 6: "",
    }
    df = spark.createDataFrame(list(enumerate(cases)), "k int, t string").withColumn("c", T.clean(F.col("t")))
    lined = F.array_join(F.filter(F.transform(T.lines(T.nfkc(F.col("t"))), T.squeeze), lambda x: ~T.is_noise(x)), "\n")
    got = df.select("k", "c", lined.alias("by_line"), T.split_sentences(F.col("c")).alias("s"))
    rows = {r.k: r for r in got.collect()}
    assert {k: r.c for k, r in rows.items()} == {k: r.by_line for k, r in rows.items()} == want
    assert rows[1].s == ["a.\x1fB.", "C\x1f!", "d"] and rows[2].s == ["Cıode\nx y z\n。", ";", "q"] and rows[3].s == ["A.b.", "C\nD"] and rows[5].s == []
    plan = df.select(F.size(T.split_sentences(F.col("c")))).drop("t")._jdf.queryExecution().optimizedPlan().toString()
    assert "transform(" not in plan and "lambda" not in plan  # no interpreted step for each line


def test_heading_paths_sort_a_document_once(spark):
    from vellum.operators import structure

    rows = [  # document, page, epoch, y0, text, level
        ("d", 1, 0, 0.0, "body", None), ("d", 1, 0, 1.0, "A", 1), ("d", 1, 0, 2.0, "B", 3), ("d", 1, 0, 3.0, "a ", 2), ("d", 1, 0, 4.0, "b", None), ("d", 1, 0, 5.0, "A", 2), ("d", 1, 0, 6.0, "c", None),
        ("d", 2, 1, 0.0, "A", 4), ("d", 2, 1, 1.0, "d", None), ("d", 3, 2, 0.0, "e", None), ("f", 1, 0, 0.0, "g", None),
    ]
    e = spark.createDataFrame(rows, "document_id string, page_number int, epoch long, y0 double, text string, heading_level int")
    e = e.selectExpr("*", "0.0D AS x0", "false AS is_table", "CAST(y0 AS INT) AS no", "heading_level IS NOT NULL AS heading")
    order = structure.Window.partitionBy("document_id").orderBy("page_number", "y0", "x0", "is_table", "no")
    placed = structure.heading_paths(e.withColumn("pos", F.row_number().over(order))).select("document_id", "text", "section_seq", "heading_path", "title")
    assert {(r.document_id, r.text): (r.section_seq, r.heading_path, r.title) for r in placed.collect()} == {
        ("d", "body"): (0, [], "文档正文"), ("d", "b"): (3, ["A", "a"], "a"), ("d", "c"): (3, ["A", "a"], "a"), ("d", "d"): (4, ["A"], "A"), ("d", "e"): (5, [], "文档正文"), ("f", "g"): (0, [], "文档正文"),
    }
    plan = placed._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert plan.count("Sort [") == 1  # not again for epochs and positions
