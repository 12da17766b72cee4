"""Expressions against the plain rules, and both against fixed cases."""

import pytest
from pyspark.sql import functions as F

from vellum.functions import rules
from vellum.functions import text as T

CASES = [
    "Plain Text\n●\n正文内容\n1 2 3 4 5 6", "", " ", "1. 修改密码", "用户可以翻", "更多课程联系微信:1978201801", "扫码关注公众号 rag-course", "如需技术支持，请联系管理员。", "12 13 14", "12 14", "page 3 / 10", "因此，系统会",
    "abc,def,ghi", "A long line: with a tail that goes on and on", "１２３ full-width：text", "hello world　x", "2.1 Query模块", "end of sentence.", "注意：这里", "a\x0bb\x1cc", "Copy code", "该方法用于" + "很" * 40, None,
]


@pytest.fixture(scope="module")
def cases(spark):
    return spark.createDataFrame(list(enumerate(CASES)), "k int, t string")


@pytest.mark.parametrize(
    ("expression", "rule"),
    [
        (T.normalize_inline, rules.inline), (T.clean, rules.clean), (T.visible_chars, rules.visible), (T.estimate_tokens, rules.tokens), (lambda c: T.is_noise(T.normalize_inline(c)), lambda s: rules.noise(s or "")),
        (T.is_list_line, lambda s: rules.list_line(s or "")), (lambda c: T.like_sentence(T.normalize_inline(c)), lambda s: rules.like_sentence(s or "")), (lambda c: T.continues(T.normalize_inline(c)), lambda s: rules.continues(s or "")),
        (T.ends_sentence, lambda s: rules.ends_sentence(s or "")), (lambda c: T.opens_paragraph(T.normalize_inline(c)), lambda s: rules.opens_paragraph(s or "")), (lambda c: T.split_sentences(T.clean(c)), lambda s: rules.sentences(s or "")),
    ],
)
def test_expression_equals_rule(cases, expression, rule):
    got = {r["k"]: r["x"] for r in cases.select("k", expression(F.col("t")).alias("x")).collect()}
    assert got == {k: rule(t) for k, t in enumerate(CASES)}


def test_fixed_cases(cases):
    by = {r["t"]: r for r in cases.select("t", T.is_promotion(F.col("t")).alias("promo"), T.is_page_number(F.col("t")).alias("page"), T.is_number_run(F.col("t")).alias("run")).collect()}
    assert by["更多课程联系微信:1978201801"].promo and by["扫码关注公众号 rag-course"].promo and not by["如需技术支持，请联系管理员。"].promo
    assert by["page 3 / 10"].page and by["12 13 14"].run and not by["12 14"].run
    assert rules.clean("Plain Text\n●\n正文内容\n1 2 3 4 5 6") == "正文内容"


def test_joins():
    left = "离线处理主要包括:\n1. 知识文档库:建立知识基础\n2. 文档向量化:转换为向量\n3. 向量数据库:建立检索索引"
    assert "检索索引\n\n离线流程" in rules.join(left, "离线流程只需执行一次或定期更新。")
    assert rules.join("用户可以翻", "阅自己的参考书。") == "用户可以翻阅自己的参考书。" and rules.join("提高销售技", "巧。") == "提高销售技巧。"
    assert rules.mend_blank_lines("在需要回答问题时能翻\n\n阅自己的参考书。\n\n这是新的完整段落。") == "在需要回答问题时能翻阅自己的参考书。\n\n这是新的完整段落。"


def test_tables_and_ids(spark):
    df = spark.createDataFrame([([["a", "b|c"], ["d"]],)], "rows array<array<string>>")
    assert df.select(T.table_to_markdown(F.col("rows"))).first()[0] == rules.markdown([["a", "b|c"], ["d"]]) == "| a | b\\|c |\n| --- | --- |\n| d |  |"
    one = spark.range(1).select(T.stable_id("x", F.lit("a"), F.lit(1)).alias("a"), T.rewrite_query(F.lit("怎么报销保险费用？")).alias("q"), T.word_set(F.lit("Ab ab 中文")).alias("w"), T.split_env_list(F.lit("a, ,b")).alias("e")).first()
    assert len(one.a) == 26 and one.q == "保险费用报销流程是什么？" and one.w == ["ab", "中", "文"] and one.e == ["a", "b"]
    assert rules.hard_split("", 5) == [] and all(rules.tokens(p) <= 60 for p in rules.hard_split("字" * 500, 50))
    assert all(rules.tokens(p) <= 100 for p in rules.hard_split("a " * 2000 + "dense" * 400, 100))
