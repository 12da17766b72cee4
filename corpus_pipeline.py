"""The corpus pipeline: stages over ``documents``, each written as Parquet and read again as the next one's input.

1. ``quality``: documents that the base rules or the line labels reject go.
2. ``near_duplicates``: one document of each group of near copies (five-word shingles, similarity 0.8) stays, the one with
   the least doc_id.
3. ``repeats``: bytes of 50-byte strings that also start in a document with a smaller id are cut out of the texts.
4. ``mixture``: sources are raised towards equal weights; no document is dropped, those of small sources repeat.
5. ``pieces``: every text as SentencePiece ids.

Extra columns pass through the first four stages. A null text fails the first one; a null doc_id is in no group of near
copies; texts emptied by the third stage stay as empty rows. An empty table passes through as an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vellum.llm import common, mixing, near_copies, quality_rules, sentencepiece_scan, suffix_dedup

#: Passes over its own documents that the mixture lets a source make at most.
MAX_PASSES = 2.0


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_rules.keep(docs, quality_rules.train(docs, labels))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_copies.keep_one(docs)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return suffix_dedup.cleaned(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.repeat(docs, max_passes=MAX_PASSES)


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return sentencepiece_scan.encode(docs, sentencepiece_scan.model_path())


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("repeats", repeats), ("mixture", mixture), ("pieces", pieces)]

#: SQL expresses neither the labelling of lines nor the fingerprints; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order over ``documents``; the last one's rows."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    path = common.workdir(spark, "pipeline")
    for k, (_, stage) in enumerate(STAGES):
        docs = common.table(stage(spark, docs, sf_dir), f"{path}/{k}")
    return docs
