"""Sinks: the artifacts of a pipeline run, upserts, and files that must not be there yet."""

from __future__ import annotations

import json
import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.operators.tabular import latest


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares (``spark.checkpoint.dir``); on one machine a temporary one, elsewhere an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
    return (base or f"file://{tempfile.gettempdir()}/vellum-{spark.sparkContext.applicationId}").rstrip("/")


def to_jsonl(df: DataFrame) -> DataFrame:
    """One column ``value`` with each row as JSON."""
    return df.select(F.to_json(F.struct("*")).alias("value"))


def write_jsonl(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """JSON lines; Spark's commit protocol makes the files appear at once."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def document_markdown(page_texts: DataFrame) -> DataFrame:
    """``document_id, markdown``: the pages of each document with a comment in front of each."""
    part = F.concat(F.lit("<!-- page: "), F.col("page_number"), F.lit(" -->\n\n"), F.coalesce("text", F.lit("")))
    ordered = F.array_sort(F.collect_list(F.struct("page_number", part.alias("part"))))
    return page_texts.groupBy("document_id").agg(F.concat(F.array_join(F.transform(ordered, lambda x: x.part), "\n\n"), F.lit("\n")).alias("markdown"))


def manifest(documents: DataFrame, units: DataFrame, parents: DataFrame, children: DataFrame, report: DataFrame) -> DataFrame:
    """One row per document: the counts of its artifacts and its readiness."""
    count = lambda df, name: df.groupBy("document_id").agg(F.count("*").alias(name))
    out = documents.select("document_id", "file_name", "sha256", "page_count")
    for df, name in ((units, "atomic_units"), (parents, "parents"), (children, "children"), (children.where("index_enabled"), "indexable_children")):
        out = out.join(count(df, name), "document_id", "left")
    return out.fillna(0).join(report.select("document_id", "readiness"), "document_id", "left")


def write_run(path: str, result) -> None:
    """All artifacts of a :class:`vellum.plans.pipeline.Result` below ``path``."""
    write_jsonl(result.documents, f"{path}/document")
    document_markdown(result.page_texts).write.mode("overwrite").parquet(f"{path}/document_markdown")
    write_jsonl(result.pieces, f"{path}/atomic_units")
    write_jsonl(result.parents, f"{path}/parents")
    write_jsonl(result.children, f"{path}/children")
    write_jsonl(result.children.where("index_enabled"), f"{path}/indexable_children")
    write_jsonl(result.report, f"{path}/quality_report")
    write_jsonl(result.issues, f"{path}/quality_issues")
    write_jsonl(manifest(result.documents, result.pieces, result.parents, result.children, result.report), f"{path}/manifest")


def append(df: DataFrame, path: str) -> None:
    df.write.mode("append").parquet(path)


def write_new(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Raises where something is there already, unless it may be replaced."""
    df.write.mode("overwrite" if overwrite else "errorifexists").parquet(path)


def save_checkpoint(spark: SparkSession, path: str, run_id: str, namespace: str, state: dict, updated_at: str) -> None:
    """Append a state; readers take the newest of a run (:func:`checkpoints`)."""
    row = [(run_id, namespace, json.dumps(state, ensure_ascii=False, sort_keys=True), updated_at)]
    append(spark.createDataFrame(row, "run_id string, namespace string, state_json string, updated_at string").withColumn("updated_at", F.col("updated_at").cast("timestamp")), path)


def checkpoints(spark: SparkSession, path: str) -> DataFrame:
    return latest(spark.read.parquet(path), "run_id", "updated_at")
