"""Quality rules: a linear-chain CRF labels every line content or boilerplate; the share of content decides retention.

The model is fitted on the driver to a bounded sample of labelled documents (``SAMPLE_DOCS`` of them, the lowest by MD5
of the id), whose lines are all used: every line of a sampled document takes the document's quality label, so what the
model learns as boilerplate is what lines of poor documents look like; the chain and the other lines average out the
lines that do not deserve it. Executors compute the features of the sample, and for fitting a document's lines are cut
into chains of ``SEGMENT``. All counts and all decisions cover every line of every text, as one chain. Scoring is one pass over the documents in Arrow batches, cut so that a task holds a few megabytes of
text (or one text) at a time; nothing is shuffled.

A null text has no words, fails the base rules and is not kept. Repeated rows get equal results. With no labelled row
the model says content everywhere, so the base rules decide alone. Null or contradicting labels: nulls are ignored, of
several labels of a document the lowest counts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import common, crf

SAMPLE_DOCS = 3000
#: Lines of a chain when the model is fitted.
SEGMENT = 256
#: Least share of a text's words on content lines.
CONTENT_SHARE = 0.5
#: Fewest words of a text.
MIN_WORDS = 50
BATCH_BYTES = 4 << 20
KEEP_ALL = {"state": np.stack([np.zeros(len(crf.FEATURES)), np.eye(len(crf.FEATURES))[0]]).tolist(), "transition": [[0.0, 0.0], [0.0, 0.0]]}


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE_DOCS) -> dict:
    """Fit the CRF to ``sample`` labelled documents; ``labels`` has the document's id and ``quality`` 0 or 1."""
    known = labels.where("quality IS NOT NULL").groupBy(F.col(doc_id).alias("__id")).agg(F.min("quality").alias("__quality"))
    chosen = F.broadcast(known.orderBy(F.md5(F.col("__id").cast("string")), "__id").limit(sample))  # at most `sample` rows
    rows = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text")).join(chosen, "__id")
    once = rows.where("__text IS NOT NULL").groupBy("__id").agg(F.min(F.struct("__quality", "__text")).alias("r")).select(F.col("__id").cast("string").alias("id"), F.col("r.__quality").cast("int").alias("quality"), F.col("r.__text").alias("text"))

    def features(batches):
        for b in batches:
            for i, q, t in zip(*(c.to_pylist() for c in b.columns), strict=True):
                x = crf.Lines([t.encode("utf-8", "surrogatepass")]).x
                yield pa.RecordBatch.from_arrays([pa.array([i]), pa.array([q], pa.int32()), pa.array([x.astype("<f4").tobytes()], pa.binary())], names=["id", "quality", "x"])

    found = sorted(once.mapInArrow(features, "id string, quality int, x binary").collect(), key=lambda r: r["id"])  # at most `sample` rows
    if len({r["quality"] for r in found}) < 2:
        return KEEP_ALL
    parts = [np.frombuffer(r["x"], "<f4").reshape(-1, len(crf.FEATURES)) for r in found]
    chains = [(min(SEGMENT, len(x) - a), r["quality"]) for x, r in zip(parts, found, strict=True) for a in range(0, len(x), SEGMENT)]
    if not chains:
        return KEEP_ALL
    lengths, quality = (np.array(c) for c in zip(*chains, strict=True))
    return crf.train(np.concatenate(parts).astype(float), lengths, np.repeat(quality, lengths))


def judge(texts: list[str | None], model: dict) -> dict[str, np.ndarray]:
    """Counts, content share and verdict of each text."""
    lines = crf.Lines([(t or "").encode("utf-8", "surrogatepass") for t in texts])
    labels = crf.viterbi(lines.x, lines.lengths(), model)
    content = np.bincount(lines.line_doc, labels * lines.line_words, minlength=len(texts))
    share = content / np.maximum(lines.n_words, 1)
    failed = (lines.n_words < MIN_WORDS) | (100 * lines.n_repeat_words > 50 * lines.n_words)
    return {
        "n_words": lines.n_words, "word_chars": lines.word_chars, "n_symbols": lines.n_symbols, "n_dup_lines": lines.n_dup_lines, "n_repeat_words": lines.n_repeat_words,
        "base_failed": failed, "content_share": share, "kept": ~failed & (share >= CONTENT_SHARE),
    }


def score(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id``, the counts, ``base_failed, content_share, kept`` per row."""

    def run(batches):
        for b in batches:
            for part in common.slices(b, common.byte_sizes(b.column(1)), BATCH_BYTES):
                got = judge(part.column(1).to_pylist(), model)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(x) for x in got.values()]], names=[doc_id, *got])

    kinds = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"
    rows = docs.select(F.col(doc_id).alias(doc_id), F.col(text).cast("string").alias("__text"))
    return rows.mapInArrow(run, f"`{doc_id}` {rows.schema[0].dataType.simpleString()}, {kinds}")


def keep(docs: DataFrame, model: dict, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the rules keep, with all their columns."""
    at = docs.columns.index(text)

    def run(batches):
        for b in batches:
            for part in common.slices(b, common.byte_sizes(b.column(at)), BATCH_BYTES):
                yield part.filter(pa.array(judge(part.column(at).to_pylist(), model)["kept"]))

    return docs.mapInArrow(run, docs.schema)


def line_labels(docs: DataFrame, model: dict, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, line, n_words, content``: the label of every line that holds a word; lines count from 0."""

    def run(batches):
        for b in batches:
            for part in common.slices(b, common.byte_sizes(b.column(1)), BATCH_BYTES):
                lines = crf.Lines([(t or "").encode("utf-8", "surrogatepass") for t in part.column(1).to_pylist()])
                got = crf.viterbi(lines.x, lines.lengths(), model)
                ids = part.column(0).take(pa.array(lines.line_doc))
                yield pa.RecordBatch.from_arrays([ids, pa.array(lines.line_number, pa.int64()), pa.array(lines.line_words, pa.int64()), pa.array(got == crf.CONTENT)], names=[doc_id, "line", "n_words", "content"])

    rows = docs.select(F.col(doc_id).alias(doc_id), F.col(text).cast("string").alias("__text"))
    return rows.mapInArrow(run, f"`{doc_id}` {rows.schema[0].dataType.simpleString()}, line long, n_words long, content boolean")


def op10_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every text of ``documents``, by a model fitted to a sample of ``labels``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
