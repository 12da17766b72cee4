"""Models: naive Bayes on character n-grams, linear regression, a small perceptron; all through Spark ML."""

from __future__ import annotations

from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import MultilayerPerceptronClassifier, NaiveBayes
from pyspark.ml.feature import CountVectorizerModel, StringIndexerModel, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.operators.folds import slices

#: Grams of a vocabulary at most, as in Spark ML.
VOCABULARY = 1 << 18
#: Characters counted at once, distinct grams a task holds before it passes them on, and the largest table of pairs.
COUNTED, HELD, PAIRS = 4_000_000, 1_000_000, 1 << 22


def _spaced(c: Column) -> Column:
    """The lower-case text with single spaces, whose characters make the grams."""
    return F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s\s+", " ")


def char_ngrams(c: Column, longest: int = 2) -> Column:
    """All character n-grams of up to ``longest`` characters of the lower-case text with single spaces."""
    chars = F.filter(F.split(_spaced(c), ""), lambda x: x != "")
    grams, out = chars, chars
    for n in range(2, longest + 1):  # each gram and the character behind it
        size = F.greatest(F.size(chars) - n + 1, F.lit(0))
        grams = F.zip_with(F.slice(grams, F.lit(1), size), F.slice(chars, n, size), lambda a, b: F.concat(a, b))
        out = F.concat(out, grams)
    return out


def _tally(texts: list[str]) -> dict[str, int]:
    """Distinct n-grams of one and two characters of all texts and their counts. No gram spans two texts."""
    flat = np.frombuffer("".join(texts).encode("utf-32-le"), "<u4")
    if not len(flat):
        return {}
    each = np.bincount(flat)
    names = np.flatnonzero(each)
    number = np.zeros(len(each), np.int64)
    number[names] = np.arange(len(names))
    chars, k = number[flat], len(names)
    inside = np.ones(len(flat), bool)  # whether another character of the same text follows
    ends = np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)))
    inside[ends[ends > 0] - 1] = False
    pairs = (chars[:-1] * k + chars[1:])[inside[:-1]]
    if k * k <= PAIRS:
        table = np.bincount(pairs, minlength=1)
        seen = np.flatnonzero(table)
        n = table[seen]
    else:
        seen, n = np.unique(pairs, return_counts=True)
    spelt = [chr(x) for x in names.tolist()]
    found = dict(zip(spelt, each[names].tolist(), strict=True))
    found.update((spelt[p // k] + spelt[p % k], c) for p, c in zip(seen.tolist(), n.tolist(), strict=True))
    return found


def count_ngrams(labelled: DataFrame, text: str, label: str) -> DataFrame:
    """``label, gram, n``: how often the texts of a label hold each gram of :func:`char_ngrams`, and under a null gram how
    many texts the label has. Texts are counted where they lie; a task passes on a row per label and distinct gram."""

    def count(batches):
        held: dict[tuple[str, str | None], int] = {}

        def rows():
            shape = pa.schema([("label", pa.string()), ("gram", pa.string()), ("n", pa.int64())])
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in held]), pa.array([x for _, x in held], pa.string()), pa.array(list(held.values()), pa.int64())], schema=shape)

        for b in chain.from_iterable(slices(x, pc.utf8_length(x.column(1)).to_pylist(), COUNTED) for x in batches):
            if b.column(0).null_count:
                raise ValueError("a label is null")
            for name in b.column(0).unique().to_pylist():
                texts = b.column(1).filter(pc.equal(b.column(0), name)).to_pylist()
                for gram, n in (_tally(texts) | {None: len(texts)}).items():
                    held[name, gram] = held.get((name, gram), 0) + n
            if len(held) > HELD:
                yield rows()
                held.clear()
        if held:
            yield rows()

    counted = labelled.select(F.col(label).cast("string").alias("label"), _spaced(F.col(text)).alias("text")).mapInArrow(count, "label string, gram string, n long")
    return counted.groupBy("label", "gram").agg(F.sum("n").alias("n"))


def train_text_classifier(labelled: DataFrame, text: str = "text", label: str = "label", smoothing: float = 1.0) -> PipelineModel:
    """Multinomial naive Bayes on counts of character n-grams; the most frequent ones make the vocabulary.

    The model depends on the texts only by the sum of each label's counts. So these are fitted: a row per label with the
    sums, and an empty one that weighs as much as its other texts."""
    spark = labelled.sparkSession
    counts = count_ngrams(labelled, text, label).groupBy("gram").agg(F.map_from_entries(F.collect_list(F.struct("label", "n"))).alias("by"), F.sum("n").alias("n"))
    rows = counts.orderBy(F.col("gram").isNotNull(), F.desc("n"), "gram").limit(VOCABULARY + 1).select("gram", "by").collect()  # the null gram first
    if not rows:
        raise ValueError("no texts to learn from")
    texts, grams = rows[0].by, rows[1:]
    names = sorted(texts)
    fitted = []
    for k, name in enumerate(names):
        own = [(at, float(r.by[name])) for at, r in enumerate(grams) if name in r.by]
        fitted += [(float(k), 1.0, Vectors.sparse(len(grams), own)), (float(k), float(texts[name] - 1), Vectors.sparse(len(grams), []))]
    bayes = NaiveBayes(featuresCol="__counts", labelCol="__label", weightCol="__weight", smoothing=smoothing).fit(spark.createDataFrame(fitted, ["__label", "__weight", "__counts"]))
    bayes.clear(bayes.weightCol)
    return PipelineModel([StringIndexerModel.from_labels(names, inputCol=label, outputCol="__label"), CountVectorizerModel.from_vocabulary([r.gram for r in grams], inputCol="__grams", outputCol="__counts"), bayes])


def classify_texts(model: PipelineModel, texts: DataFrame, text: str = "text") -> DataFrame:
    """``texts`` with ``predicted``, a label's name."""
    names = F.array(*[F.lit(x) for x in model.stages[0].labels])
    stages = PipelineModel(model.stages[1:])
    out = stages.transform(texts.withColumn("__grams", char_ngrams(F.col(text))))
    return out.withColumn("predicted", F.element_at(names, F.col("prediction").cast("int") + 1)).select(*texts.columns, "predicted")


def linear_regression(df: DataFrame, features: list[str], label: str) -> tuple[list[float], float]:
    """Weights and intercept of least squares."""
    fitted = LinearRegression(featuresCol="__x", labelCol=label).fit(VectorAssembler(inputCols=features, outputCol="__x").transform(df))
    return list(fitted.coefficients), fitted.intercept


def perceptron(df: DataFrame, features: list[str], label: str, layers: list[int], seed: int = 42) -> PipelineModel:
    stages = [VectorAssembler(inputCols=features, outputCol="__x"), MultilayerPerceptronClassifier(featuresCol="__x", labelCol=label, layers=layers, seed=seed, maxIter=200)]
    return Pipeline(stages=stages).fit(df)


def accuracy(df: DataFrame, prediction: str = "prediction", label: str = "label") -> DataFrame:
    return df.agg(F.avg((F.col(prediction) == F.col(label)).cast("double")).alias("accuracy"))


def mean_loss(df: DataFrame, prediction: str = "prediction", label: str = "label", kind: str = "squared") -> DataFrame:
    """One row: the mean ``squared`` or ``absolute`` error, or the ``log`` loss of a probability (kept off 0 and 1 by 1e-15)."""
    p, y = F.col(prediction).cast("double"), F.col(label).cast("double")
    q = F.least(F.greatest(p, F.lit(1e-15)), F.lit(1 - 1e-15))
    loss = {"squared": (p - y) * (p - y), "absolute": F.abs(p - y), "log": -(y * F.ln(q) + (1 - y) * F.ln(1 - q))}[kind]
    return df.agg(F.avg(loss).alias("loss"))


def save(model: PipelineModel, path: str, overwrite: bool = False) -> None:
    """Store a model; one that is there already stays unless told otherwise."""
    (model.write().overwrite() if overwrite else model.write()).save(path)


def load(path: str) -> PipelineModel:
    return PipelineModel.load(path)


def circle(spark, n: int, seed: int) -> DataFrame:
    """Seeded points and whether they lie in the unit circle."""
    p = spark.range(n).select((F.randn(seed)).alias("x"), F.randn(seed + 1).alias("y"))
    return p.withColumn("label", (F.col("x") ** 2 + F.col("y") ** 2 < 1).cast("double"))
