"""Matrices as long tables ``(i, j, v)``, so that any size is distributed; small square ones also through NumPy."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def from_arrays(df: DataFrame, row: str, values: str) -> DataFrame:
    """Rows of arrays as a long matrix; columns count from 0."""
    return df.select(F.col(row).cast("long").alias("i"), F.posexplode(values).alias("j", "v")).select("i", F.col("j").cast("long").alias("j"), F.col("v").cast("double").alias("v"))


def to_arrays(m: DataFrame) -> DataFrame:
    """``i, values``: rows as arrays in column order."""
    return m.groupBy("i").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda x: x.v).alias("values"))


def reduce(m: DataFrame, axis: int | None = None) -> DataFrame:
    """Sum, mean, least and greatest value: of all, of each column (axis 0) or of each row (axis 1)."""
    grouped = m.groupBy(*{None: [], 0: ["j"], 1: ["i"]}[axis])
    return grouped.agg(F.sum("v").alias("total"), F.avg("v").alias("mean"), F.min("v").alias("least"), F.max("v").alias("greatest"))


def elementwise(m: DataFrame, f) -> DataFrame:
    """``f(v)`` in every cell: arithmetic, masks, clipping."""
    return m.withColumn("v", f(F.col("v")))


def clip(v: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(v, F.lit(low)), F.lit(high))


def combine(a: DataFrame, b: DataFrame, f) -> DataFrame:
    """``f(a, b)`` cell by cell of two matrices of one shape; cells that only one has raise."""
    both = a.alias("a").join(b.alias("b"), ["i", "j"], "full_outer")
    checked = F.when(F.col("a.v").isNull() | F.col("b.v").isNull(), F.raise_error(F.lit("shapes differ")).cast("double")).otherwise(f(F.col("a.v"), F.col("b.v")))
    return both.select("i", "j", checked.alias("v"))


def broadcast_row(m: DataFrame, row: DataFrame, f) -> DataFrame:
    """``f(v, r)`` with a vector ``(j, r)`` along every row; a vector of another length raises."""
    return _along(m, row, "j", f)


def _along(m: DataFrame, vector: DataFrame, axis: str, f) -> DataFrame:
    fits = F.when(F.col("v").isNotNull() & F.col("r").isNotNull(), f(F.col("v"), F.col("r"))).otherwise(F.raise_error(F.lit("shapes differ")).cast("double"))
    return m.join(vector, axis, "full_outer").select("i", "j", fits.alias("v"))


def broadcast_column(m: DataFrame, column: DataFrame, f) -> DataFrame:
    """``f(v, r)`` with a vector ``(i, r)`` along every column; a vector of another length raises."""
    return _along(m, column, "i", f)


def transpose(m: DataFrame) -> DataFrame:
    return m.select(F.col("j").alias("i"), F.col("i").alias("j"), "v")


def reshape(m: DataFrame, columns: int, new_columns: int) -> DataFrame:
    """The same cells in row order with another number of columns, which must divide the number of cells."""
    at = F.col("i") * columns + F.col("j")
    cells = m.agg(F.coalesce((F.max("i") + 1) * columns, F.lit(0)).alias("cells"))  # one row
    whole = m.join(F.broadcast(cells)).where(F.when(F.col("cells") % new_columns == 0, True).otherwise(F.raise_error(F.lit("shapes differ")).cast("boolean")))
    return whole.select(F.floor(at / new_columns).cast("long").alias("i"), (at % new_columns).alias("j"), "v")


def matmul(a: DataFrame, b: DataFrame) -> DataFrame:
    """Product: an equi-join on the inner index and a sum that is combined before the shuffle."""
    left, right = a.select("i", F.col("j").alias("k"), F.col("v").alias("x")), b.select(F.col("i").alias("k"), "j", F.col("v").alias("y"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("x") * F.col("y")).alias("v"))


def argsort(values: Column) -> Column:
    """Positions of an array's values in rising order, from 0; equal values keep their order."""
    pairs = F.transform(values, lambda v, k: F.struct(v.alias("v"), k.alias("k")))
    return F.transform(F.array_sort(pairs), lambda p: p.k)


def argmax(values: Column) -> Column:
    """Position of the first greatest value, from 0."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def item(values: Column, at: int) -> Column:
    """Python indexing: negative positions count from the end."""
    return F.element_at(values, at + 1 if at >= 0 else at)


def linear_algebra(rows: Column, rhs: Column | None = None) -> Column:
    """Determinant, inverse and solution of small square systems, one per row: ``struct<det, inverse, solution>``."""

    def run(matrices: pd.Series, right: pd.Series) -> pd.DataFrame:
        out = []
        for m, b in zip(matrices, right, strict=True):
            a = np.array([list(r) for r in m], float)
            det = float(np.linalg.det(a))
            ok = abs(det) > 1e-12
            out.append((det, np.linalg.inv(a).tolist() if ok else None, np.linalg.solve(a, np.array(list(b), float)).tolist() if ok and b is not None else None))
        return pd.DataFrame(out, columns=["det", "inverse", "solution"])

    udf = F.pandas_udf(run, "struct<det:double,inverse:array<array<double>>,solution:array<double>>")
    return udf(rows, F.lit(None).cast("array<double>") if rhs is None else rhs)


def random_matrix(spark, rows: int, columns: int, seed: int, normal: bool = False) -> DataFrame:
    """A seeded matrix of uniform or normal values."""
    cells = spark.range(rows * columns).select(F.floor(F.col("id") / columns).cast("long").alias("i"), (F.col("id") % columns).alias("j"))
    return cells.withColumn("v", F.randn(seed) if normal else F.rand(seed))


def shuffled(df: DataFrame, key: str, seed: int) -> DataFrame:
    """Rows in an order that a seed and their keys decide; equal keys stay together."""
    return df.orderBy(F.xxhash64(F.lit(seed), F.col(key)), key)


def choice(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows without repetition, drawn by the hash of their keys; fewer where there are fewer."""
    return shuffled(df, key, seed).limit(n)


def batches(df: DataFrame, key: str, size: int, seed: int) -> DataFrame:
    """``df`` with ``batch``: about ``size`` rows each, dealt by the hash of their keys, so that no order is computed."""
    n = df.agg(F.greatest(F.ceil(F.count("*") / size), F.lit(1)).alias("n"))  # one row
    return df.join(F.broadcast(n)).withColumn("batch", F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.col("n"))).drop("n")


def positions(df: DataFrame, values: str, name: str = "position") -> DataFrame:
    """Rows of an array column as rows of their own, with the position of each element from 0."""
    rest = [c for c in df.columns if c != values]
    return df.select(*rest, F.posexplode(values).alias(name, values))
