"""General operators on plain tables: groups, counts, buckets, first and last rows, ratios, top rows, carts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def group_rows(df: DataFrame, key: str, order: Sequence[str]) -> DataFrame:
    """A row per key with its rows as an array of structs in a fixed order. For groups that fit into a row."""
    rest = [c for c in df.columns if c != key and c not in order]
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *rest))).alias("rows"))


def count_by(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def sum_by(df: DataFrame, key: str, value: Column, name: str = "total") -> DataFrame:
    return df.groupBy(key).agg(F.sum(value).alias(name))


def avg_by(df: DataFrame, key: str, value: Column, name: str = "average") -> DataFrame:
    """Mean per key, from a sum and a count, so that partial results add up exactly for integers and decimals."""
    return df.groupBy(key).agg((F.sum(value) / F.count(value)).alias(name))


def total(df: DataFrame, value: Column, name: str = "total") -> DataFrame:
    """One row; 0 for no rows."""
    return df.agg(F.coalesce(F.sum(value), F.lit(0)).alias(name))


def mean(df: DataFrame, value: Column, name: str = "average") -> DataFrame:
    """One row; null for no rows."""
    return df.agg(F.try_divide(F.sum(value), F.count(value)).alias(name))


def having(df: DataFrame, key: str, at_least: int) -> DataFrame:
    return count_by(df, key).where(F.col("n") >= at_least)


def top(df: DataFrame, n: int, by: str, ties: str) -> DataFrame:
    """The ``n`` rows with the largest values, of equal ones those with the least tiebreak."""
    return df.orderBy(F.desc_nulls_last(by), ties).limit(n)


def most_frequent(df: DataFrame, key: str) -> DataFrame:
    """The key with most rows; of equal ones the least."""
    return count_by(df, key).orderBy(F.desc("n"), key).limit(1)


def buckets(df: DataFrame, value: Column, edges: Sequence[tuple[str, float | None]]) -> DataFrame:
    """``bucket, n`` for every named bucket, empty ones too. ``edges``: (name, least value), highest first; None: the rest."""
    name = F.lit(None).cast("string")
    for label, low in reversed(edges):
        name = F.lit(label) if low is None else F.when(value >= low, label).otherwise(name)
    names = df.sparkSession.createDataFrame([(label,) for label, _ in edges], "bucket string")
    counts = df.select(name.alias("bucket")).groupBy("bucket").agg(F.count("*").alias("n"))
    return names.join(counts, "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))


def first_per(df: DataFrame, key: str, order: str, ties: str) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(order, ties))).where("__r = 1").drop("__r")


def last_per(df: DataFrame, key: str, order: str, ties: str) -> DataFrame:
    """The row with the largest value; of equal ones that with the least tiebreak."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc(order), ties))).where("__r = 1").drop("__r")


def latest(df: DataFrame, key: str, updated: str) -> DataFrame:
    """The newest row of every key: an upsert log as a table. Of rows of one time that whose JSON sorts last counts."""
    newest = Window.partitionBy(key).orderBy(F.desc(updated), F.desc(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
    return df.withColumn("__r", F.row_number().over(newest)).where("__r = 1").drop("__r")


def sequence_per(df: DataFrame, key: str, order: Sequence[str], value: str) -> DataFrame:
    """``key, sequence``: the values of every key in order."""
    return df.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(*order, value))), lambda x: x[value]).alias("sequence"))


def conversion(df: DataFrame, user: str, done: Column) -> DataFrame:
    """One row: distinct users, those who did it, and their ratio (null for no users)."""
    users, buyers = F.countDistinct(user), F.countDistinct(F.when(done, F.col(user)))
    return df.agg(users.alias("users"), buyers.alias("converted"), F.try_divide(buyers, users).alias("rate"))


def cart(items: DataFrame, products: DataFrame, item_key: str, product_key: str, strict: bool = True) -> DataFrame:
    """Items with their product. ``strict``: an item without a product raises, else it is left out."""
    joined = items.join(products, items[item_key] == products[product_key], "left" if strict else "inner")
    return joined.where(F.coalesce(F.assert_true(products[product_key].isNotNull(), "no such product").isNull(), F.lit(True))) if strict else joined


def all_available(joined: DataFrame, quantity: str, stock: str) -> DataFrame:
    return joined.agg(F.coalesce(F.bool_and(F.col(quantity) <= F.col(stock)), F.lit(True)).alias("available"))


def split_by_position(df: DataFrame, order: str, share: float) -> tuple[DataFrame, DataFrame]:
    """The first ``share`` of the rows in the order of a column, rounded down, and the rest. Rows with the value at the
    boundary, and only they, are numbered by their JSON to fill the first part up; nulls come first."""
    df = df.withColumn("__at", F.col(order))
    n = df.count()
    wanted = int(n * share)
    if wanted in (0, n):
        whole, none = df.drop("__at"), df.drop("__at").where("false")
        return (whole, none) if wanted else (none, whole)
    nulls = df.where("__at IS NULL").count()
    at = None if wanted <= nulls else df.agg(F.expr(f"percentile_disc({(wanted - nulls) / (n - nulls)!r}) WITHIN GROUP (ORDER BY __at)")).first()[0]
    below = F.lit(False) if at is None else F.col("__at").isNull() | (F.col("__at") < F.lit(at))
    room = wanted - df.where(below).count()
    tied = F.col("__at").eqNullSafe(F.lit(at))
    place = F.row_number().over(Window.partitionBy("__at").orderBy(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))))
    ties = df.where(tied).withColumn("__r", place)
    first = df.where(below).unionByName(ties.where(F.col("__r") <= room).drop("__r"))
    rest = df.where(~below & ~tied).unionByName(ties.where(F.col("__r") > room).drop("__r"))
    return first.drop("__at"), rest.drop("__at")


def describe(df: DataFrame, *columns: str) -> DataFrame:
    """Count, mean, sample deviation, least, quartiles and greatest value of numeric columns."""
    return df.select(*columns).summary("count", "mean", "stddev", "min", "25%", "50%", "75%", "max")
