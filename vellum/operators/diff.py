"""Comparing two snapshots of records by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

# Metadata that changes from run to run and is not compared.
VOLATILE = ["source", "package_root", "pipeline_version", "code_fingerprint"]
EXAMPLES = 20


def fingerprint(df: DataFrame, key: str) -> Column:
    """SHA-256 of a record's JSON without its volatile metadata (a struct or a map column ``metadata``)."""
    columns = []
    for f in df.schema:
        c = F.col(f.name)
        if f.name == "metadata" and f.dataType.typeName() == "struct":
            kept = [x.name for x in f.dataType if x.name not in VOLATILE]
            c = F.struct(*[F.col(f"metadata.{x}").alias(x) for x in kept]).alias("metadata") if kept else F.lit(None).alias("metadata")
        elif f.name == "metadata" and f.dataType.typeName() == "map":
            c = F.array_sort(F.map_entries(F.map_filter(c, lambda k, _: ~k.isin(*VOLATILE)))).alias("metadata")
        columns.append((f.name, c))
    return F.sha2(F.to_json(F.struct(*[c.alias(n) for n, c in sorted(columns, key=lambda x: x[0])])), 256)


def compare(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``key, status`` (added, removed, same or changed) of every id: one full outer join of ids and hashes. Of records that
    repeat an id the one with the greatest hash counts; ``repeated_ids`` tells them."""
    side = lambda df, name: df.select(F.col(key).cast("string").alias("id"), fingerprint(df, key).alias(name)).groupBy("id").agg(F.max(name).alias(name))
    both = side(old, "old").join(side(new, "new"), "id", "full_outer")
    status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") == F.col("new"), "same").otherwise("changed")
    return both.select(F.col("id").alias(key), status.alias("status"))


def repeated_ids(df: DataFrame, key: str) -> DataFrame:
    """``key, records``: ids that several records have."""
    return df.groupBy(key).agg(F.count("*").alias("records")).where("records > 1")


def summary(compared: DataFrame, key: str) -> DataFrame:
    """One row: counts, ratio of identical records, and the first ids that differ."""
    count = lambda *s: F.count_if(F.col("status").isin(*s))
    place = F.row_number().over(Window.partitionBy("status").orderBy(key))  # Spark keeps the first rows of each task only
    first = compared.where("status <> 'same'").withColumn("__r", place).where(F.col("__r") <= EXAMPLES)
    ids = lambda s: F.array_sort(F.collect_list(F.when(F.col("status") == s, F.col(key))))
    examples = first.agg(ids("added").alias("added_ids"), ids("removed").alias("removed_ids"), ids("changed").alias("changed_ids"))
    counts = compared.agg(
        count("same", "changed", "removed").alias("old_count"), count("same", "changed", "added").alias("new_count"), (count("added", "removed") == 0).alias("same_id_set"), count("same", "changed").alias("common_count"),
        count("same").alias("normalized_identical_count"), F.bround(count("same") / F.greatest(count("same", "changed"), F.lit(1)), 6).alias("normalized_identical_ratio"), (count("added", "removed", "changed") == 0).alias("behaviorally_identical"),
    )
    return counts.withColumn("__k", F.lit(1)).join(examples.withColumn("__k", F.lit(1)), "__k").drop("__k")
