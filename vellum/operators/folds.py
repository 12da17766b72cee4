"""Folds over the rows of one group, for steps whose outcome decides the next one."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Tasks for each core.
PER_CORE = 4
#: Groups that a task turns into Python objects at once.
GROUPS = 64


def late(value) -> tuple:
    """A sort key under which missing values come last."""
    return (True, 0) if value is None or value != value else (False, value)


def by_group(rows: DataFrame, keys: list[str], fold: Callable[[list[dict]], Iterable[dict]], schema: str) -> DataFrame:
    """``fold(rows)`` of every group, whose rows come in any order as plain dictionaries; it gives dictionaries with the
    columns of ``schema``. Groups travel as Arrow arrays, many in a batch. The partitions are a few for each core
    and stay apart, as folds cost far more than their bytes tell."""
    spark = rows.sparkSession
    shape = to_arrow_schema(StructType.fromDDL(schema))
    parts = min(int(spark.conf.get("spark.sql.shuffle.partitions")), PER_CORE * spark.sparkContext.defaultParallelism)
    grouped = rows.repartition(parts, *keys).groupBy(*keys).agg(F.collect_list(F.struct(*rows.columns)).alias("rows"))

    def run(batches):
        for b in batches:
            for at in range(0, b.num_rows, GROUPS):
                found = [r for group in b.slice(at, GROUPS).column(0).to_pylist() for r in fold(group)]
                if found:
                    yield pa.RecordBatch.from_pylist(found, schema=shape)

    return grouped.select("rows").mapInArrow(run, schema)


def slices(batch, sizes, most: int):
    """Cut an Arrow batch into runs of rows whose ``sizes`` sum to about ``most``; a larger row is a run of its own."""
    first = total = 0
    for k, size in enumerate(sizes):
        if total and total + size > most:
            yield batch.slice(first, k - first)
            first, total = k, 0
        total += size
    if batch.num_rows > first:
        yield batch.slice(first)
