"""Shared storage, ids and small helpers of the operators in this package."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space: the separators of words.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares, named by ``spark.checkpoint.dir``. Where that is unset, the folder that the
    session was given by ``setCheckpointDir``; on one machine (``local``) a folder of our own, and else an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    current = context._jsc.sc().getCheckpointDir()
    if not base and not current.isEmpty():
        base = current.get()
    if not base:
        if not re.match(r"local(\[|$)", context.master):
            raise ValueError("spark.checkpoint.dir is not set: name a folder that all executors share")
        base = f"file://{tempfile.gettempdir()}/vellum-{context.applicationId}"
    if current.isEmpty():
        context.setCheckpointDir(base)
    return base.rstrip("/")


def workdir(spark: SparkSession, label: str) -> str:
    """A fresh folder name in shared storage. Executors and the driver see the same files there."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def remove(spark: SparkSession, *paths: str) -> None:
    """Delete folders of intermediate tables that nothing reads any more."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def table(df: DataFrame, path: str) -> DataFrame:
    """Write ``df`` as a table in shared storage and read it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    df.write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def settings(spark: SparkSession, **conf: str) -> Iterator[None]:
    """Session settings (``__`` for dots) that hold for the jobs run inside."""
    names = {k.replace("__", "."): str(v) for k, v in conf.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def n_words(text: Column) -> Column:
    """Number of words between ASCII white space; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def byte_sizes(column) -> list[int]:
    """Bytes of each value of an Arrow column of strings or binaries; 0 for null."""
    return [x or 0 for x in pc.binary_length(column).to_pylist()]


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
