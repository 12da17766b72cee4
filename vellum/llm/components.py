"""Connected components of link tables by alternating large-star and small-star steps.

Each step is two joins and a distinct over the links, whose result is written to shared storage; nothing but a count
and a checksum comes to the driver. Minima are combined before the shuffle and joins have one row per node on one side,
so a node with most of the links costs no more than its share of the rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.llm import common


def _star(links: DataFrame, large: bool) -> DataFrame:
    """``links``: ``u > v``. Large star hangs every larger neighbour of a node on the node's least neighbour or itself;
    small star hangs the smaller neighbours, and the node, on the least of them."""
    if large:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        out = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        least = links.groupBy("u").agg(F.min("v").alias("m"))
        moved = links.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        out = moved.unionByName(least.withColumnRenamed("m", "v"))
    return out.distinct()


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """``node, component`` (both long) of every node of a link that is not its component's least node.

    Nulls and links of a node to itself say nothing. Repeated links count once.
    """
    spark = links.sparkSession
    path = common.workdir(spark, "components")
    now = links.where(f"`{a}` <> `{b}`").select(F.greatest(a, b).cast("long").alias("u"), F.least(a, b).cast("long").alias("v")).distinct()
    step, mark = 0, None
    now = common.table(now, f"{path}/0")
    while True:
        after = common.table(_star(common.table(_star(now, True), f"{path}/{step}-large"), False), f"{path}/{step + 1}")
        found = tuple(after.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        common.remove(spark, f"{path}/{step}", f"{path}/{step}-large")
        now, step = after, step + 1
        if found == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component"))
        mark = found


def stars(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links ``(i, j)`` among ``n`` things, as ``(thing, least thing of its component)`` of those that are not the least."""
    least = np.arange(n)
    while True:
        m = np.minimum(least[i], least[j])
        after = least.copy()
        np.minimum.at(after, i, m)
        np.minimum.at(after, j, m)
        after = after[after]
        if (after == least).all():
            other = np.flatnonzero(least != np.arange(n))
            return other, least[other]
        least = after
