"""Batches from loaders: a loader is an ordered list of batch keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import running_total


def interleave(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """step, loader, item: a's and b's batches by turns, the shorter cycled to the longer's length. Places
    come from running totals over ranges, and Catalyst chooses how the sides are joined."""

    def placed(x: DataFrame) -> DataFrame:
        return running_total(x.select(F.col(key).alias("item"), F.lit(1).alias("one")), "item", "one", "upto").select("item", (F.col("upto") - 1).cast("long").alias("i"))

    one, two = placed(a), placed(b)
    n, m = one.count(), two.count()
    steps = a.sparkSession.range(max(n, m)).withColumnRenamed("id", "step")
    pick = lambda side, name, size: steps.join(side, F.col("step") % size == F.col("i")).select("step", F.lit(name).alias("loader"), "item")
    return pick(one, "a", max(1, n)).unionByName(pick(two, "b", max(1, m))).orderBy("step", "loader")
