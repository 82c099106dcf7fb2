"""Joins by time and range, without cross joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def asof_join(left: DataFrame, right: DataFrame, by: str, time: str, value: str, name: str) -> DataFrame:
    """left with the latest earlier-or-equal value of right within by: both sides are put together and
    the value is carried forward in time order, so no pair is ever made."""
    columns = left.columns
    a = left.withColumn("__v", F.lit(None).cast(right.schema[value].dataType)).withColumn("__side", F.lit(1))
    b = right.select(by, time, F.col(value).alias("__v"), F.lit(0).alias("__side"))
    w = Window.partitionBy(by).orderBy(time, "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = a.unionByName(b, allowMissingColumns=True).withColumn(name, F.last("__v", ignorenulls=True).over(w))
    return both.where("__side = 1").select(*columns, name)


def interval_join(points: DataFrame, spans: DataFrame, at: Column, begin: Column, end: Column, width: int) -> DataFrame:
    """points joined to the spans that hold them (begin <= at < end). Both are dealt by buckets of
    ``width``, a span to each bucket it touches, so the range test runs within buckets."""
    p = points.withColumn("__b", F.floor(at / width))
    s = spans.withColumn("__b", F.explode(F.sequence(F.floor(begin / width), F.floor((end - 1) / width))))
    return p.join(s, "__b").where((at >= begin) & (at < end)).drop("__b")
