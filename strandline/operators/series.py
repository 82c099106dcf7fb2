"""Logs in time order: rates, gaps, stalls, newest rows. Keys are users or runs, whose logs a task
can hold; across all keys everything is aggregated map-side first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def seconds(later: Column, earlier: Column) -> Column:
    """Difference of two timestamps in seconds."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return (micros(later) - micros(earlier)) / F.lit(1e6)


def step_rate(df: DataFrame, key: str, time: str, step: str) -> DataFrame:
    """df with ``rate``: steps a second since the row before, null for the first or no time."""
    w = Window.partitionBy(key).orderBy(time, step)
    dt = seconds(F.col(time), F.lag(time).over(w))
    return df.withColumn("rate", F.when(dt > 0, (F.col(step) - F.lag(step).over(w)) / dt))


def recent_rate(df: DataFrame, key: str, time: str, step: str, rows: int = 7) -> DataFrame:
    """key, seconds_per_step over the newest rows, null without progress."""
    w = Window.partitionBy(key).orderBy(F.desc(time), F.desc(step))
    newest = df.withColumn("__rn", F.row_number().over(w)).where(F.col("__rn") <= rows)
    g = newest.groupBy(key).agg(F.max(time).alias("t1"), F.min(time).alias("t0"), F.max_by(step, F.struct(time, step)).alias("s1"), F.min_by(step, F.struct(time, step)).alias("s0"))
    return g.select(key, F.when(F.col("s1") > F.col("s0"), seconds(F.col("t1"), F.col("t0")) / (F.col("s1") - F.col("s0"))).alias("seconds_per_step"))


def stalls(df: DataFrame, key: str, time: str, limit: float) -> DataFrame:
    """key, n_stalls (gaps longer than limit seconds), longest gap."""
    gap = seconds(F.col(time), F.lag(time).over(Window.partitionBy(key).orderBy(time)))
    return df.select(key, gap.alias("gap")).groupBy(key).agg(F.count_if(F.col("gap") > limit).alias("n_stalls"), F.max("gap").alias("longest"))


def sessions(df: DataFrame, key: str, time: str, gap: float) -> DataFrame:
    """key, session (from 1), n, begin, end: rows whose gap to the one before is not over ``gap``."""
    w = Window.partitionBy(key).orderBy(time)
    new = F.coalesce((seconds(F.col(time), F.lag(time).over(w)) >= gap).cast("int"), F.lit(1))
    numbered = df.withColumn("__new", new).withColumn("session", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(key, "session").agg(F.count(F.lit(1)).alias("n"), F.min(time).alias("begin"), F.max(time).alias("end"))


def sparkline(df: DataFrame, key: str, order: str, value: str, width: int = 16, glyphs: str = "▁▂▃▄▅▆▇█") -> DataFrame:
    """key, line: every n // width-th value, the last ``width`` of them, scaled to the glyphs."""
    w = Window.partitionBy(key)
    rows = df.withColumn("__n", F.count(F.lit(1)).over(w)).withColumn("__i", F.row_number().over(w.orderBy(order)) - 1)
    step = F.greatest(F.lit(1), F.floor(F.col("__n") / width).cast("int"))
    picked = rows.where(F.col("__i") % step == 0).withColumn("__b", F.row_number().over(w.orderBy(F.desc("__i")))).where(F.col("__b") <= width)
    low, high = F.min(value).over(w), F.max(value).over(w)
    level = F.when(high > low, F.floor((F.col(value) - low) / (high - low) * F.lit(len(glyphs) - 1))).otherwise(F.lit(0)).cast("int")
    drawn = picked.withColumn("__g", F.substring(F.lit(glyphs), level + 1, F.lit(1)))
    return drawn.groupBy(key).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("__i", "__g"))), lambda s: s["__g"]), "").alias("line"))


def rotate(df: DataFrame, key: str, newest: str, metric: str, keep: int) -> DataFrame:
    """Rows that a rotation keeps: the newest ``keep`` and the best (least metric, the first of ties)."""
    w = Window.partitionBy(key)
    by_age = F.row_number().over(w.orderBy(F.desc(newest)))
    by_metric = F.row_number().over(w.orderBy(F.col(metric).asc_nulls_last(), newest))
    ranked = df.withColumn("__a", by_age).withColumn("__m", by_metric)
    return ranked.where((F.col("__a") <= keep) | ((F.col("__m") == 1) & F.col(metric).isNotNull())).drop("__a", "__m")
