"""Metrics of predictions and generations, each one aggregation unless it says otherwise."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbers import is_finite, safe_ratio
from ..sources.scratch import materialise


def regression_report(df: DataFrame, truth: Column, pred: Column, by: list[str] | None = None) -> DataFrame:
    """n_total, n_non_numeric, n_valid, mae, rmse, r2, pearson. Predictions that are no number count
    but do not enter the errors; r2 and pearson need two rows and spread."""
    rows = df.withColumn("__t", truth.cast("double")).withColumn("__p", pred)
    usable = is_finite(F.col("__t")) & is_finite(F.col("__p"))
    rows = rows.withColumn("__ok", usable).withColumn("__pt", F.when(usable, F.col("__t"))).withColumn("__pp", F.when(usable, F.col("__p")))
    e = F.col("__pp") - F.col("__pt")
    n = F.count("__pt")
    ss_tot = F.var_pop("__pt") * n
    r2 = F.when((n >= 2) & (F.var_pop("__pt") > 0), F.lit(1.0) - F.sum(e * e) / ss_tot)
    sx, sy = F.stddev_pop("__pp"), F.stddev_pop("__pt")
    r = F.when((n >= 2) & (sx > 0) & (sy > 0), F.covar_pop("__pp", "__pt") / (sx * sy))
    non_numeric = F.count_if(~is_finite(F.col("__p")))
    return rows.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_total"), non_numeric.alias("n_non_numeric"), (F.count(F.lit(1)) - non_numeric).alias("n_valid"),
        F.avg(F.abs(e)).alias("mae"), F.sqrt(F.avg(e * e)).alias("rmse"), r2.alias("r2"), r.alias("pearson"),
    )


def over_splits(reports: DataFrame, metrics: list[str], sample: bool = False) -> DataFrame:
    """metric, mean, std, n over the splits that measured it."""
    pairs = ", ".join(f"'{m}', CAST({m} AS DOUBLE)" for m in metrics)
    long = reports.selectExpr(f"stack({len(metrics)}, {pairs}) AS (metric, x)")
    std = F.stddev_samp("x") if sample else F.stddev_pop("x")
    return long.groupBy("metric").agg(F.avg("x").alias("mean"), std.alias("std"), F.count("x").alias("n"))


def conditioning_report(df: DataFrame, value: Column, target: Column, tolerances: list[float], by: list[str] | None = None) -> DataFrame:
    """Errors of values against each row's own target; rows without a number are counted first, then
    rows without a target. within_<tolerance>: share of usable rows, inclusive."""
    rows = df.withColumn("__v", value).withColumn("__t", target)
    bad = ~is_finite(F.col("__v"))
    missing = ~bad & ~is_finite(F.col("__t"))
    ok = ~bad & ~missing
    e = F.when(ok, F.col("__v") - F.col("__t"))
    ladder = sorted({t for t in tolerances if 0 < t < float("inf")})
    return rows.groupBy(*(by or [])).agg(
        F.count(F.lit(1)).alias("n_total"), F.count_if(bad).alias("n_non_numeric"), F.count_if(missing).alias("n_missing_target"), F.count_if(ok).alias("n_used"),
        F.avg(F.abs(e)).alias("mae"), F.percentile(F.abs(e), F.lit(0.5)).alias("median_abs_error"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(e).alias("bias"),
        F.min(F.when(ok, F.col("__t"))).alias("target_min"), F.max(F.when(ok, F.col("__t"))).alias("target_max"), F.avg(F.when(ok, F.col("__t"))).alias("target_mean"),
        *[safe_ratio(F.count_if(ok & (F.abs(F.col("__v") - F.col("__t")) <= t)), F.count_if(ok)).alias(f"within_{t:g}") for t in ladder],
    )


def target_rate(value: Column, target: Column, tolerance: float) -> Column:
    """Aggregate: share of finite values within the tolerance of the target, inclusive."""
    ok = is_finite(value)
    return safe_ratio(F.count_if(ok & (F.abs(value - target) <= tolerance)), F.count_if(ok))


def ensemble(members: DataFrame, key: list[str], value: Column) -> DataFrame:
    """mean, std (population) and n_contributing over the finite members; (NaN, NaN, 0) for none."""
    rows = members.withColumn("__v", F.when(is_finite(value), value))
    out = rows.groupBy(*key).agg(F.avg("__v").alias("mean"), F.stddev_pop("__v").alias("std"), F.count("__v").alias("n_contributing"))
    return out.withColumn("mean", F.coalesce("mean", F.lit(float("nan")))).withColumn("std", F.coalesce("std", F.lit(float("nan"))))


def conformal_rank(n: Column, alpha: float) -> Column:
    return F.ceil((n + F.lit(1)) * F.lit(1 - alpha) - F.lit(1e-9)).cast("long")


def conformal_quantile(residuals: DataFrame, r: str, alpha: float, by: list[str] | None = None) -> DataFrame:
    """k-th smallest residual with k = ceil((n + 1)(1 - alpha)); null where k is beyond n.

    Residuals are first counted by value, and the k-th is found by a running count over range-partitioned
    counts, in the order of group and value, so that a large group has many tasks."""
    if not 0 < alpha < 1:
        raise ValueError("alpha must lie between 0 and 1")
    keys = by or []
    counts = residuals.groupBy(*keys, r).agg(F.count(F.lit(1)).alias("__c"))
    if by:
        total = running_total(residuals.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), keys, "n", "__to").withColumn("k", conformal_rank(F.col("n"), alpha))
        upto = running_total(counts, [*keys, r], "__c", "__upto")
        found = upto.join(total, keys).where("__upto - (__to - n) >= k").groupBy(*keys).agg(F.min(r).alias("quantile"))  # without earlier groups' rows
        return total.join(found, keys, "left").select(*keys, "n", "k", "quantile")
    upto = running_total(counts, r, "__c", "__upto")
    total = upto.agg(F.coalesce(F.sum("__c"), F.lit(0)).alias("n")).withColumn("k", conformal_rank(F.col("n"), alpha))
    found = upto.crossJoin(F.broadcast(total.select("k"))).where("__upto >= k").agg(F.min(r).alias("quantile"))
    return total.crossJoin(F.broadcast(found)).select("n", "k", "quantile")


def running_total(df: DataFrame, order: str | list[str], value: str, name: str, stretches: int | None = None) -> DataFrame:
    """Running sum of value in the order of columns, without one task that holds all rows: rows are
    range-partitioned and written with their partition's number, summed up within, and the
    partitions' totals, one row each, are carried forward."""
    n = stretches or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = [order] if isinstance(order, str) else order
    cut = materialise(df.repartitionByRange(n, *order).withColumn("__s", F.spark_partition_id()), "running")
    sums = cut.groupBy("__s").agg(F.sum(value).alias("__t"))
    earlier = Window.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select(F.col("__s").alias("__z"), F.coalesce(F.sum("__t").over(earlier), F.lit(0)).alias("__before"))
    w = Window.partitionBy("__s").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    local = cut.withColumn("__in", F.sum(value).over(w))
    return local.join(F.broadcast(before), F.col("__s") == F.col("__z")).withColumn(name, F.col("__before") + F.col("__in")).drop("__s", "__z", "__in", "__before")


def nearest_rank(df: DataFrame, value: str, q: float) -> DataFrame:
    """The value at the half-even rounded index q (n - 1), from 0, of the sorted finite values."""
    ok = df.where(is_finite(F.col(value)))
    counts = ok.groupBy(value).agg(F.count(F.lit(1)).alias("__c"))
    total = ok.agg((F.bround(F.lit(q) * (F.count(F.lit(1)) - 1), 0) + 1).alias("__k"))
    upto = running_total(counts, value, "__c", "__upto").crossJoin(F.broadcast(total))
    return upto.where("__upto >= __k").agg(F.min(value).alias("value"))


def cosine(a: str, b: str) -> Column:
    """Cosine of two array columns, 0.0 where one is null or zero."""
    dot = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    norm = lambda c: F.sqrt(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    d = norm(a) * norm(b)
    return F.when(d > 0, dot / d).otherwise(F.lit(0.0))


def tanimoto(a: str, b: str) -> Column:
    """Shared over all elements of two sets, 0.0 where one is null or both are empty."""
    n = F.size(F.array_union(a, b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n).otherwise(F.lit(0.0))


def diversity(df: DataFrame, value: str, by: list[str] | None = None) -> DataFrame:
    """n_total, n_unique, unique_fraction, most_common_count, most_common_fraction, from counts by
    value that are combined map-side."""
    keys = by or []
    counts = df.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    out = counts.groupBy(*keys).agg(F.coalesce(F.sum("__c"), F.lit(0)).alias("n_total"), F.count(F.lit(1)).alias("n_unique"), F.coalesce(F.max("__c"), F.lit(0)).alias("most_common_count"))
    return out.select(*keys, "n_total", "n_unique", safe_ratio(F.col("n_unique"), F.col("n_total")).alias("unique_fraction"), "most_common_count", safe_ratio(F.col("most_common_count"), F.col("n_total")).alias("most_common_fraction"))


def nearest_of(queries: DataFrame, reference: DataFrame, key: str, vector: str, most: int = 20_000) -> DataFrame:
    """key, nearest: the best cosine of each query with any vector of the reference, of which at most
    ``most`` rows (by a hash of the key) are taken. They go to every task as one matrix, and batches of
    queries are multiplied with it; a zero vector's cosines are NaN."""
    import numpy as np
    import pyarrow as pa

    chosen = reference.orderBy(F.md5(F.concat(F.lit("sample:"), F.col(key).cast("string"))), key).limit(most).select(vector).collect()
    kind = queries.schema[key].dataType.simpleString()
    side = np.array([r[0] for r in chosen], np.float64).reshape(len(chosen), len(chosen[0][0]) if chosen else 0)
    with np.errstate(all="ignore"):
        side = (side / np.linalg.norm(side, axis=1, keepdims=True)).T

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 1024):
                part = batch.slice(k, 1024)
                rows = np.array(part.column(1).to_pylist(), np.float64)
                with np.errstate(all="ignore"):
                    best = ((rows / np.linalg.norm(rows, axis=1, keepdims=True)) @ side).max(1) if side.size else np.full(len(rows), None)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(best, pa.float64())], ["key", "nearest"])

    return queries.select(key, vector).mapInArrow(run, f"key {kind}, nearest double").withColumnRenamed("key", key)


def reference_fingerprints(df: DataFrame, text: Column, fingerprint: Callable[[Column], Column]) -> DataFrame:
    """text, bits: the distinct texts of a reference with their fingerprints; texts that have none (null)
    are left out. ``fingerprint`` is injected, for instance ``chemistry.morgan_bits()``."""
    return df.select(text.alias("text")).where("text IS NOT NULL").distinct().withColumn("bits", fingerprint(F.col("text"))).where("bits IS NOT NULL")
