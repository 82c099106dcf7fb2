"""Groups of candidates, sampling masks and losses, as windows and two-level aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def group_advantage(df: DataFrame, group: list[str], reward: str, eps: float = 1e-8) -> DataFrame:
    """df with ``advantage``: (reward - mean) / (population std + eps) within the group. Moments are
    combined map-side and joined back, so a large group is not gathered."""
    stats = df.groupBy(*group).agg(F.avg(reward).alias("__m"), F.stddev_pop(reward).alias("__s"))
    return df.join(stats, group).withColumn("advantage", (F.col(reward) - F.col("__m")) / (F.col("__s") + F.lit(eps))).drop("__m", "__s")


def group_stats(df: DataFrame, group: list[str], reward: str, flat: float = 1e-12) -> DataFrame:
    """Each group's size, mean, std and whether it has no spread."""
    s = F.stddev_pop(reward)
    return df.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg(reward).alias("mean"), s.alias("std"), (s <= flat).alias("is_flat"))


def softmax(df: DataFrame, row: list[str], logit: str) -> DataFrame:
    """df with ``p``, stable by the row's maximum."""
    w = Window.partitionBy(*row)
    e = F.exp(F.col(logit) - F.max(logit).over(w))
    return df.withColumn("__e", e).withColumn("p", F.col("__e") / F.sum("__e").over(w)).drop("__e")


def top_p_mask(df: DataFrame, row: list[str], token: str, logit: str, top_p: float, least: int = 1) -> DataFrame:
    """df with ``kept``: a token is dropped where the probability of those before it, in descending
    order, already exceeds top_p; the first ``least`` always stay."""
    p = softmax(df, row, logit)
    order = Window.partitionBy(*row).orderBy(F.desc("p"), token)
    before = F.coalesce(F.sum("p").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    return p.withColumn("before", before).withColumn("kept", (F.col("before") <= top_p) | (F.row_number().over(order) <= least))


def top_k_mask(df: DataFrame, row: list[str], logit: str, k: int) -> DataFrame:
    """df with ``kept``: logits at least as large as the k-th; ties stay."""
    return df.withColumn("kept", F.rank().over(Window.partitionBy(*row).orderBy(F.desc(logit))) <= k)


def temperature(df: DataFrame, row: list[str], token: str, logit: str, t: float) -> DataFrame:
    """df with ``scaled``: logits over t; for t <= 0 zero for the first maximum, -inf for the rest."""
    if t > 0:
        return df.withColumn("scaled", F.col(logit) / F.lit(t))
    best = F.row_number().over(Window.partitionBy(*row).orderBy(F.desc(logit), token)) == 1
    return df.withColumn("scaled", F.when(best, F.lit(0.0)).otherwise(F.lit(float("-inf"))))


def mean_pool(df: DataFrame, group: list[str], vector: str, mask: Column) -> DataFrame:
    """Masked mean of vectors by dimension: sum(h m) / max(sum(m), 1)."""
    long = df.select(*group, mask.cast("double").alias("__m"), F.posexplode(vector).alias("dim", "x"))
    return long.groupBy(*group, "dim").agg((F.sum(F.col("x").cast("double") * F.col("__m")) / F.greatest(F.sum("__m"), F.lit(1.0))).alias("value"))


def clipped_loss(tokens: DataFrame, sequence: list[str], ratio: Column, advantage: Column, kl: Column, eps: float = 0.2, kl_coef: float = 0.05) -> DataFrame:
    """Mean over sequences of the length-normalised token loss, mean KL, share of clipped tokens."""
    from ..functions.numbers import clipped_surrogate

    rows = tokens.select(*sequence, clipped_surrogate(ratio, advantage, eps).alias("l"), kl.alias("k"), (F.abs(ratio - F.lit(1.0)) > eps).alias("c"))
    per = rows.groupBy(*sequence).agg(F.avg(F.col("l") + F.lit(kl_coef) * F.col("k")).alias("loss"), F.avg("k").alias("kl"), F.count_if("c").alias("c"), F.count(F.lit(1)).alias("n"))
    return per.agg(F.avg("loss").alias("loss"), F.avg("kl").alias("kl"), (F.sum("c") / F.sum("n")).alias("clip_fraction"))
