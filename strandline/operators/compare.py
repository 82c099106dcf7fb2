"""Arms against a baseline: bootstrap intervals, verdicts, seeds, ablations."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import verdict
from ..functions.text import md5_unit
from .metrics import running_total  # noqa: F401  (part of this layer's interface)


def poisson_weight(unit: Column, most: int = 12) -> Column:
    """A Poisson(1) count from a uniform number, by inversion; counts beyond ``most`` have a
    probability under 1e-10."""
    p = total = 0.36787944117144233
    weight: Column = F.lit(0)
    for k in range(1, most + 1):
        weight = weight + (unit >= F.lit(total)).cast("int")
        p = p / k
        total = total + p
    return weight


def bootstrap_means(df: DataFrame, arm: list[str], key: Column, value: Column, repeats: int, seed: str) -> DataFrame:
    """arm, rep, mean: resampled means by Poisson weights that a hash of seed, repeat and row gives.
    One pass: each row is repeated for the repeats within its task, and the sums are combined
    map-side, so what is shuffled is one row for each arm, repeat and task."""
    rows = df.select(*arm, key.cast("string").alias("__k"), value.alias("__v"), F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("rep"))
    w = poisson_weight(md5_unit(F.concat(F.lit(f"{seed}:"), F.col("rep").cast("string"), F.lit(":"), F.col("__k"))))
    return rows.withColumn("__w", w).groupBy(*arm, "rep").agg((F.sum(F.col("__w") * F.col("__v")) / F.sum("__w")).alias("mean"))


def bootstrap_blocks(df: DataFrame, arm: str, key: Column, value: Column, repeats: int = 2000, seed: int = 7) -> DataFrame:
    """arm, rep, mean: what ``bootstrap_means`` gives, for thousands of repeats: the Poisson weights of a
    block of rows by all repeats are made at once in Arrow batches, of a hash of seed, row and repeat, so
    no row is multiplied. A task holds two sums for each arm and repeat."""
    import numpy as np
    import pyarrow as pa

    steps, p = [], math.exp(-1)
    for k in range(1, 13):
        steps.append((steps[-1] if steps else 0.0) + p)
        p /= k
    cuts = np.array([int(x * 2**53) for x in steps], np.uint64)

    def weights(hashes: np.ndarray) -> np.ndarray:
        x = hashes[:, None] + np.arange(1, repeats + 1, dtype=np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return np.searchsorted(cuts, (x ^ (x >> np.uint64(31))) >> np.uint64(11), side="right").astype(np.float64)

    def run(batches):
        sums: dict = {}
        for batch in batches:
            arms, hashes, values = batch.column(0).to_pylist(), batch.column(1).to_numpy().view(np.uint64), batch.column(2).to_numpy()
            of = np.array([hash(a) for a in arms])
            for a in dict.fromkeys(arms):
                at = np.flatnonzero(of == hash(a))
                mine = sums.setdefault(a, np.zeros((2, repeats)))
                for k in range(0, len(at), 512):
                    w = weights(hashes[at[k : k + 512]])
                    mine += np.stack([w.sum(0), values[at[k : k + 512]] @ w])
        for a, (w, wv) in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([a] * repeats, pa.string()), pa.array(np.arange(repeats), pa.int32()), pa.array(w), pa.array(wv)], ["arm", "rep", "w", "wv"])

    rows = df.select(F.col(arm).cast("string"), F.xxhash64(F.lit(seed), key), value.cast("double").alias("v")).where("v IS NOT NULL")
    sums = rows.mapInArrow(run, "arm string, rep int, w double, wv double")
    return sums.groupBy(F.col("arm").alias(arm), "rep").agg((F.sum("wv") / F.sum("w")).alias("mean"))


def bootstrap_delta(means: DataFrame, observed: DataFrame, arm: str, baseline: str, level: float = 0.95) -> DataFrame:
    """arm, delta, low, high against the baseline arm: percentiles of the resampled differences.
    means: arm, rep, mean. observed: arm, mean."""
    base = means.where(F.col(arm) == baseline).select(F.col("rep").alias("__r"), F.col("mean").alias("__b"))
    diff = means.where(F.col(arm) != baseline).join(F.broadcast(base), F.col("rep") == F.col("__r")).withColumn("__d", F.col("mean") - F.col("__b"))
    tail = (1 - level) / 2
    ci = diff.groupBy(arm).agg(F.percentile("__d", F.lit(tail)).alias("low"), F.percentile("__d", F.lit(1 - tail)).alias("high"))
    b = observed.where(F.col(arm) == baseline).select(F.col("mean").alias("__b"))
    delta = observed.where(F.col(arm) != baseline).crossJoin(F.broadcast(b)).select(arm, (F.col("mean") - F.col("__b")).alias("delta"))
    return delta.join(ci, arm)


def success(deltas: DataFrame, margin: float, same_sampling: Column | None = None) -> DataFrame:
    """deltas with ``beats``."""
    return deltas.withColumn("beats", verdict(F.col("delta"), F.lit(margin), F.col("low"), F.lit(True) if same_sampling is None else same_sampling))


def seed_aggregate(rows: DataFrame, arm: str, seed: str, metric: str) -> DataFrame:
    """arm, n_seeds, mean, std (sample; null for one seed), seeds (ascending, joined by commas)."""
    seeds = F.array_join(F.transform(F.sort_array(F.collect_set(seed)), lambda s: s.cast("string")), ",")
    return rows.groupBy(arm).agg(F.count(metric).alias("n_seeds"), F.avg(metric).alias("mean"), F.stddev_samp(metric).alias("std"), seeds.alias("seeds"))


def across_seeds(rows: DataFrame, arm: str, delta: str, margin: float) -> DataFrame:
    """arm, mean_beats, unanimous (null as soon as a seed is unmeasured), combined (null first)."""
    g = rows.groupBy(arm).agg(F.avg(delta).alias("m"), F.min(delta).alias("least"), F.count(delta).alias("k"), F.count(F.lit(1)).alias("n"))
    known = F.col("k") == F.col("n")
    mean_beats, unanimous = F.when(F.col("k") > 0, F.col("m") >= margin), F.when(known, F.col("least") >= margin)
    return g.select(arm, mean_beats.alias("mean_beats"), unanimous.alias("unanimous"), F.when(mean_beats.isNotNull() & unanimous.isNotNull(), mean_beats & unanimous).alias("combined"))


def unanimous(rows: DataFrame, arm: str, delta: str, margin: float) -> DataFrame:
    """arm, unanimous: whether every measured delta reaches the margin; null without a measured one."""
    return rows.groupBy(arm).agg(F.bool_and(F.when(F.col(delta).isNotNull(), F.col(delta) >= margin)).alias("unanimous"))


def ablation(means: DataFrame, arm: str, value: str, base_mean: float, base_std: float) -> DataFrame:
    """delta and verdict: helps below mean - std (errors: less is better), hurts above mean + std."""
    if base_std <= 0:
        raise ValueError("the baseline's std must be positive")
    v = F.col(value)
    said = F.when(v.isNull(), "not run").when(v < base_mean - base_std, "helps").when(v > base_mean + base_std, "hurts").otherwise("no effect")
    return means.select(arm, v.alias("mean"), (v - F.lit(base_mean)).alias("delta"), said.alias("verdict"))


def regression_check(delta: Column, tolerance: float) -> Column:
    return F.when(delta.isNull(), "not measured").when(delta < -tolerance, "regressed").when(delta > tolerance, "improved").otherwise("no regression")
