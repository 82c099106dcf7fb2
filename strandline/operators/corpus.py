"""Corpus building: attrition, first-wins dedup, novelty, splits, weights, standardisation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import is_finite, reliability_weight

BUCKETS = ("n_parse_failed", "n_wrong_termini", "n_encode_failed", "n_too_long", "n_duplicate", "n_kept")


def keep_first(df: DataFrame, key: list[str], order: str) -> DataFrame:
    """Rows that are the first of their key in the given order. The group limit runs before the
    shuffle too, so a hot key sends one row from each task."""
    w = Window.partitionBy(*key).orderBy(order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def attrition(df: DataFrame, order: str, checks: list[tuple[str, Column]], key: str) -> DataFrame:
    """df with ``bucket``: the first check that a row fails, in the given order; ``n_duplicate`` for a
    survivor of all checks whose key an earlier survivor has; else ``n_kept``.

    The earliest survivor of each key is a map-side-combined minimum, joined back, so a hot key is
    never gathered."""
    failed = F.coalesce(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in checks])
    marked = df.withColumn("__failed", failed)
    first = marked.where("__failed IS NULL").groupBy(F.col(key).alias("__key")).agg(F.min(order).alias("__first"))
    joined = marked.join(first, F.col(key) == F.col("__key"), "left")
    bucket = F.when(F.col("__failed").isNotNull(), F.col("__failed")).when(F.col(order) > F.col("__first"), F.lit("n_duplicate")).otherwise("n_kept")
    return joined.withColumn("bucket", bucket).drop("__failed", "__key", "__first")


def attrition_stats(bucketed: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts of each bucket and of all rows."""
    counts = [F.count_if(F.col("bucket") == b).alias(b) for b in BUCKETS]
    return bucketed.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n_input"), *counts)


def member_flag(candidates: DataFrame, reference: DataFrame, key: str, flag: str = "is_member") -> DataFrame:
    """candidates with a flag whether their key is in the reference. Null keys never are."""
    known = reference.select(F.col(key).alias("__k")).where("__k IS NOT NULL").distinct().withColumn("__hit", F.lit(True))
    return candidates.join(known, F.col(key) == F.col("__k"), "left").withColumn(flag, F.coalesce("__hit", F.lit(False))).drop("__k", "__hit")


def novel(candidates: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """Candidates whose key the reference lacks."""
    return candidates.join(reference.select(F.col(key).alias("__k")).distinct(), F.col(key) == F.col("__k"), "left_anti")


def containing(candidates: DataFrame, phrases: DataFrame, text: str, phrase: str, most_phrases: int = 100_000, most_bytes: int = 32 << 20) -> DataFrame:
    """Candidates whose text contains one of the phrases. Up to ``most_phrases`` of ``most_bytes`` together
    go to every task as an Aho-Corasick automaton, which reads each text once whatever their number; more
    are joined by a theta join, whose side Catalyst chooses."""
    known = phrases.select(phrase).where(F.col(phrase).isNotNull()).distinct()
    n, size = known.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length(phrase)), F.lit(0))).first()
    if n <= most_phrases and size <= most_bytes:
        return candidates.where(contains_any([r[0] for r in known.collect()])(F.col(text)))
    return candidates.join(phrases.select(F.col(phrase).alias("__p")), F.col(text).contains(F.col("__p")), "left_semi")


def contains_any(words: list[str]):
    """A pandas UDF: whether a text contains one of the words; null texts do not."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for w in words:
        if w:
            found.add_word(w, 1)
    if len(found):
        found.make_automaton()
    every = "" in words

    @F.pandas_udf(T.BooleanType())
    def test(v: pd.Series) -> pd.Series:
        return v.map(lambda s: isinstance(s, str) and (every or (len(found) > 0 and next(found.iter(s), None) is not None))).astype("bool")

    return test


def split_rank(df: DataFrame, key: str, seed: int | str, by: list[str] | None = None) -> DataFrame:
    """df with ``rank`` from 1 in the order of the MD5 of seed and key. Without ``by`` ranks come
    from range-partitioned counts, so no task holds all rows."""
    hashed = df.withColumn("__h", F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))))
    if by:
        return hashed.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy("__h", key)).cast("long")).drop("__h")
    return global_rank(hashed, ["__h", key], "rank").drop("__h")


def global_rank(df: DataFrame, order: list[str], name: str, digits: int = 3) -> DataFrame:
    """Row number from 1 in a global order whose first column is a hex string: rows are numbered
    within buckets of the leading hex digits; the buckets' counts, 16 ** digits rows at most, are
    summed up in one small window and joined back. Raise digits for more parallel buckets."""
    cut = df.withColumn("__lead", F.substring(F.col(order[0]), 1, digits))
    sizes = cut.groupBy(F.col("__lead").alias("__l")).agg(F.count(F.lit(1)).alias("__c"))
    earlier = Window.orderBy("__l").rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.select("__l", F.coalesce(F.sum("__c").over(earlier), F.lit(0)).alias("__before"))
    local = cut.withColumn("__n", F.row_number().over(Window.partitionBy("__lead").orderBy(*order)))
    return local.join(F.broadcast(before), F.col("__lead") == F.col("__l")).withColumn(name, (F.col("__before") + F.col("__n")).cast("long")).drop("__lead", "__l", "__n", "__before")


def random_split(df: DataFrame, key: str, fractions: dict[str, float], seed: int | str) -> DataFrame:
    """df with ``part``: an exact split by rank, cut at the half-even rounded cumulative fractions."""
    if not fractions or min(fractions.values()) < 0 or abs(sum(fractions.values()) - 1) > 1e-6:
        raise ValueError("fractions must be given, none negative, with sum 1")
    ranked = split_rank(df, key, seed)
    n = df.agg(F.count(F.lit(1)).cast("double").alias("__n"))
    part, upto = None, 0.0
    names = list(fractions)
    for name in names[:-1]:
        upto += fractions[name]
        inside = F.col("rank") <= F.bround(F.lit(upto) * F.col("__n"), 0)
        part = F.when(inside, name) if part is None else part.when(inside, name)
    part = F.lit(names[0]) if part is None else part.otherwise(names[-1])
    return ranked.crossJoin(F.broadcast(n)).withColumn("part", part).drop("__n")


def kfold_splits(df: DataFrame, key: str, k: int, test: float, seed: int) -> DataFrame:
    """k independent splits (seed, seed + 1, ...): key, split_no, part."""
    out = None
    for i in range(k):
        one = random_split(df.select(key), key, {"train": 1 - test, "test": test}, seed + i).select(key, F.lit(i).cast("long").alias("split_no"), "part")
        out = one if out is None else out.unionByName(one)
    return out


def guarded_drop(df: DataFrame, part: str, flagged: Column) -> DataFrame:
    """Drops flagged rows from train and val; the test part is left whole. Null flags are kept."""
    return df.where(~(F.col(part).isin("train", "val") & F.coalesce(flagged, F.lit(False))))


def mean_one_weight(df: DataFrame, std: str, floor: float = 5.6) -> DataFrame:
    """df with ``weight``, 1 / max(std, floor) scaled to mean one."""
    raw = df.withColumn("__w", reliability_weight(F.col(std), floor))
    mean = raw.agg(F.avg("__w").alias("__m"))
    return raw.crossJoin(F.broadcast(mean)).withColumn("weight", F.col("__w") / F.col("__m")).drop("__w", "__m")


def standardise_fit(df: DataFrame, vector: str, least_std: float = 1e-8) -> DataFrame:
    """dim, mean, std (population), keep: a column with a value that is not finite, or without
    spread, is not kept."""
    long = df.select(F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    ok = F.bool_and(is_finite(F.col("x")))
    return long.groupBy("dim").agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), ok.alias("finite")).select(F.col("dim").cast("long").alias("dim"), "mean", "std", (F.col("finite") & (F.col("std") > least_std)).alias("keep"))


def standardise_apply(df: DataFrame, key: str, vector: str, fitted: DataFrame, inverse: bool = False) -> DataFrame:
    """key, dim, z over the kept columns."""
    long = df.select(key, F.posexplode(vector).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    use = fitted.where("keep").select(F.col("dim").alias("__d"), "mean", "std")
    z = F.col("x") * F.col("std") + F.col("mean") if inverse else (F.col("x") - F.col("mean")) / F.col("std")
    return long.join(use, F.col("dim") == F.col("__d")).select(key, F.col("dim").cast("long").alias("dim"), z.alias("z"))
