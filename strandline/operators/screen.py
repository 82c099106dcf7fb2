"""The screening cascade: nested stages SV, TSD, DD, PV, and its counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numbers import safe_ratio
from .corpus import member_flag

STAGES = ("sv", "tsd", "dd", "pv")


def cascade(candidates: DataFrame, order: str, key: str, parses: Column, structure: Column, reference: DataFrame | None = None) -> DataFrame:
    """candidates with passed_sv, passed_tsd, passed_dd, passed_pv and failure_stage.

    SV: the candidate parses. TSD: its key is not in the reference (without one, all pass). DD: it is
    the first of its key among TSD's survivors. PV: the structural rule. Each stage sees only the
    survivors of the one before, so a candidate is charged to the first stage it fails."""
    rows = candidates.withColumn("__sv", F.coalesce(parses, F.lit(False)) & F.col(key).isNotNull())
    if reference is None:
        rows = rows.withColumn("__known", F.lit(False))
    else:
        rows = member_flag(rows, reference, key, "__known")
    rows = rows.withColumn("passed_sv", F.col("__sv")).withColumn("passed_tsd", F.col("__sv") & ~F.col("__known"))
    first = rows.where("passed_tsd").groupBy(F.col(key).alias("__k")).agg(F.min(order).alias("__first"))
    rows = rows.join(first, F.col(key) == F.col("__k"), "left")
    rows = rows.withColumn("passed_dd", F.col("passed_tsd") & (F.col(order) == F.col("__first")))
    rows = rows.withColumn("passed_dd", F.coalesce("passed_dd", F.lit(False)))
    rows = rows.withColumn("passed_pv", F.col("passed_dd") & F.coalesce(structure, F.lit(False)))
    stage = F.when(~F.col("passed_sv"), "SV").when(~F.col("passed_tsd"), "TSD").when(~F.col("passed_dd"), "DD").when(~F.col("passed_pv"), "PV")
    return rows.withColumn("failure_stage", stage).drop("__sv", "__known", "__k", "__first")


def cascade_counts(screened: DataFrame, by: list[str] | None = None) -> DataFrame:
    """n_input, the survivors of each stage, and their rates, all over n_input."""
    counts = [F.count_if(F.col(f"passed_{s}")).alias(f"n_{s}") for s in STAGES]
    out = screened.groupBy(*(by or [])).agg(F.count(F.lit(1)).alias("n_input"), *counts)
    return out.select(*(by or []), "n_input", *[f"n_{s}" for s in STAGES], *[F.round(safe_ratio(F.col(f"n_{s}"), F.col("n_input")), 6).alias(f"{s}_rate") for s in STAGES])
