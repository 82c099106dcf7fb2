"""Exact dedup by content sort, in DataFrame operations only.

Rows are range-partitioned by (leading characters, 64-bit content hash, slice) with splitters that
Spark samples, sorted externally by the same keys and then the whole text, so equal texts stand next
to each other; the window below compares each row's whole text with its neighbour's and hands every
run its first identifier and length. Only splitter keys, never texts, reach the driver.

A text with more copies than ``rows_a_slice`` would be one long run in one task. Such texts are found
by a map-side-combined count of content hashes (at most rows / rows_a_slice of them can exist), dealt
over several slices by a hash of the identifier, and their totals, one row for each such text, are
joined back by broadcast; the bound above is the proof of that table's size.

Defined results: null text counts as empty; null identifiers sort after all others and are kept only
where a text has no other; of rows that agree in text and identifier exactly one is kept; a text of any
length is one row of the sort, compared whole; empty tables give empty results; other columns are
ignored by ``exact_groups`` and carried by ``exact_distinct``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import filled, materialise, partitions

#: Characters of the text that lead the sort key. Splitters are made of them; comparisons are not.
LEADING = 16


def _sorted_runs(docs: DataFrame, id_col: str, text_col: str, keep: str, normalise, rows_a_slice: int | None) -> tuple[DataFrame, Column]:
    """doc (docs' columns), first (identifier that stays), size, rn (1 on the row that stays); and the
    text that was compared, as a column of these."""
    if keep not in ("largest", "smallest"):
        raise ValueError(f"keep must be 'largest' or 'smallest', not {keep!r}")
    ident, text = F.col("doc")[id_col], filled(F.col("doc")[text_col])
    text = normalise(text) if normalise else text
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc")).select("doc", F.substring(text, 1, LEADING).alias("lead"), F.xxhash64(text).alias("hash"))
    n = partitions(docs.sparkSession)
    per = rows_a_slice or max(128, -(-docs.count() // n))
    best = F.max if keep == "largest" else F.min
    order = ident.desc_nulls_last() if keep == "largest" else ident.asc_nulls_last()

    hot = materialise(rows.groupBy("hash").agg(F.count("*").alias("copies")).where(F.col("copies") > per), "exact-hot")
    crowded = not hot.isEmpty()
    if crowded:
        rows = rows.join(F.broadcast(hot), "hash", "left")
        slices = F.ceil(F.col("copies") / F.lit(per)).cast("long")
        rows = rows.withColumn("slice", F.when(F.col("copies").isNull(), F.lit(0)).otherwise(F.pmod(F.xxhash64(F.lit("slice"), ident), slices)))
    # a constant slice would be folded out of one of the two and cost a second exchange
    dealt = ["lead", "hash", "slice"] if crowded else ["lead", "hash"]

    run = Window.partitionBy(*dealt, text).orderBy(order)
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = (
        rows.repartitionByRange(*dealt)
        .withColumn("first", F.first(ident).over(whole))
        .withColumn("size", F.count(F.lit(1)).over(whole))
        .withColumn("rn", F.row_number().over(run))
    )
    if crowded:
        totals = (
            rows.where(F.col("copies").isNotNull())
            .groupBy(F.col("hash").alias("h"), F.sha2(text, 256).alias("sha"))
            .agg(best(ident).alias("all_first"), F.count(F.lit(1)).alias("all_size"))
        )
        totals = materialise(totals, "exact-totals")
        runs = runs.join(F.broadcast(totals), (F.col("hash") == F.col("h")) & F.col("copies").isNotNull() & (F.sha2(text, 256) == F.col("sha")), "left")
        runs = (
            runs.withColumn("rn", F.when(F.col("sha").isNotNull() & ~ident.eqNullSafe(F.col("all_first")), F.lit(2)).otherwise(F.col("rn")))
            .withColumn("first", F.when(F.col("sha").isNotNull(), F.col("all_first")).otherwise(F.col("first")))
            .withColumn("size", F.coalesce("all_size", "size"))
        )
    return runs, text


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise=None, rows_a_slice: int | None = None) -> DataFrame:
    """One row for each row of docs: id_col, keep_id, group_size, kept, text_sha256.

    normalise: a function of the text column that returns the column to compare (default: as it is).
    keep: which identifier of equal texts stays, 'smallest' or 'largest'."""
    runs, text = _sorted_runs(docs.select(id_col, text_col), id_col, text_col, keep, normalise, rows_a_slice)
    return runs.select(
        F.col("doc")[id_col].alias(id_col),
        F.col("first").alias("keep_id"),
        F.col("size").cast("long").alias("group_size"),
        (F.col("rn") == 1).alias("kept"),
        F.sha2(text, 256).alias("text_sha256"),
    )


def exact_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest", normalise=None, rows_a_slice: int | None = None) -> DataFrame:
    """docs without the rows that a copy makes superfluous, all columns as they were."""
    runs, _ = _sorted_runs(docs, id_col, text_col, keep, normalise, rows_a_slice)
    return runs.where(F.col("rn") == 1).select("doc.*")
