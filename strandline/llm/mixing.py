"""Mixing sources to target weights by Poisson replication.

Each source s gets the mean repetition rate w_s * size / n_s, where n_s is its number of rows, w_s its
share of the target and size the rows wanted in all. Each document draws its number of copies from a
Poisson distribution with that mean by inverting the distribution at a uniform number that an MD5 of
seed and identifier gives, so a rerun, a retried task or another engine draws the same copies. The
copies are exploded and ordered by an MD5 of seed, identifier and copy: a global shuffle, range
partitioned over all partitions, which no source can crowd.

Counts by source stay a table, written and joined; only their number and sums reach the driver. The
mean has no bound: large ones are inverted in log space over the counts that a uniform number can draw.
``max_sources``, if given, refuses a table of more sources.

Defined results: a null source is a source of its own (empty string in ``weights``); rows with a null
identifier draw by their text, rows that agree in both alike; a source without weight gets none, and
without any weight nothing is left; the size of a text is of no account; repeated rows repeat their
draws, and copies whose order ties stand in no fixed order; empty tables stay empty; other columns are
carried along, whatever their names.
"""

from __future__ import annotations

import math

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import filled, free_names, map_rows, materialise

#: Hex digits of the MD5 that make a uniform number: 52 bits, exact in a double.
DIGITS = 13
#: So many sources, with so many thresholds in all (8 bytes each), are broadcast; beyond either the join is
#: left to Catalyst, with the same result.
BROADCAST_SOURCES, BROADCAST_THRESHOLDS = 10_000, 2_000_000


def poisson_thresholds(mean: float) -> list[float]:
    """Cumulative probabilities P(X <= 0), P(X <= 1), ... until they stop growing: a uniform number
    u draws as many as there are thresholds <= u."""
    if mean <= 0:
        return [2.0]
    if mean > 500:
        raise ValueError(f"a mean repetition of {mean} is past what the inversion can represent")
    p = total = math.exp(-mean)
    out, k = [total], 0
    while k < mean or p > 1e-18:
        k += 1
        p = p * mean / k
        total = total + p
        out.append(total)
    return out


def poisson_window(mean: float) -> tuple[int, list[float]]:
    """(k, thresholds): a uniform number u draws k and as many more as there are thresholds <= u. For
    large means k skips the counts whose probabilities together are under 1e-20."""
    if mean <= 500:
        return 0, poisson_thresholds(mean)
    start, end = max(0, math.floor(mean - 10 * math.sqrt(mean))), math.ceil(mean + 10 * math.sqrt(mean)) + 10
    out, total = [], 0.0
    for k in range(start, end):
        total += math.exp(k * math.log(mean) - mean - math.lgamma(k + 1))
        out.append(total)
    return start, [x / total for x in out]


def source_counts(docs: DataFrame, source_col: str) -> DataFrame:
    """Rows by source (s, n); the count is combined map-side, so a hot source is one row a task."""
    return docs.groupBy(filled(source_col).alias("s")).agg(F.count(F.lit(1)).alias("n"))


def mix_sources(docs: DataFrame, weights: dict[str, float] | None = None, size: int | None = None, seed: int = 0, exponent: float = 0.5, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", max_sources: int | None = None, extra: bool = True) -> DataFrame:
    """docs with each row repeated by its Poisson draw, in a global random order, and, if ``extra``, the
    columns __copy (from 0), __copies and __order (long, the order's key); a name that docs has already
    gets underscores after it.

    weights: source to share (default: counts ** exponent); size: rows wanted (default: as many as docs)."""
    if weights and min(weights.values()) < 0:
        raise ValueError("a weight is negative")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))
    names = free_names(docs.columns, ["__copy", "__copies", "__order"])
    added = [F.col(c).alias(n) for c, n in zip(["copy", "copies", "order"], names, strict=True)] if extra else []
    counts = materialise(source_counts(docs, source_col), "mixing-counts")
    sources, n, z = counts.agg(F.count(F.lit(1)), F.sum("n"), F.sum(F.pow("n", F.lit(float(exponent))))).first()
    if max_sources is not None and sources > max_sources:
        raise ValueError(f"more than {max_sources} sources: give a coarser source column")
    total = z if weights is None else math.fsum(weights.values()) or 1.0
    size = n if size is None else size

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            names, ns = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            shares = [n**exponent if weights is None else weights.get(s, 0.0) for s, n in zip(names, ns, strict=True)]
            drawn = [poisson_window(x / total * size / n) for x, n in zip(shares, ns, strict=True)]
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array([k for k, _ in drawn], pa.int64()), pa.array([t for _, t in drawn], pa.list_(pa.float64()))], ["s", "least", "thresholds"])

        return one

    tables = materialise(map_rows(counts, make, "s string, least long, thresholds array<double>"), "mixing-draws")
    few = sources <= BROADCAST_SOURCES and (tables.agg(F.sum(F.size("thresholds"))).first()[0] or 0) <= BROADCAST_THRESHOLDS
    doc = F.col("doc")
    text = filled(doc[text_col]) if text_col in docs.columns else F.to_json(doc)
    key = F.coalesce(doc[id_col].cast("string"), F.concat(F.lit("text:"), F.md5(text)))
    unit = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key)), 1, DIGITS), 16, 10).cast("double") / F.lit(float(16**DIGITS))
    order = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), key, F.lit(":"), F.col("copy").cast("string"))), 1, 15), 16, 10).cast("long")
    drawn = (
        rows.withColumn("s", filled(doc[source_col]))
        .join(F.broadcast(tables) if few else tables, "s")
        .withColumn("unit", unit)
        .withColumn("copies", F.col("least") + F.size(F.filter("thresholds", lambda t: t <= F.col("unit"))).cast("long"))
        .where("copies > 0")
        .withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
        .withColumn("order", order)
        .select("doc", "copy", "copies", "order")
    )
    return drawn.repartitionByRange("order").sortWithinPartitions("order").select("doc.*", *added)
