"""Scans: CSV columns and labelled pairs, wide records, text lines, JSON lines, hash indexes, splits.

Every reader is one Spark scan with a declared schema; none lists or opens files itself."""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.numbers import is_finite
from ..functions.text import parse_permissive, strip


class SchemaError(ValueError):
    """A source whose columns are not the declared ones."""


def header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.option("header", True).csv(path).columns


def csv_column(spark: SparkSession, path: str, column: str, limit: int | None = None) -> DataFrame:
    """One column of a CSV; the limit counts rows read."""
    rows = spark.read.csv(path, header=True, escape='"', multiLine=False)
    if column not in rows.columns:
        raise SchemaError(f"{path} has no column {column!r}, only {rows.columns}")
    rows = rows.select(F.col(f"`{column}`").alias("value"))
    return rows.limit(limit) if limit is not None else rows


def labelled(df: DataFrame, text: str, label: str, limit: int | None = None) -> DataFrame:
    """text, value: stripped texts that are not empty with a finite number; the limit counts pairs."""
    pairs = df.select(strip(F.col(f"`{text}`")).alias("text"), parse_permissive(F.col(f"`{label}`").cast("string")).alias("value"))
    pairs = pairs.where((F.col("text") != "") & F.col("value").isNotNull())
    return pairs.limit(limit) if limit is not None else pairs


def dropped(df: DataFrame, text: str, label: str) -> DataFrame:
    """One row: rows read, pairs kept, and why the others went."""
    s, v = strip(F.col(f"`{text}`")), parse_permissive(F.col(f"`{label}`").cast("string"))
    no_text = F.coalesce(s, F.lit("")) == ""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(no_text).alias("n_no_text"), F.count_if(~no_text & v.isNull()).alias("n_no_label"), F.count_if(~no_text & v.isNotNull()).alias("n_kept"))


def require_columns(columns: list[str], required: list[str], groups: dict[str, int]) -> dict[str, list[str]]:
    """Columns of each prefix group; raises unless all required columns are there and each group has
    exactly its number of columns."""
    missing = [c for c in required if c not in columns]
    found = {p: [c for c in columns if c.startswith(p)] for p in groups}
    wrong = {p: len(found[p]) for p in groups if len(found[p]) != groups[p]}
    if missing or wrong:
        raise SchemaError(f"missing columns {missing}; group sizes {wrong}, wanted {groups}; prefixes seen {dict(Counter(re.split(r'[.]', c)[0] for c in columns))}")
    return found


def number_or(c: Column, default: float) -> Column:
    v = parse_permissive(c.cast("string"))
    return F.coalesce(v, F.lit(default))


def wide_records(df: DataFrame, text: str, label: str, std: str, count: str, reliability: str, kind: str, descriptors: list[str]) -> DataFrame:
    """Typed records: a bad descriptor is NaN, a bad std 0, a bad count 1; reliability in lower case."""
    c = lambda n: F.col(f"`{n}`")
    out = df.select(
        strip(c(text)).alias("text"), parse_permissive(c(label).cast("string")).alias("value"), number_or(c(std), 0.0).alias("std"),
        number_or(c(count), 1.0).cast("long").alias("num_of_points"), F.lower(strip(c(reliability))).alias("reliability"), c(kind).alias("kind"),
        F.array(*[number_or(c(d), float("nan")) for d in descriptors]).alias("descriptors"),
    )
    return out.where((F.col("text") != "") & F.col("value").isNotNull())


def text_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Lines that are not blank, stripped."""
    return spark.read.text(path).select(strip(F.col("value")).alias("value")).where("value <> ''")


def text_files(spark: SparkSession, paths: list[str], skip: int = 0, limit: int | None = None) -> DataFrame:
    """file_no, line_no, value of several files in the given order. ``skip`` and ``limit`` count raw
    lines over all files; blank lines count but are not returned. Lines are numbered within files by
    their order in the splits, and files by counts that only the number of files bounds."""
    frames = None
    for k, p in enumerate(paths):
        one = spark.read.text(p).select(F.lit(k).alias("file_no"), F.monotonically_increasing_id().alias("at"), "value")
        frames = one if frames is None else frames.unionByName(one)
    if skip or limit is not None:
        ordered = frames.orderBy("file_no", "at")
        frames = ordered.offset(skip) if skip else ordered
        frames = frames.limit(limit) if limit is not None else frames
    return frames.select("file_no", F.col("at").alias("line_no"), strip(F.col("value")).alias("value")).where("value <> ''")


def json_records(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Objects of a JSON-lines file; malformed lines and lines that are no objects are skipped."""
    return spark.read.schema(schema).json(path, mode="DROPMALFORMED")


def json_field(df: DataFrame, column: str, field: str) -> DataFrame:
    """df with ``value``, a string field of JSON text; rows without it, or where it is blank or no
    string, are left out."""
    v = F.from_json(F.col(column), f"`{field}` STRING", {"mode": "PERMISSIVE"})[field]
    quoted = F.get_json_object(column, f"$.{field}")
    return df.withColumn("value", F.when(quoted.isNotNull(), strip(v))).where("value <> ''")


def probe(df: DataFrame, column: str, fields: list[str], pattern: str) -> Column:
    """The first of several JSON fields whose value matches a pattern."""
    values = [F.get_json_object(column, f"$.{f}") for f in fields]
    return F.coalesce(*[F.when(v.rlike(pattern), v) for v in values])


def nonempty(df: DataFrame, what: str) -> DataFrame:
    """df, or an error where it has no rows."""
    if df.isEmpty():
        raise ValueError(f"{what} has no usable rows")
    return df


def hash_index(spark: SparkSession, path: str) -> DataFrame:
    """An index that ``sinks.write_hash_index`` wrote; its row count must equal its metadata's."""
    rows, meta = spark.read.parquet(f"{path}/hashes"), spark.read.json(f"{path}/metadata").first()
    n = rows.count()
    if n != meta["n_entries"]:
        raise SchemaError(f"{path} holds {n} hashes, its metadata says {meta['n_entries']}")
    return rows


def index_space(spark: SparkSession, path: str, wanted: str | None = None) -> str:
    """The space an index's hashes live in; a contradicting wish, or none known, raises."""
    said = spark.read.json(f"{path}/metadata").first().asDict().get("hash_space")
    if said and wanted and said != wanted:
        raise SchemaError(f"{path} holds {said} hashes, {wanted} was asked for")
    if not (said or wanted):
        raise SchemaError(f"{path} does not say what its hashes are of")
    return said or wanted


def check_frozen_splits(splits: DataFrame, n: int) -> None:
    """splits(split_no, row_id, part): parts are disjoint and cover 0 .. n - 1, else an error."""
    twice = splits.groupBy("split_no", "row_id").agg(F.count_distinct("part").alias("k")).where("k > 1")
    if not twice.isEmpty():
        raise SchemaError("rows stand in two parts of a split")
    sizes = splits.groupBy("split_no").agg(F.count_distinct("row_id").alias("n"), F.min("row_id").alias("a"), F.max("row_id").alias("b"))
    bad = sizes.where((F.col("n") != n) | (F.col("a") != 0) | (F.col("b") != n - 1))
    if not bad.isEmpty():
        raise SchemaError("a split does not cover all rows")


def finite_only(df: DataFrame, column: str) -> DataFrame:
    return df.where(is_finite(F.col(column)))


#: The corpora that the reference pipeline declares, with what is known of them.
SOURCES_SCHEMA = "name string, filename string, license string, bytes long, confirm boolean"


def source_registry(spark: SparkSession, entries: list[tuple]) -> DataFrame:
    """Declared sources; entries as ``SOURCES_SCHEMA`` says. ``confirm`` marks those too large to be
    fetched unasked."""
    return spark.createDataFrame(entries, SOURCES_SCHEMA)
