"""Sinks: token corpora, hash indexes, splits, reports, logs. All are Spark writers, so a table is
there whole or not at all."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DTYPES = {"uint16": 2**16, "uint32": 2**32}


def write_token_corpus(df: DataFrame, path: str, ids: str = "ids", dtype: str = "uint16", extra: dict | None = None) -> dict:
    """Writes rows with a token array as Parquet and metadata beside it. Empty rows and identifiers
    out of the type's range fail the write."""
    size, top = F.size(ids), F.array_max(ids)
    checked = df.withColumn("n_tokens", F.when((size > 0) & (F.array_min(ids) >= 0) & (top < F.lit(DTYPES[dtype])), size).otherwise(F.raise_error(F.lit("an empty row or an identifier out of range")).cast("int")))
    checked.write.mode("overwrite").parquet(f"{path}/tokens")
    stats = df.sparkSession.read.parquet(f"{path}/tokens").agg(F.count(F.lit(1)).alias("n_sequences"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("n_tokens")).first().asDict()
    meta = {**stats, "dtype": dtype, **(extra or {})}
    write_json(df.sparkSession, meta, f"{path}/metadata")
    return meta


def read_token_corpus(spark: SparkSession, path: str, tokenizer: str | None = None) -> DataFrame:
    """A corpus; where it names a tokenizer's digest, a different one raises."""
    meta = spark.read.json(f"{path}/metadata").first().asDict()
    if tokenizer and meta.get("tokenizer_sha256") not in (None, tokenizer):
        raise ValueError("the corpus was made with another tokenizer")
    return spark.read.parquet(f"{path}/tokens")


def write_json(spark: SparkSession, record: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(record, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def write_hash_index(df: DataFrame, key: str, path: str, space: str, name: str = "md5_60") -> dict:
    """Distinct hashes in range-partitioned, sorted files, with metadata."""
    df.select(F.col(key).alias("h")).where("h IS NOT NULL").distinct().repartitionByRange("h").sortWithinPartitions("h").write.mode("overwrite").parquet(f"{path}/hashes")
    n = df.sparkSession.read.parquet(f"{path}/hashes").count()
    meta = {"n_entries": n, "hash_space": space, "hash_name": name}
    write_json(df.sparkSession, meta, f"{path}/metadata")
    return meta


def write_splits(df: DataFrame, path: str, part: str = "part") -> None:
    df.write.mode("overwrite").partitionBy(part).parquet(path)


def append_chunk(df: DataFrame, path: str, chunk: int) -> None:
    """Writes or rewrites one chunk's partition: a resumed job repeats a chunk without doubling it."""
    df.withColumn("chunk", F.lit(chunk)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("chunk").parquet(path)


def write_pairs(df: DataFrame, path: str, part: str = "part") -> None:
    """JSON lines of source and target, a folder for each part."""
    df.select("source", "target", part).write.mode("overwrite").partitionBy(part).json(path)


def write_lines(df: DataFrame, column: str, order: str, path: str) -> None:
    """Text lines in a global order: the part files, by name, follow each other."""
    df.orderBy(order).select(column).write.mode("overwrite").text(path)


def log_metrics(log: DataFrame, rows: DataFrame) -> DataFrame:
    """The log with rows appended; unseen columns widen it, missing ones are null."""
    return log.unionByName(rows, allowMissingColumns=True)


def write_report(metrics: dict, generations: DataFrame, path: str) -> None:
    write_json(generations.sparkSession, metrics, f"{path}/metrics")
    generations.write.mode("overwrite").json(f"{path}/generations")


def guard_drop(df: DataFrame, kept: str, most: float) -> DataFrame:
    """df, or an error where more than a share ``most`` of its rows is not kept."""
    n, bad = df.agg(F.count(F.lit(1)), F.count_if(~F.col(kept))).first()
    if n and bad / n > most:
        raise ValueError(f"{bad} of {n} rows are unusable, more than {most:.0%}")
    return df
