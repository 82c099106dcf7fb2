"""Streams: tailing a metrics log, dedup against what has been seen, windows with late rows, stalls.

State lives in the state store under the query's checkpoint; each function returns the streaming
DataFrame, and ``run_once`` drains what is there into a table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.sinks import append_chunk


def tail_json(spark: SparkSession, folder: str, schema: T.StructType | str, files_a_trigger: int = 100) -> DataFrame:
    """Rows of JSON-lines files as they arrive; a partial or malformed line is skipped."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).option("mode", "DROPMALFORMED").json(folder)


def tail_parquet(spark: SparkSession, folder: str, schema: T.StructType | str, files_a_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def incremental_dedup(stream: DataFrame, key: list[str], time: str | None = None, delay: str = "1 day") -> DataFrame:
    """The first row of each key. With a time column the state is bounded by the watermark: copies
    that come later than the delay may pass; without one all keys are kept."""
    if time is None:
        return stream.dropDuplicates(key)
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)


def windowed(stream: DataFrame, time: str, size: str, by: list[str], value: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts and sums in tumbling or sliding windows; rows behind the watermark are dropped."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return stream.withWatermark(time, delay).groupBy(w.alias("w"), *by).agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total"))


def session_counts(stream: DataFrame, time: str, key: str, gap: str, delay: str = "1 hour") -> DataFrame:
    """Rows of each session: a pause of ``gap`` ends it."""
    return stream.withWatermark(time, delay).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n"))


def stalls(stream: DataFrame, key: str, time: str, limit_s: float) -> DataFrame:
    """key, gap: a row for each pause longer than the limit, from the newest time kept for each key."""
    kind = stream.schema[key].dataType

    def step(k, frames, state):
        import pandas as pd

        last = state.get[0] if state.exists else None
        times = sorted(t for f in frames for t in f["t"])
        gaps = []
        for t in times:
            if last is not None and t - last > limit_s:
                gaps.append(t - last)
            last = t if last is None else max(last, t)
        state.update((last,))
        if gaps:
            yield pd.DataFrame({"key": [k[0]] * len(gaps), "gap": gaps})

    rows = stream.select(F.col(key).alias("key"), (F.unix_micros(F.col(time).cast("timestamp")) / 1e6).alias("t"))
    out = T.StructType([T.StructField("key", kind), T.StructField("gap", T.DoubleType())])
    return rows.groupBy("key").applyInPandasWithState(step, out, "last double", "append", "NoTimeout")


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Processes all that is there, then stops; run again, it takes up where it stopped."""
    stream.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path).awaitTermination()


def run_bounded(stream: DataFrame, path: str, checkpoint: str) -> None:
    """As ``run_once``, a batch at a time: the source's own bound (files a trigger) says how much is in
    flight, and each batch is a chunk that a repeated batch overwrites, so no row is doubled."""
    stream.writeStream.foreachBatch(lambda batch, k: append_chunk(batch, path, k)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
