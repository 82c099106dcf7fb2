"""Injected predictors: any function from a list of strings to a list of numbers, run in batches by
an iterator pandas UDF that loads it once a task. A batch that fails is NaN, never an error."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .metrics import ensemble

Predict = Callable[[list[str]], list[float]]


def predictor(load: Callable[[], Predict], batch: int = 32):
    """A UDF of a text column. Wrong lengths and exceptions make the batch NaN."""

    @F.pandas_udf(T.DoubleType())
    def run(frames: Iterator[pd.Series]) -> Iterator[pd.Series]:
        predict = load()
        for s in frames:
            out: list[float] = []
            texts = ["" if x is None else x for x in s.tolist()]
            for k in range(0, len(texts), batch):
                part = texts[k : k + batch]
                try:
                    got = [float(x) for x in predict(part)]
                except Exception:
                    got = []
                out += got if len(got) == len(part) else [float("nan")] * len(part)
            yield pd.Series(out, dtype="float64")

    return run


def score_distinct(df: DataFrame, text: str, score: Callable[[Column], Column], name: str) -> DataFrame:
    """df with a score computed once for each distinct text and joined back."""
    scored = df.select(F.col(text).alias("__t")).distinct().withColumn(name, score(F.col("__t")))
    return df.join(scored, F.col(text).eqNullSafe(F.col("__t")), "left").drop("__t")


def ensemble_predict(df: DataFrame, key: str, text: str, members: list) -> DataFrame:
    """key, mean, std, n_contributing over member UDFs; all members run in one pass over the rows."""
    pairs = F.array(*[m(F.col(text)) for m in members])
    return ensemble(df.select(key, F.explode(pairs).alias("v")), [key], F.col("v"))


def reference(rows: DataFrame, key: str) -> DataFrame:
    """Anything with a key column serves as a novelty reference: its distinct keys."""
    return rows.select(key).where(F.col(key).isNotNull()).distinct()


def drift(scored: DataFrame, reward: str, auditor: Callable[[DataFrame], DataFrame], key: str, audit: str) -> DataFrame:
    """Gap of a reward to an auditor's view, kept out of the reward's own path: means over rows that
    both have measured."""
    both = scored.select(key, reward).join(auditor(scored).select(key, audit), key)
    gap = F.col(reward) - F.col(audit)
    return both.agg(F.count(gap).alias("n"), F.avg(gap).alias("mean_gap"), F.avg(F.abs(gap)).alias("mean_abs_gap"))
