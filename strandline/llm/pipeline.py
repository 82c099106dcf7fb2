"""A corpus pipeline of five stages, each over all that its predecessor kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame with
the columns of docs (the last one: its own). ``run`` applies them to documents, each stage written as a
table in the shared folder and read again.

Every stage counts null texts as empty, reads texts whole, however long, takes empty tables, and carries
other columns along, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from . import exact_dedup, mixing, sentencepiece_codec, simhash, toxicity
from .settings import MIX_EXPONENT, MIX_SEED, tokenizer_path
from .shared import materialise

#: Near copies: five-word shingles and this Jaccard similarity or more.
NEAR_SHINGLE, NEAR_SIMILARITY = 5, 0.8


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain calls toxic go, every repetition of a row alike; empty texts
    get the chain's base rate, and without labelled documents of both classes all stay."""
    return toxicity.clean(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest identifier stays, one without an identifier only where no
    other has the text; of rows that agree in both one. Empty texts are equal texts."""
    return exact_dedup.exact_distinct(docs, keep="smallest")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest identifier stays, as in
    ``drop_copies``; texts without words are a group."""
    return simhash.near_distinct(docs, similarity=NEAR_SIMILARITY, shingle=NEAR_SHINGLE)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated by Poisson draws towards the sources' target weights, in a global shuffle; rows
    that agree draw alike, a null source is a source."""
    return mixing.mix_sources(docs, exponent=MIX_EXPONENT, seed=MIX_SEED, extra=False)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """SentencePiece digests of each copy; an empty text has the begin and end ids."""
    return sentencepiece_codec.encode_digests(docs, tokenizer_path("piece_bpe_32k.model"))


STAGES = [("toxicity", reject_toxic), ("exact dedup", drop_copies), ("simhash", drop_near_copies), ("mixing", mix), ("sentencepiece", tokenise)]

#: The first stage is a trained model, which SQL can't say.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)
