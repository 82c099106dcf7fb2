"""Queries of the training-data operators over the driver's tables, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup, html_crf, license_templates, mixing, ogg, sentencepiece_codec, simhash, token_counts, toxicity, warc
from . import pipeline as pipeline_stages
from .settings import END_OF_DOCUMENT, MIX_EXPONENT, MIX_SEED, tokenizer_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(_table(spark, sf_dir, "documents"), keep="largest")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece_codec.encode_digests(_table(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    chain = toxicity.train(docs, _table(spark, sf_dir, "labels"))
    out = toxicity.score(docs, chain)
    return out.select("doc_id", *[F.round(f"__p_{c}", 6).alias(f"p_{c}") for c in toxicity.CATEGORIES], F.col("__toxic").alias("toxic"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = simhash.near_groups(_table(spark, sf_dir, "documents"), shingle=3, radius=2)
    return groups.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


def op5_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ogg.load(ogg.store(_table(spark, sf_dir, "documents")))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_counts.token_counts(_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN, END_OF_DOCUMENT)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_templates.scan_licenses(_table(spark, sf_dir, "documents"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    records = warc.read_records(warc.write_archives(_table(spark, sf_dir, "pages")))
    return records.select(F.col("record_id").try_cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").try_cast("long").alias("refers_to"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    mixed = mixing.mix_sources(docs, exponent=MIX_EXPONENT, seed=MIX_SEED)
    return mixed.select("doc_id", "source", "text", F.col("__copy").alias("copy"), F.col("__copies").alias("copies"), F.col("__order").alias("shuffle_key"))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_crf.extract_main_text(_table(spark, sf_dir, "pages"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pipeline_stages.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [op1_exact_dedup, op2_sentencepiece, op3_toxicity, op4_simhash, op5_media, op6_token_counts, op7_licenses, op8_warc, op9_mixing, op10_html, pipeline]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_exact_dedup": """
            SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
                   row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
                   sha256(coalesce(text, '')) AS text_sha256
            FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
        "op8_warc": """
            WITH p AS (SELECT page_id, coalesce(html, '') AS h, strlen(coalesce(html, '')) AS n FROM pages),
                 g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS m FROM p)
            SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest,
                   CASE WHEN n >= 1000 AND m IS NOT NULL AND page_id IS DISTINCT FROM m THEN 'revisit' ELSE 'response' END AS record_type,
                   CASE WHEN n >= 1000 AND m IS NOT NULL AND page_id IS DISTINCT FROM m THEN m END AS refers_to
            FROM g""",
        "op9_mixing": f"""
            WITH n AS (SELECT coalesce(source, '') AS s, count(*) AS n FROM documents GROUP BY 1),
                 z AS (SELECT sum(pow(n, {MIX_EXPONENT})) AS z, sum(n) AS total FROM n),
                 r AS (SELECT s, pow(n, {MIX_EXPONENT}) / z * total / n AS mean FROM n, z),
                 t AS (SELECT s, mean, k, exp(k * ln(mean) - mean - lgamma(k + 1)) AS p FROM r, (SELECT unnest(range(0, 200)) AS k)),
                 c AS (SELECT s, k, sum(p) OVER (PARTITION BY s ORDER BY k) AS upto FROM t),
                 d AS (SELECT doc_id, source, text, coalesce(source, '') AS s, i, CAST('0x' || substr(md5('{MIX_SEED}:' || i), 1, 13) AS BIGINT) / {float(16**13)} AS u
                       FROM (SELECT *, coalesce(CAST(doc_id AS VARCHAR), 'text:' || md5(coalesce(text, ''))) AS i FROM documents)),
                 l AS (SELECT s, list(upto) AS upto FROM c GROUP BY s),
                 e AS (SELECT d.*, len(list_filter(l.upto, lambda x: x <= d.u)) AS copies FROM d JOIN l USING (s)),
                 x AS (SELECT e.*, unnest(range(0, copies)) AS copy FROM e)
            SELECT doc_id, source, text, CAST(copy AS BIGINT) AS copy, CAST(copies AS BIGINT) AS copies,
                   CAST('0x' || substr(md5('{MIX_SEED}:' || i || ':' || CAST(copy AS VARCHAR)), 1, 15) AS BIGINT) AS shuffle_key
            FROM x""",
    }
