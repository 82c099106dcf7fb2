"""Queries by name, and their SQL. Modules of ``plans`` register theirs with ``query``."""

from __future__ import annotations

import functools
import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ship import ship

Query = Callable[[SparkSession, str], DataFrame]
MODULES = ("corpus", "metrics", "rewards", "compare", "tokens", "chat", "series", "connect", "helpers", "extra")

#: Names under which the inventory lists an operator a second time.
ALIASES = {
    "cascade_sv_tsd_dd_pv": "cascade_records", "filter_counts": "cascade_counts", "across_seed_clause": "across_seed", "combined": "combined_clause", "preregistration_diff": "prereg_diff", "rank_tokens": "vocab_counts",
    "head_limit": "limit_rows", "pretrain_split": "random_split", "key_union_widen": "log_metrics", "looks_like_pselfies": "looks_like_tokens", "encode": "encode_bracket", "batch_encode": "pad_and_mask", "decode": "decode_tokens",
    "pad_sequences": "pad_and_mask", "parse_intent": "intent_route", "safe_ratio": "safe_ratio_rows", "accuracy": "tg_reward", "validity": "validity_gate", "novelty": "novelty_reward", "synthesisability": "sa_pass",
    "composite": "composite_reward", "constraint": "constraint_reward", "control": "control_reward", "lru_memo": "score_distinct_join_back", "augmented_row": "augment", "sweep_config_row": "sweep_grid", "reward_factory": "reward_arms",
    "span_stage_stats": "corruption_stats", "default_vocab": "vocab_assemble", "injected_novelty_index": "member_semi_join", "index_self_check": "self_check", "injected_tokenizer": "tokenize_longest_match", "sweep_df": "sweep_md",
}

_queries: dict[str, Query] = {}
_sql: dict[str, str] = {}


def _shipping(f: Query) -> Query:
    @functools.wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return f(spark, sf_dir)

    return run


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Register a function (spark, sf_dir) under its own name; sql is the same for DuckDB."""

    def add(f: Query) -> Query:
        name = f.__name__
        if name in _queries:
            raise ValueError(f"two queries are named {name}")
        _queries[name] = _shipping(f)
        if sql is not None:
            _sql[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def placed(df: DataFrame) -> DataFrame:
    """A table with the place of each row, file by file: __file, __row. Files are in the order of their names; Spark
    gives paths with escapes, which sort in another."""
    plain = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    path = plain if len(df.inputFiles()) > 1 else F.lit("")
    return df.select("*", path.alias("__file"), F.col("_metadata.row_index").alias("__row"))


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"strandline.plans.{m}")


def queries() -> dict[str, Query]:
    """Every query under its name and its aliases."""
    _load()
    return dict(_queries) | {a: _queries[n] for a, n in ALIASES.items()}


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_sql) | {a: _sql[n] for a, n in ALIASES.items() if n in _sql}
