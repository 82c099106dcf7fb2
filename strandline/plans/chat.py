"""Queries of the chat router over conversations: a turn's message is a template by turn number with
the text's first word behind it."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import chat as H
from ..functions import text as X
from ..registry import query, table
from . import sql as Q

MESSAGES = [
    "generate 20 polymers with Tg near 450 K", "predict Tg for [*]CCO[*]", "use temperature 0.9 and top_p 0.95", "help", "hello there", "what is the glass transition of [At][C][C][O][At]?",
    "make me 5 candidates around 100 celsius", "seed 7 and top k 40", "design something with a glass transition temperature of 500, n = 3", "", "how do i use this", "at 380 kelvin please",
]
LIST = "[" + ", ".join("'" + m + "'" for m in MESSAGES) + "]"
PICK = "((conv_id * 7 + turn * 5) % 12)"
MSG = f"m AS (SELECT conv_id, turn, role, ({LIST})[({PICK} + 1)::INT] AS msg FROM conversations)"


def _messages(spark, sf):
    pick = ((F.col("conv_id") * 7 + F.col("turn") * 5) % 12 + 1).cast("int")
    return table(spark, sf, "conversations").select("conv_id", "turn", "role", F.element_at(F.array(*[F.lit(m) for m in MESSAGES]), pick).alias("msg"))


def _sql(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _any(words) -> str:
    return "(" + " OR ".join(f"contains(lower(msg), {_sql(w)})" for w in words) + ")"


TOKENS = r"list_transform(string_split_regex(regexp_replace(msg, '^\s+|\s+$', '', 'g'), '\s+'), lambda w: regexp_replace(w, '^[?!,;:.]+|[?!,;:.]+$', '', 'g'))"
ROUTE = rf"""{MSG}, a AS (SELECT *, list_filter({TOKENS}, lambda w: regexp_matches(w, '^(\[[^\[\]\s]*\])(\[[^\[\]\s]*\])+$') OR contains(w, '*') OR contains(w, '[At]'))[1] AS structure FROM m),
    b AS (SELECT *, CASE WHEN structure IS NOT NULL THEN replace(msg, structure, ' ') ELSE msg END AS r0 FROM a), c AS (SELECT *, regexp_matches(r0, {_sql(H.NAMED_TARGET)}) AS named FROM b),
    d AS (SELECT *, nullif(CASE WHEN named THEN regexp_extract(r0, {_sql(H.NAMED_TARGET)}, 1) ELSE regexp_extract(r0, {_sql(H.UNIT_TARGET)}, 1) END, '') AS raw, lower(CASE WHEN named THEN regexp_extract(r0, {_sql(H.NAMED_TARGET)}, 2) ELSE regexp_extract(r0, {_sql(H.UNIT_TARGET)}, 2) END) AS unit,
        CASE WHEN named THEN regexp_replace(r0, {_sql(H.NAMED_TARGET)}, ' ') ELSE regexp_replace(r0, {_sql(H.UNIT_TARGET)}, ' ') END AS r1 FROM c),
    e AS (SELECT *, raw::DOUBLE + CASE WHEN unit IN ('c', 'celsius', 'centigrade') THEN 273.15 ELSE 0 END AS target, nullif(regexp_extract(r1, {_sql(H.COUNT_NOUN)}, 1), '') AS noun FROM d),
    f AS (SELECT *, coalesce(noun, nullif(regexp_extract(r1, {_sql(H.COUNT_SET)}, 1), ''))::BIGINT AS count, CASE WHEN noun IS NOT NULL THEN regexp_replace(r1, {_sql(H.COUNT_NOUN)}, ' ') ELSE regexp_replace(r1, {_sql(H.COUNT_SET)}, ' ') END AS r2 FROM e),
    g AS (SELECT *, nullif(regexp_extract(r2, {_sql(H.TEMPERATURE)}, 1), '')::DOUBLE AS temperature, nullif(regexp_extract(r2, {_sql(H.TOP_P)}, 1), '')::DOUBLE AS top_p, nullif(regexp_extract(r2, {_sql(H.TOP_K)}, 1), '')::BIGINT AS top_k, nullif(regexp_extract(r2, {_sql(H.SEED)}, 1), '')::BIGINT AS seed FROM f),
    i AS (SELECT *, CASE WHEN {Q.strip('msg')} = '' THEN 'unknown' WHEN regexp_matches(lower(msg), {_sql(H.HELP)}) OR {_any(H.HELP_PHRASES)} THEN 'help' WHEN structure IS NOT NULL THEN 'predict' WHEN target IS NOT NULL THEN 'generate' WHEN coalesce(temperature, top_p, top_k, seed) IS NOT NULL THEN 'params' ELSE 'unknown' END AS name FROM g)"""


def _routed(spark, sf):
    return H.route(_messages(spark, sf), "msg")


@query(f"""WITH {ROUTE} SELECT conv_id, turn, name, (CASE name WHEN 'help' THEN 1.0 WHEN 'predict' THEN CASE WHEN {_any(H.PREDICT_VERBS)} THEN 0.95 ELSE 0.8 END WHEN 'generate' THEN CASE WHEN {_any(H.GENERATE_VERBS)} THEN 0.95 ELSE 0.7 END WHEN 'params' THEN 0.9 ELSE 0 END)::DOUBLE AS confidence,
    CASE WHEN name = 'generate' THEN target END AS target, CASE WHEN name = 'generate' THEN count END AS count, CASE WHEN name = 'predict' THEN structure END AS structure, temperature, top_p, top_k, seed FROM i""")
def intent_route(spark, sf):
    return _routed(spark, sf).drop("role", "msg")


@query(f"WITH {ROUTE}, k AS (SELECT *, CASE WHEN role = 'user' AND name IN ('generate', 'predict') THEN name END AS act FROM i) SELECT conv_id, turn, last_value(act IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS earlier FROM k")
def history_lookup(spark, sf):
    """The latest earlier user turn that asks for something."""
    act = F.when((F.col("role") == "user") & F.col("name").isin("generate", "predict"), F.col("name"))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return _routed(spark, sf).withColumn("act", act).select("conv_id", "turn", F.last("act", ignorenulls=True).over(w).alias("earlier"))


@query("SELECT p_partkey, round(p_retailprice + CASE WHEN p_size % 3 = 0 THEN 273.15 ELSE 0 END, 6) AS kelvin FROM part")
def to_kelvin(spark, sf):
    unit = F.when(F.col("p_size") % 3 == 0, "Celsius").when(F.col("p_size") % 3 == 1, "K")
    return table(spark, sf, "part").select("p_partkey", F.round(H.to_kelvin(F.col("p_retailprice"), unit), 6).alias("kelvin"))


@query(rf"""WITH {MSG}, w AS (SELECT conv_id, turn, {TOKENS} AS ws FROM m) SELECT conv_id, turn, len(list_filter(ws, lambda w: regexp_matches(w, '^(\[[^\[\]\s]*\])(\[[^\[\]\s]*\])+$')))::BIGINT AS n_pselfies,
    len(list_filter(ws, lambda w: NOT regexp_matches(w, '^(\[[^\[\]\s]*\])(\[[^\[\]\s]*\])+$') AND (contains(w, '*') OR contains(w, '[At]'))))::BIGINT AS n_psmiles FROM w""")
def resolve_structure(spark, sf):
    """Structures in a message by kind."""
    words = F.transform(F.split(X.strip(F.col("msg")), r"\s+"), lambda w: F.regexp_replace(w, r"^[?!,;:.]+|[?!,;:.]+$", ""))
    kinds = F.transform(words, X.structure_kind)
    n = lambda k: F.size(F.filter(kinds, lambda x: x == k)).cast("long")
    return _messages(spark, sf).select("conv_id", "turn", n("pselfies").alias("n_pselfies"), n("psmiles").alias("n_psmiles"))


@query(f"WITH {ROUTE} SELECT name, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM i GROUP BY name")
def app_aggregate(spark, sf):
    g = _routed(spark, sf).groupBy("name").agg(F.count(F.lit(1)).alias("n"))
    return g.crossJoin(F.broadcast(g.agg(F.sum("n").alias("t")))).select("name", "n", F.round(F.col("n") / F.col("t"), 6).alias("share"))


@query(f"WITH {ROUTE} SELECT conv_id, turn, CASE name WHEN 'generate' THEN 'Target ' || printf('%.2f', target) || ' K, ' || coalesce(count::VARCHAR, 'default') || ' candidates.' WHEN 'predict' THEN 'Structure ' || structure || '.' WHEN 'help' THEN 'Usage.' ELSE 'No request.' END AS reply FROM i")
def format_reply(spark, sf):
    said = F.when(F.col("name") == "generate", F.format_string("Target %.2f K, %s candidates.", F.col("target"), F.coalesce(F.col("count").cast("string"), F.lit("default")))).when(F.col("name") == "predict", F.format_string("Structure %s.", F.col("structure"))).when(F.col("name") == "help", "Usage.").otherwise("No request.")
    return _routed(spark, sf).select("conv_id", "turn", said.alias("reply"))


@query("SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS index, role, length(text) AS n_chars FROM conversations")
def summary_table(spark, sf):
    """Records flattened to a fixed field list with their index."""
    i = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    return table(spark, sf, "conversations").select("conv_id", "turn", i.cast("long").alias("index"), "role", F.length("text").cast("long").alias("n_chars"))
