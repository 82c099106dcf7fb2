"""Queries of rewards, advantages, sampling masks and losses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import numbers as N
from ..functions import text as X
from ..operators import policy as P
from ..operators.corpus import member_flag
from ..registry import query, table
from . import sql as Q
from .metrics import LEAK, _leak

CANON = Q.canonical("text")
#: Orders stand for prompts, their lines for candidates.
GROUP = "SELECT l_orderkey, l_linenumber, l_extendedprice AS reward FROM lineitem"


def _lines(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").alias("reward"))


@query(f"SELECT l_orderkey, l_linenumber, round((reward - avg(reward) OVER w) / (stddev_pop(reward) OVER w + 1e-8), 4) + 0.0 AS advantage FROM ({GROUP}) WINDOW w AS (PARTITION BY l_orderkey)")
def group_advantage(spark, sf):
    return P.group_advantage(_lines(spark, sf), ["l_orderkey"], "reward").select("l_orderkey", "l_linenumber", (F.round("advantage", 4) + 0.0).alias("advantage"))


@query(f"SELECT count(*) AS n_groups, count_if(s <= 1e-12)::BIGINT AS n_flat, round(count_if(s <= 1e-12) / count(*), 6) AS flat_fraction FROM (SELECT stddev_pop(reward) AS s FROM ({GROUP}) GROUP BY l_orderkey)")
def zero_variance_groups(spark, sf):
    g = P.group_stats(_lines(spark, sf), ["l_orderkey"], "reward")
    return g.agg(F.count(F.lit(1)).alias("n_groups"), F.count_if("is_flat").alias("n_flat"), F.round(N.share(F.col("is_flat")), 6).alias("flat_fraction"))


@query("""WITH g AS (SELECT event_type AS step, user_id AS grp, count(*) AS n, count(DISTINCT value) AS n_unique, stddev_pop(value) AS s FROM events GROUP BY ALL)
    SELECT step, sum(n)::BIGINT AS n, round(sum(n_unique) / sum(n), 6) AS unique_fraction, round(count_if(s <= 1e-12) / count(*), 6) AS flat_fraction, round(count_if(n >= 3) / count(*), 6) AS full_fraction, round(count_if(n < 3) / count(*), 6) AS partial_fraction FROM g GROUP BY step""")
def step_diagnostics(spark, sf):
    """Two levels: groups, then steps (event types)."""
    g = table(spark, sf, "events").groupBy(F.col("event_type").alias("step"), "user_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("value").alias("u"), F.stddev_pop("value").alias("s"))
    r = lambda c: F.round(c, 6)
    return g.groupBy("step").agg(F.sum("n").alias("n"), r(N.safe_ratio(F.sum("u"), F.sum("n"))).alias("unique_fraction"), r(N.share(F.col("s") <= 1e-12)).alias("flat_fraction"), r(N.share(F.col("n") >= 3)).alias("full_fraction"), r(N.share(F.col("n") < 3)).alias("partial_fraction"))


@query("SELECT doc_id, ([300.0, 400.0, 500.0, 600.0])[doc_id % 4 + 1]::DOUBLE AS target FROM documents")
def round_robin_targets(spark, sf):
    targets = F.array(*[F.lit(t) for t in (300.0, 400.0, 500.0, 600.0)])
    return table(spark, sf, "documents").select("doc_id", F.element_at(targets, (F.col("doc_id") % 4 + 1).cast("int")).alias("target"))


@query("SELECT item_id, unnest(range(0, 8))::BIGINT AS copy, item_id * 8 + unnest(range(0, 8)) AS position FROM benchmark")
def repeat_groups(spark, sf):
    b = table(spark, sf, "benchmark").select("item_id", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long"))).alias("copy"))
    return b.select("item_id", "copy", (F.col("item_id") * 8 + F.col("copy")).alias("position"))


@query(f"SELECT step::BIGINT AS step, i::BIGINT AS i, round(300 + 300 * {Q.md5_unit(chr(39) + 'target:' + chr(39) + ' || step || ' + chr(39) + ':' + chr(39) + ' || i')}, 6) AS target FROM (SELECT unnest(range(0, 4)) AS step), (SELECT unnest(range(0, 50)) AS i)")
def uniform_targets(spark, sf):
    steps = spark.range(4).withColumnRenamed("id", "step").crossJoin(F.broadcast(spark.range(50).withColumnRenamed("id", "i")))
    key = F.concat(F.lit("target:"), F.col("step").cast("string"), F.lit(":"), F.col("i").cast("string"))
    return steps.select("step", "i", F.round(F.lit(300) + F.lit(300) * X.md5_unit(key), 6).alias("target"))


@query(f"SELECT doc_id, round({Q.md5_unit(chr(39) + 'control:7:' + chr(39) + ' || doc_id')}, 9) AS reward FROM documents")
def control_reward(spark, sf):
    """Noise that depends on position and seed, never on content."""
    return table(spark, sf, "documents").select("doc_id", F.round(X.md5_unit(F.concat(F.lit("control:7:"), F.col("doc_id").cast("string"))), 9).alias("reward"))


TG = f"""{LEAK}, t AS (SELECT *, CASE WHEN l_linenumber = 1 THEN 0 ELSE n_clean END AS k, clean_mean / 100 AS v, sigma / 100 AS s, target / 100 AS goal FROM g),
    w AS (SELECT *, greatest(0, 1 - abs(v - goal) / 100) AS c, k / 5 * (1 / (1 + CASE WHEN k = 1 THEN 45.2 ELSE greatest(0, s) END / 20)) AS f FROM t)"""


def _tg(spark, sf):
    rows = _leak(spark, sf).withColumn("k", F.when(F.col("l_linenumber") == 1, 0).otherwise(F.col("n_clean")))
    parts = N.target_reward(F.col("clean_mean") / 100, F.col("sigma") / 100, F.col("target") / 100, F.col("k"), 5)
    return rows.select("l_orderkey", "l_linenumber", "k", *[c.alias(n) for n, c in parts.items()])


@query(f"WITH {TG} SELECT l_orderkey, l_linenumber, round(CASE WHEN k = 0 THEN 0 ELSE c END, 12) AS closeness, round(CASE WHEN k = 0 THEN 0 ELSE f END, 7) AS confidence, round(CASE WHEN k = 0 THEN 0 ELSE c * f END, 8) AS value, k = 0 AS gated, CASE WHEN k = 0 THEN 'no_contributing_members' END AS reason FROM w")
def tg_reward(spark, sf):
    r = lambda c, n: F.round(c, n).alias(c)
    return _tg(spark, sf).select("l_orderkey", "l_linenumber", r("closeness", 12), r("confidence", 7), r("value", 8), "gated", "reason")


@query(f"WITH {TG} SELECT count(*) AS n, round(avg(c) FILTER (k > 0), 5) AS mean_closeness, round(avg(f) FILTER (k > 0), 5) AS mean_confidence FROM w")
def component_mean(spark, sf):
    """Mean of a map's key over the rows that have it."""
    rows = _tg(spark, sf).withColumn("components", F.when(F.col("k") > 0, F.create_map(F.lit("closeness"), F.col("closeness"), F.lit("confidence"), F.col("confidence"))).otherwise(F.create_map(F.lit("n"), F.lit(0.0))))
    key = lambda k: F.round(F.avg(F.try_element_at("components", F.lit(k))), 5)
    return rows.agg(F.count(F.lit(1)).alias("n"), key("closeness").alias("mean_closeness"), key("confidence").alias("mean_confidence"))


@query(f"WITH {LEAK} SELECT l_orderkey, l_linenumber, round(CASE WHEN n_clean = 1 THEN 45.2 ELSE greatest(0, sigma) END, 4) AS sigma FROM g")
def effective_sigma(spark, sf):
    return _leak(spark, sf).select("l_orderkey", "l_linenumber", F.round(N.effective_sigma(F.col("sigma"), F.col("n_clean"), 5, 45.2), 4).alias("sigma"))


REWARD = f"""d AS (SELECT doc_id, lang, n_chars, {CANON} AS canonical FROM documents), r AS (SELECT DISTINCT canonical FROM d WHERE doc_id % 10 = 0),
    g AS (SELECT d.*, lang = 'en' AND n_chars >= 100 AS passes, r.canonical IS NULL AS is_novel, n_chars <= 3000 AS easy FROM d LEFT JOIN r USING (canonical) WHERE doc_id % 10 <> 0),
    f AS (SELECT *, coalesce(passes AND doc_id = min(doc_id) FILTER (passes) OVER (PARTITION BY canonical), false) AS is_first FROM g)"""


def _rewarded(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "lang", "n_chars", X.canonical(F.col("text")).alias("canonical"))
    g = member_flag(docs.where("doc_id % 10 <> 0"), docs.where("doc_id % 10 = 0"), "canonical", "known")
    g = g.withColumn("passes", (F.col("lang") == "en") & (F.col("n_chars") >= 100)).withColumn("is_novel", ~F.col("known")).withColumn("easy", F.col("n_chars") <= 3000)
    first = g.where("passes").groupBy(F.col("canonical").alias("c")).agg(F.min("doc_id").alias("first"))
    return g.join(first, F.col("canonical") == F.col("c"), "left").withColumn("is_first", F.coalesce(F.col("passes") & (F.col("doc_id") == F.col("first")), F.lit(False)))


@query(f"WITH {REWARD} SELECT doc_id, is_first FROM f")
def first_occurrence_flag(spark, sf):
    """One for the first occurrence among those that pass the gate, whatever the raw batch holds."""
    return _rewarded(spark, sf).select("doc_id", "is_first")


@query(f"WITH {REWARD} SELECT doc_id, CASE WHEN is_novel THEN 1.0 ELSE 0.0 END::DOUBLE AS reward FROM f")
def novelty_reward(spark, sf):
    return _rewarded(spark, sf).select("doc_id", F.col("is_novel").cast("double").alias("reward"))


@query(f"WITH {REWARD} SELECT doc_id, (easy AND is_novel)::INT::DOUBLE AS reward FROM f")
def constraint_reward(spark, sf):
    return _rewarded(spark, sf).select("doc_id", (F.col("easy") & F.col("is_novel")).cast("double").alias("reward"))


@query(f"WITH {REWARD} SELECT doc_id, CASE WHEN passes THEN 0.5 + 0.3 * is_novel::INT + 0.2 * is_first::INT ELSE 0 END::DOUBLE AS value, NOT passes AS gated, CASE WHEN NOT passes THEN CASE WHEN lang <> 'en' THEN 'parse_failed' ELSE 'too_short' END END AS reason FROM f")
def composite_reward(spark, sf):
    """Gate first, then weighed terms; the reason names the gate's step."""
    rows = _rewarded(spark, sf)
    value = F.lit(0.5) + F.lit(0.3) * F.col("is_novel").cast("int") + F.lit(0.2) * F.col("is_first").cast("int")
    return rows.select("doc_id", F.when(F.col("passes"), value).otherwise(F.lit(0.0)).alias("value"), (~F.col("passes")).alias("gated"), F.when(~F.col("passes"), F.when(F.col("lang") != "en", "parse_failed").otherwise("too_short")).alias("reason"))


@query(f"WITH {REWARD} SELECT arm, round(avg(r), 6) AS mean_reward FROM (SELECT 'validity' AS arm, passes::INT::DOUBLE AS r FROM f UNION ALL SELECT 'novelty', (passes AND is_novel)::INT::DOUBLE FROM f UNION ALL SELECT 'synthesisability', (passes AND easy)::INT::DOUBLE FROM f UNION ALL SELECT 'constraint', (easy AND is_novel)::INT::DOUBLE FROM f) GROUP BY arm")
def reward_arms(spark, sf):
    """Each arm's mean reward over the same candidates, in one pass."""
    p = F.col("passes")
    arms = {"validity": p, "novelty": p & F.col("is_novel"), "synthesisability": p & F.col("easy"), "constraint": F.col("easy") & F.col("is_novel")}
    one = _rewarded(spark, sf).agg(*[F.round(F.avg(c.cast("double")), 6).alias(n) for n, c in arms.items()])
    return one.selectExpr(f"stack({len(arms)}, " + ", ".join(f"'{n}', {n}" for n in arms) + ") AS (arm, mean_reward)")


@query("SELECT doc_id, n_chars IS NOT NULL AND n_chars <= 3000 AS passes FROM documents")
def sa_pass(spark, sf):
    return table(spark, sf, "documents").select("doc_id", (F.col("n_chars").isNotNull() & (F.col("n_chars") <= 3000)).alias("passes"))


@query("SELECT doc_id, (n_chars IS NOT NULL AND n_chars <= 3000)::INT::DOUBLE AS value, n_chars::DOUBLE AS score FROM documents")
def sa_reward(spark, sf):
    """The threshold as a reward of its own, beside the score that it judges; no score is no reward."""
    passes = F.col("n_chars").isNotNull() & (F.col("n_chars") <= 3000)
    return table(spark, sf, "documents").select("doc_id", passes.cast("double").alias("value"), F.col("n_chars").cast("double").alias("score"))


LOGITS = "SELECT user_id AS row, event_id AS token, value / 10 AS logit FROM events"


def _logits(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").alias("row"), F.col("event_id").alias("token"), (F.col("value") / 10).alias("logit"))


@query(f"""WITH l AS ({LOGITS}), p AS (SELECT *, exp(logit - max(logit) OVER (PARTITION BY row)) AS e FROM l), q AS (SELECT row, token, logit, e / sum(e) OVER (PARTITION BY row) AS p FROM p),
    c AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY row ORDER BY p DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before, row_number() OVER (PARTITION BY row ORDER BY p DESC, token) AS i FROM q) SELECT row, token, before <= 0.9 OR i <= 1 AS kept FROM c""")
def top_p_mask(spark, sf):
    return P.top_p_mask(_logits(spark, sf), ["row"], "token", "logit", 0.9).select("row", "token", "kept")


@query(f"SELECT row, token, rank() OVER (PARTITION BY row ORDER BY logit DESC) <= 10 AS kept FROM ({LOGITS})")
def top_k_mask(spark, sf):
    return P.top_k_mask(_logits(spark, sf), ["row"], "logit", 10).select("row", "token", "kept")


@query(f"SELECT row, token, round(logit / 0.7, 6) AS scaled, row_number() OVER (PARTITION BY row ORDER BY logit DESC, token) = 1 AS is_argmax FROM ({LOGITS})")
def temperature_scale(spark, sf):
    warm = P.temperature(_logits(spark, sf), ["row"], "token", "logit", 0.7)
    cold = P.temperature(warm.withColumnRenamed("scaled", "warm"), ["row"], "token", "logit", 0.0)
    return cold.select("row", "token", F.round("warm", 6).alias("scaled"), (F.col("scaled") == 0.0).alias("is_argmax"))


@query(f"WITH l AS ({LOGITS}) SELECT row, token, round(CASE WHEN s.seen IS NULL THEN logit WHEN logit < 0 THEN logit * 1.2 ELSE logit / 1.2 END, 6) AS logit FROM l LEFT JOIN (SELECT DISTINCT event_id AS seen FROM events WHERE event_type = 'click') s ON token = seen")
def repetition_penalty(spark, sf):
    seen = table(spark, sf, "events").where("event_type = 'click'").select(F.col("event_id").alias("seen")).distinct()
    joined = _logits(spark, sf).join(seen, F.col("token") == F.col("seen"), "left")
    return joined.select("row", "token", F.round(N.repetition_penalty(F.col("logit"), F.col("seen").isNotNull(), 1.2), 6).alias("logit"))


@query("SELECT l_orderkey, round(sum(-l_discount) / pow(greatest(count(*), 1), 0.6), 6) AS score FROM lineitem GROUP BY l_orderkey")
def length_penalty_score(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.round(N.length_penalty(F.sum(-F.col("l_discount")), F.count(F.lit(1)), 0.6), 6).alias("score"))


@query("SELECT l_orderkey, l_linenumber, round(exp(x) - x - 1, 6) AS kl FROM (SELECT l_orderkey, l_linenumber, greatest(-20, least(20, l_tax * 10 - l_discount * 10)) AS x FROM lineitem)")
def k3_kl(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(N.k3(F.col("l_tax") * 10, F.col("l_discount") * 10), 6).alias("kl"))


@query("""WITH t AS (SELECT l_orderkey, exp(l_tax - l_discount) * (1 + l_linenumber * 0.1) AS rho, (l_quantity - 25) / 10 AS a, greatest(-20, least(20, l_tax - l_discount)) AS x FROM lineitem),
    l AS (SELECT l_orderkey, -least(rho * a, greatest(0.8, least(1.2, rho)) * a) AS l, exp(x) - x - 1 AS k, abs(rho - 1) > 0.2 AS c FROM t), s AS (SELECT avg(l + 0.05 * k) AS loss, avg(k) AS kl, count_if(c) AS c, count(*) AS n FROM l GROUP BY l_orderkey)
    SELECT round(avg(loss), 5) AS loss, round(avg(kl), 7) AS kl, round(sum(c) / sum(n), 5) AS clip_fraction FROM s""")
def clipped_surrogate(spark, sf):
    lines = table(spark, sf, "lineitem")
    ratio = F.exp(F.col("l_tax") - F.col("l_discount")) * (F.lit(1) + F.col("l_linenumber") * 0.1)
    out = P.clipped_loss(lines, ["l_orderkey"], ratio, (F.col("l_quantity") - 25) / 10, N.k3(F.col("l_tax"), F.col("l_discount")))
    return out.select(F.round("loss", 5).alias("loss"), F.round("kl", 7).alias("kl"), F.round("clip_fraction", 5).alias("clip_fraction"))


@query("SELECT l_returnflag, round(sum(CASE WHEN abs(e) <= 1 THEN 0.5 * e * e ELSE abs(e) - 0.5 END * w) / sum(w), 6) AS loss FROM (SELECT l_returnflag, (l_quantity - 25) / 10 AS e, 1 / greatest(l_quantity, 5.6::DOUBLE) AS w FROM lineitem) GROUP BY l_returnflag")
def huber_weighted(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_returnflag", N.huber((F.col("l_quantity") - 25) / 10).alias("h"), N.reliability_weight(F.col("l_quantity")).alias("w"))
    return rows.groupBy("l_returnflag").agg(F.round(F.sum(F.col("h") * F.col("w")) / F.sum("w"), 6).alias("loss"))


@query("SELECT round(sum(ce * w) / sum(w), 6) AS loss FROM (SELECT l_orderkey, avg(l_extendedprice) FILTER (l_linenumber <> 3) AS ce, 1 + l_orderkey % 3 AS w FROM lineitem GROUP BY l_orderkey) WHERE ce IS NOT NULL")
def lm_weighted(spark, sf):
    """Mean over labelled positions of each example, then a weighted mean over examples."""
    per = table(spark, sf, "lineitem").where("l_linenumber <> 3").groupBy("l_orderkey").agg(F.avg("l_extendedprice").alias("ce"))
    w = F.lit(1) + F.col("l_orderkey") % 3
    return per.agg(F.round(F.sum(F.col("ce") * w) / F.sum(w), 6).alias("loss"))


@query("SELECT label, dim::INT AS dim, round(sum(x) FILTER (vec_id % 3 <> 0) / greatest(count(*) FILTER (vec_id % 3 <> 0), 1), 5) AS value FROM (SELECT vec_id, label, unnest(range(0, len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY label, dim")
def masked_mean_pool(spark, sf):
    return P.mean_pool(table(spark, sf, "embeddings"), ["label"], "embedding", F.col("vec_id") % 3 != 0).withColumn("value", F.round("value", 5))


@query("""SELECT s::BIGINT AS step, round(CASE WHEN s < 100 THEN s / 100 ELSE 1 END, 9) AS constant, round(CASE WHEN s < 100 THEN s / 100 ELSE greatest(0, (1000 - s) / 900) END, 9) AS linear,
    round(CASE WHEN s < 100 THEN s / 100 ELSE sqrt(100 / greatest(s, 100)) END, 9) AS inverse_sqrt, round(CASE WHEN s < 100 THEN s / 100 ELSE greatest(0, 0.5 * (1 + cos(pi() * least(1, (s - 100) / 900)))) END, 9) AS cosine FROM (SELECT unnest(range(0, 1100, 10)) AS s)""")
def lr_schedule(spark, sf):
    steps = spark.range(0, 1100, 10).withColumnRenamed("id", "step")
    return steps.select("step", *[F.round(N.learning_rate(n, F.col("step"), 1000, 100), 9).alias(n) for n in ("constant", "linear", "inverse_sqrt", "cosine")])


@query("""WITH o AS (SELECT unnest(range(-200, 201)) AS o), d AS (SELECT o, abs(o) AS a, greatest(-o, 0) AS c FROM o)
    SELECT o::BIGINT AS distance, ((o > 0)::INT * 16 + CASE WHEN a < 8 THEN a ELSE least(8 + floor(ln(greatest(a, 1) / 8) / ln(16) * 8 + 1e-9), 15) END)::BIGINT AS both_sides,
    (CASE WHEN c < 16 THEN c ELSE least(16 + floor(ln(greatest(c, 1) / 16) / ln(8) * 16 + 1e-9), 31) END)::BIGINT AS causal FROM d""")
def relative_bucket(spark, sf):
    d = spark.range(-200, 201).withColumnRenamed("id", "distance")
    return d.select("distance", N.position_bucket(F.col("distance")).alias("both_sides"), N.position_bucket(F.col("distance"), both=False).alias("causal"))


SIZES = [("tiny", 128, 16, 4, 256, 2, True), ("small", 256, 32, 8, 1024, 4, True), ("medium", 512, 64, 8, 2048, 6, False)]


@query("SELECT name, (458 * d * CASE WHEN tied THEN 1 ELSE 2 END + l * (4 * d * h * k + 3 * d * f + 2 * d) + 32 * h + d + l * (8 * d * h * k + 3 * d * f + 3 * d) + 32 * h + d)::BIGINT AS parameters FROM (VALUES " + ", ".join(f"('{n}', {d}, {k}, {h}, {f}, {ly}, {str(t).lower()})" for n, d, k, h, f, ly, t in SIZES) + ") AS v(name, d, k, h, f, l, tied)")
def param_count(spark, sf):
    df = spark.createDataFrame(SIZES, "name string, d_model long, d_kv long, heads long, d_ff long, layers long, tied boolean")
    c = {x: F.col(x) for x in ("d_model", "d_kv", "heads", "d_ff", "layers", "tied")} | {"decoder_layers": F.col("layers"), "vocab": F.lit(458), "buckets": F.lit(32), "gated": F.lit(True)}
    return df.select("name", N.parameter_count(c).alias("parameters"))


@query("SELECT source, count(*) AS n, (ceil(ceil(count(*) / 32) / 4) * 3)::BIGINT AS steps FROM documents GROUP BY source")
def step_budget(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.count(F.lit(1)).alias("n")).withColumn("steps", N.step_budget(F.col("n"), 32, 4, 3))
