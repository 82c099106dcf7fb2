"""Queries of logs over events: users stand for runs, event identifiers for steps."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series as S
from ..registry import query, table

SEC = "(epoch_us({a}) - epoch_us({b})) / 1e6"


def _events(spark, sf):
    return table(spark, sf, "events")


@query("SELECT event_id, round(CASE WHEN dt > 0 THEN ds / dt END, 6) AS rate FROM (SELECT event_id, (epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 AS dt, event_id - lag(event_id) OVER w AS ds FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id))")
def step_rate(spark, sf):
    return S.step_rate(_events(spark, sf), "user_id", "ts", "event_id").select("event_id", F.round("rate", 6).alias("rate"))


@query("""WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events), g AS (SELECT user_id, max(ts) AS t1, min(ts) AS t0, arg_max(event_id, (ts, event_id)) AS s1, arg_min(event_id, (ts, event_id)) AS s0 FROM r WHERE rn <= 7 GROUP BY 1)
    SELECT user_id, round(CASE WHEN s1 > s0 THEN (epoch_us(t1) - epoch_us(t0)) / 1e6 / (s1 - s0) END, 6) AS seconds_per_step FROM g""")
def recent_rate(spark, sf):
    return S.recent_rate(_events(spark, sf), "user_id", "ts", "event_id").select("user_id", F.round("seconds_per_step", 6).alias("seconds_per_step"))


@query("SELECT user_id, count_if(gap > 100000)::BIGINT AS n_stalls, round(max(gap), 6) AS longest FROM (SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) / 1e6 AS gap FROM events) GROUP BY user_id")
def stall_gaps(spark, sf):
    return S.stalls(_events(spark, sf), "user_id", "ts", 100000.0).select("user_id", "n_stalls", F.round("longest", 6).alias("longest"))


@query("""WITH n AS (SELECT user_id, ts, coalesce(((epoch_us(ts) - epoch_us(lag(ts) OVER w)) / 1e6 >= 36000)::INT, 1) AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
    s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS session FROM n) SELECT user_id, session::BIGINT AS session, count(*) AS n, min(ts) AS begin, max(ts) AS end FROM s GROUP BY ALL""")
def session_window(spark, sf):
    return S.sessions(_events(spark, sf), "user_id", "ts", 36000.0)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS begin, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def tumbling_window(spark, sf):
    g = _events(spark, sf).groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").alias("begin"), "event_type", "n", "total")


@query("SELECT begin, count(*) AS n FROM (SELECT unnest([time_bucket(INTERVAL 30 MINUTE, ts), time_bucket(INTERVAL 30 MINUTE, ts) - INTERVAL 30 MINUTE]) AS begin FROM events) GROUP BY begin")
def sliding_window(spark, sf):
    g = _events(spark, sf).groupBy(F.window("ts", "1 hour", "30 minutes").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return g.select(F.col("w.start").alias("begin"), "n")


@query("SELECT event_id FROM (SELECT event_id, ts, max(ts) OVER (PARTITION BY user_id ORDER BY event_id DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM events) WHERE ts < seen - INTERVAL 2 DAY")
def late_rows(spark, sf):
    """Rows two days behind the newest time that their user's stream, here read backwards, has shown."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy(F.desc("event_id")).rowsBetween(Window.unboundedPreceding, -1)
    return _events(spark, sf).withColumn("seen", F.max("ts").over(w)).where(F.col("ts") < F.col("seen") - F.expr("INTERVAL 2 DAYS")).select("event_id")


@query("SELECT user_id, value, min(event_id) AS event_id FROM events GROUP BY ALL")
def incremental_dedup_batch(spark, sf):
    """What a stream's dedup by key lets through, as a batch."""
    return _events(spark, sf).groupBy("user_id", "value").agg(F.min("event_id").alias("event_id"))


@query("SELECT user_id, max(event_id) AS step, arg_max(event_type, event_id) AS last_type FROM events GROUP BY user_id")
def latest_checkpoint(spark, sf):
    return _events(spark, sf).groupBy("user_id").agg(F.max("event_id").alias("step"), F.max_by("event_type", "event_id").alias("last_type"))


@query("SELECT user_id, event_id FROM (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS a, row_number() OVER (PARTITION BY user_id ORDER BY value NULLS LAST, event_id) AS m FROM events) WHERE a <= 2 OR m = 1")
def rotate_keep(spark, sf):
    return S.rotate(_events(spark, sf), "user_id", "event_id", "value", 2).select("user_id", "event_id")


@query("""WITH r AS (SELECT user_id, value, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS i FROM events),
    p AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY i DESC) AS b FROM r WHERE i % greatest(1, n // 16) = 0), q AS (SELECT *, min(value) OVER (PARTITION BY user_id) AS lo, max(value) OVER (PARTITION BY user_id) AS hi FROM p WHERE b <= 16)
    SELECT user_id, string_agg(substr('▁▂▃▄▅▆▇█', CASE WHEN hi > lo THEN floor((value - lo) / (hi - lo) * 7) ELSE 0 END::INT + 1, 1), '' ORDER BY i) AS line FROM q GROUP BY user_id""")
def sparkline_sample(spark, sf):
    return S.sparkline(_events(spark, sf), "user_id", "event_id", "value")


@query("SELECT event_id, value FROM events WHERE event_id % 250 = 0")
def periodic_observe(spark, sf):
    """Every 250th step only."""
    return _events(spark, sf).where("event_id % 250 = 0").select("event_id", "value")


@query("SELECT event_type, strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') AS newest, round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6, 6) AS span FROM events GROUP BY 1")
def utc_stamps(spark, sf):
    """ISO stamps and spans in seconds."""
    span = S.seconds(F.max("ts"), F.min("ts"))
    return _events(spark, sf).groupBy("event_type").agg(F.date_format(F.max("ts"), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("newest"), F.round(span, 6).alias("span"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY ROLLUP (lang, source)")
def rollup_lang_source(spark, sf):
    return table(spark, sf, "documents").rollup("lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def cube_flags(spark, sf):
    return table(spark, sf, "lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))


@query("SELECT lang, source, count(*) AS n FROM documents GROUP BY GROUPING SETS ((lang), (source), ())")
def grouping_sets(spark, sf):
    d = table(spark, sf, "documents")
    return d.groupingSets([[F.col("lang")], [F.col("source")], []], "lang", "source").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 'parts' AS counted, count(DISTINCT l_partkey) AS exact, true AS close FROM lineitem UNION ALL SELECT 'orders', count(DISTINCT l_orderkey), true FROM lineitem")
def approx_distinct(spark, sf):
    """Sketched numbers of distinct keys beside the exact ones: whether they are within three standard
    errors (5 % for the first, 1.625 % for the second sketch)."""
    lines = table(spark, sf, "lineitem")
    sketched = lines.agg(F.approx_count_distinct("l_partkey", 0.05).alias("parts"), F.hll_sketch_estimate(F.hll_sketch_agg("l_orderkey")).alias("orders"))
    exact = lines.agg(F.count_distinct("l_partkey").alias("n_parts"), F.count_distinct("l_orderkey").alias("n_orders"))
    both = sketched.crossJoin(F.broadcast(exact)).selectExpr("stack(2, 'parts', parts, n_parts, 0.05D, 'orders', orders, n_orders, 0.01625D) AS (counted, estimate, exact, error)")
    return both.select("counted", "exact", (F.abs(F.col("estimate") - F.col("exact")) <= 3 * F.col("error") * F.col("exact")).alias("close"))
