"""Queries of metrics over (prediction, target) pairs of lineitem and part, embeddings, documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.numbers import is_finite, pearson, safe_ratio, slope
from ..operators import metrics as M
from ..registry import placed, query, table
from ..sources.scratch import materialise
from . import sql as Q
from .corpus import COUNTS, SCREENED, _screened

#: Some predictions are no numbers: every line number 7 says so.
PAIRS = """p AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, l_linestatus, l_shipdate,
    CASE WHEN l_linenumber = 7 THEN 'soluble' ELSE CAST(l_quantity * p_retailprice AS VARCHAR) END AS said,
    CASE WHEN l_linenumber < 7 THEN l_quantity * p_retailprice END AS pred, l_extendedprice AS target FROM lineitem JOIN part ON l_partkey = p_partkey)"""


def _pairs(spark, sf, lines=None):
    lines = table(spark, sf, "lineitem") if lines is None else lines
    parts = table(spark, sf, "part").select("p_partkey", "p_retailprice")
    value = F.col("l_quantity") * F.col("p_retailprice")
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    said = F.when(F.col("l_linenumber") == 7, F.lit("soluble")).otherwise(value.cast("string"))
    return joined.withColumn("said", said).withColumn("pred", X.parse_strict(F.col("said"))).withColumn("target", F.col("l_extendedprice"))


def _rounded(df, digits=4):
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


REPORT = """count(*) AS n_total, count_if(pred IS NULL)::BIGINT AS n_non_numeric, (count(*) - count_if(pred IS NULL))::BIGINT AS n_valid, round(avg(abs(pred - target)), 4) AS mae,
    round(sqrt(avg((pred - target) ** 2)), 4) AS rmse, round(1 - sum((pred - target) ** 2) / (var_pop(target) FILTER (pred IS NOT NULL) * count(pred)), 4) AS r2,
    round(covar_pop(pred, target) / (stddev_pop(pred) * (stddev_pop(target) FILTER (pred IS NOT NULL))), 4) AS pearson"""


@query(f"WITH {PAIRS} SELECT {REPORT} FROM p")
def regression_report(spark, sf):
    return _rounded(M.regression_report(_pairs(spark, sf), F.col("target"), F.col("pred")))


ARMS = ["l_returnflag", "l_linestatus"]


@query(f"WITH {PAIRS} SELECT l_returnflag, l_linestatus, {REPORT} FROM p GROUP BY ALL")
def regression_report_by_arm(spark, sf):
    return _rounded(M.regression_report(_pairs(spark, sf), F.col("target"), F.col("pred"), ARMS))


@query(f"""WITH {PAIRS}, r AS (SELECT l_orderkey % 5 AS split, avg(abs(pred - target)) AS mae, sqrt(avg((pred - target) ** 2)) AS rmse FROM p GROUP BY 1)
    SELECT metric, round(avg(x), 4) AS mean, round(stddev_pop(x), 4) AS std, count(x) AS n FROM (SELECT 'mae' AS metric, mae AS x FROM r UNION ALL SELECT 'rmse', rmse FROM r) GROUP BY metric""")
def aggregate_over_splits(spark, sf):
    reports = M.regression_report(_pairs(spark, sf).withColumn("split", F.col("l_orderkey") % 5), F.col("target"), F.col("pred"), ["split"])
    return _rounded(M.over_splits(reports, ["mae", "rmse"]))


@query(f"WITH {PAIRS} SELECT l_returnflag, round(count_if(abs(pred - target) <= 20000) / count(pred), 6) AS tp_rate FROM p GROUP BY ALL")
def target_property_rate(spark, sf):
    return _pairs(spark, sf).groupBy("l_returnflag").agg(F.round(M.target_rate(F.col("pred"), F.col("target"), 20000.0), 6).alias("tp_rate"))


@query(f"WITH {PAIRS} SELECT l_linestatus, round(count_if(abs(pred - 30000) <= 10000) / count(pred), 6) AS tp_rate, round(avg(pred), 4) AS mean, round(avg(abs(pred - target)), 4) AS mae FROM p GROUP BY ALL")
def property_columns(spark, sf):
    """Rate against a fixed target, error against each row's own."""
    e = F.abs(F.col("pred") - F.col("target"))
    return _rounded(_pairs(spark, sf).groupBy("l_linestatus").agg(F.round(M.target_rate(F.col("pred"), F.lit(30000.0), 10000.0), 6).alias("tp_rate"), F.avg("pred").alias("mean"), F.avg(e).alias("mae")), 6).withColumn("mean", F.round("mean", 4)).withColumn("mae", F.round("mae", 4))


COND = """count(*) AS n_total, count_if(pred IS NULL)::BIGINT AS n_non_numeric, 0::BIGINT AS n_missing_target, count(pred) AS n_used, round(avg(abs(pred - target)), 4) AS mae,
    round(quantile_cont(abs(pred - target), 0.5), 4) AS median_abs_error, round(sqrt(avg((pred - target) ** 2)), 4) AS rmse, round(avg(pred - target), 4) AS bias,
    round(min(target) FILTER (pred IS NOT NULL), 4) AS target_min, round(max(target) FILTER (pred IS NOT NULL), 4) AS target_max, round(avg(target) FILTER (pred IS NOT NULL), 4) AS target_mean,
    round(count_if(abs(pred - target) <= 5000) / count(pred), 4) AS within_5000, round(count_if(abs(pred - target) <= 25000) / count(pred), 4) AS within_25000"""


@query(f"WITH {PAIRS} SELECT {COND} FROM p")
def conditioning_report(spark, sf):
    return _rounded(M.conditioning_report(_pairs(spark, sf), F.col("pred"), F.col("target"), [25000.0, 5000.0, 5000.0, -1.0]))


@query(f"WITH {PAIRS}, t AS (SELECT unnest([1000.0, 10000.0, 50000.0])::DOUBLE AS tolerance) SELECT tolerance, round(count_if(abs(pred - target) <= tolerance) / count(pred), 6) AS share FROM p, t GROUP BY tolerance")
def tolerance_ladder(spark, sf):
    ladder = [1000.0, 10000.0, 50000.0]
    one = _pairs(spark, sf).agg(F.map_from_arrays(F.array(*[F.lit(t) for t in ladder]), F.array(*[F.round(M.target_rate(F.col("pred"), F.col("target"), t), 6) for t in ladder])).alias("m"))
    return one.select(F.explode("m").alias("tolerance", "share"))


@query(f"WITH {PAIRS}, m AS (SELECT l_partkey, l_suppkey, avg(pred) AS v FROM p GROUP BY ALL) SELECT l_partkey, round(avg(v), 7) AS mean, round(stddev_pop(v), 3) AS std, count(v) AS n_contributing FROM m GROUP BY l_partkey")
def ensemble_mean_std(spark, sf):
    """Suppliers as members, parts as candidates."""
    members = _pairs(spark, sf).groupBy("l_partkey", "l_suppkey").agg(F.avg("pred").alias("v"))
    out = M.ensemble(members, ["l_partkey"], F.col("v"))
    return out.select("l_partkey", F.round("mean", 7).alias("mean"), F.round("std", 3).alias("std"), "n_contributing")


@query(f"WITH {PAIRS}, m AS (SELECT l_partkey, l_suppkey, avg(pred) AS v FROM p GROUP BY ALL), e AS (SELECT l_partkey, stddev_pop(v) AS std, count(v) AS n FROM m GROUP BY ALL) SELECT count(*) AS n_candidates, count_if(n > 1)::BIGINT AS n_spread, round(avg(std) FILTER (n > 1), 3) AS mean_std, round(max(std) FILTER (n > 1), 3) AS max_std FROM e")
def ensemble_spread(spark, sf):
    members = _pairs(spark, sf).groupBy("l_partkey", "l_suppkey").agg(F.avg("pred").alias("v"))
    e = M.ensemble(members, ["l_partkey"], F.col("v"))
    several = F.when(F.col("n_contributing") > 1, F.col("std"))
    return e.agg(F.count(F.lit(1)).alias("n_candidates"), F.count(several).alias("n_spread"), F.round(F.avg(several), 3).alias("mean_std"), F.round(F.max(several), 3).alias("max_std"))


#: Member m of five has seen row i in training if i % 5 = m.
LEAK = f"""{PAIRS}, m AS (SELECT l_orderkey, l_linenumber, target, unnest(range(0, 5)) AS member, pred FROM p WHERE pred IS NOT NULL),
    v AS (SELECT l_orderkey, l_linenumber, target, member, pred * (1 + (member - 2) * 0.01) AS v, l_orderkey % 5 <> member AS clean FROM m),
    g AS (SELECT l_orderkey, l_linenumber, any_value(target) AS target, avg(v) AS all_mean, avg(v) FILTER (clean) AS clean_mean, stddev_pop(v) AS sigma, count_if(clean)::BIGINT AS n_clean FROM v GROUP BY 1, 2)"""


def _members(rows):
    members = rows.withColumn("member", F.explode(F.sequence(F.lit(0), F.lit(4))))
    return members.withColumn("v", F.col("pred") * (F.lit(1) + (F.col("member") - 2) * 0.01)).withColumn("clean", F.col("l_orderkey") % 5 != F.col("member"))


def _leak(spark, sf):
    """A line number may stand in an order more than once. The target is that of its first row in the table, and
    sums run in the table's order, so neither joins nor shuffles nor spills change a result. Only line numbers
    under 7 have a prediction, as in PAIRS."""
    keys = ["l_orderkey", "l_linenumber"]
    lines = placed(table(spark, sf, "lineitem")).where("l_linenumber < 7")
    rows = _pairs(spark, sf, lines).where("pred IS NOT NULL").select(*keys, "target", "pred", "__file", "__row")
    ordered = Window.partitionBy(*keys).orderBy("__file", "__row", "member")
    whole = ordered.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    made = {
        "target": F.first("target", ignorenulls=True),
        "all_mean": F.avg("v"),
        "clean_mean": F.avg(F.when(F.col("clean"), F.col("v"))),
        "sigma": F.stddev_pop("v"),
        "n_clean": F.count_if("clean"),
    }
    v = _members(rows.repartition(*keys)).select(*keys, *[c.over(whole).alias(n) for n, c in made.items()], F.row_number().over(ordered).alias("__n"))
    return v.where("__n = 1").drop("__n")


@query(f"""WITH {LEAK} SELECT round(avg(abs(all_mean - target)), 3) AS contaminated_mae, round(avg(abs(clean_mean - target)), 3) AS honest_mae, round(avg(abs(clean_mean - target)) - avg(abs(all_mean - target)), 3) AS optimism,
    round(avg(sigma), 3) AS mean_sigma, round(corr(sigma, abs(clean_mean - target)), 4) AS sigma_error_corr, count(*) AS n FROM g WHERE n_clean >= 1""")
def ensemble_leakage(spark, sf):
    g = _leak(spark, sf).where("n_clean >= 1")
    bad, good = F.abs(F.col("all_mean") - F.col("target")), F.abs(F.col("clean_mean") - F.col("target"))
    r3 = lambda c: F.round(c, 3)
    return g.agg(r3(F.avg(bad)).alias("contaminated_mae"), r3(F.avg(good)).alias("honest_mae"), r3(F.avg(good) - F.avg(bad)).alias("optimism"), r3(F.avg("sigma")).alias("mean_sigma"), F.round(pearson(F.col("sigma"), good), 4).alias("sigma_error_corr"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {LEAK} SELECT n_clean, count(*) AS n FROM g GROUP BY n_clean")
def clean_mask_join(spark, sf):
    """Histogram of how many members are clean for a row."""
    members = _members(_pairs(spark, sf).where("pred IS NOT NULL").select("l_orderkey", "l_linenumber", "pred"))
    return members.groupBy("l_orderkey", "l_linenumber").agg(F.count_if("clean").alias("n_clean")).groupBy("n_clean").agg(F.count(F.lit(1)).alias("n"))


RES = f"{PAIRS}, r AS (SELECT l_returnflag, abs(pred - target) AS r, l_orderkey FROM p WHERE pred IS NOT NULL)"


def _residuals(spark, sf):
    return _pairs(spark, sf).where("pred IS NOT NULL").withColumn("r", F.abs(F.col("pred") - F.col("target")))


@query(f"WITH {RES}, n AS (SELECT count(*) AS n, ceil((count(*) + 1) * 0.9 - 1e-9)::BIGINT AS k FROM r), o AS (SELECT r, row_number() OVER (ORDER BY r) AS i FROM r) SELECT n, k, round(r, 4) AS quantile FROM n LEFT JOIN o ON i = k")
def conformal_quantile(spark, sf):
    return M.conformal_quantile(_residuals(spark, sf), "r", 0.1).withColumn("quantile", F.round("quantile", 4))


@query(f"""WITH {RES}, n AS (SELECT l_returnflag, count(*) AS n, ceil((count(*) + 1) * 0.8 - 1e-9)::BIGINT AS k FROM r WHERE l_orderkey % 2 = 0 GROUP BY 1), o AS (SELECT l_returnflag, r, row_number() OVER (PARTITION BY l_returnflag ORDER BY r) AS i FROM r WHERE l_orderkey % 2 = 0),
    q AS (SELECT l_returnflag, r AS q FROM n JOIN o USING (l_returnflag) WHERE i = k), c AS (SELECT l_returnflag, count(*) AS n, count_if(r <= q)::BIGINT AS hits, any_value(q) AS q FROM r JOIN q USING (l_returnflag) WHERE l_orderkey % 2 = 1 GROUP BY 1)
    SELECT l_returnflag, n, hits, round(hits / n, 6) AS coverage, round(2 * q, 4) AS width, round(greatest(0, hits / n - 1.96 * sqrt(hits / n * (1 - hits / n) / n)), 6) AS ci_low, round(least(1, hits / n + 1.96 * sqrt(hits / n * (1 - hits / n) / n)), 6) AS ci_high FROM c""")
def conformal_coverage(spark, sf):
    """Even orders calibrate, odd ones are covered or not; bounds are inclusive."""
    rows = _residuals(spark, sf)
    q = M.conformal_quantile(rows.where("l_orderkey % 2 = 0"), "r", 0.2, ["l_returnflag"]).select("l_returnflag", F.col("quantile").alias("q"))
    got = rows.where("l_orderkey % 2 = 1").join(F.broadcast(q), "l_returnflag").groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("r") <= F.col("q")).alias("hits"), F.first("q").alias("q"))
    p = F.col("hits") / F.col("n")
    wald = F.lit(1.96) * F.sqrt(p * (1 - p) / F.col("n"))
    return got.select("l_returnflag", "n", "hits", F.round(p, 6).alias("coverage"), F.round(2 * F.col("q"), 4).alias("width"), F.round(F.greatest(F.lit(0.0), p - wald), 6).alias("ci_low"), F.round(F.least(F.lit(1.0), p + wald), 6).alias("ci_high"))


@query(f"""WITH {PAIRS}, r AS (SELECT l_partkey, avg(abs(pred - target)) AS r FROM p WHERE pred IS NOT NULL GROUP BY 1), s AS (SELECT r.*, t AS rep, md5('rep' || t || ':' || l_partkey) < '8' AS cal FROM r, (SELECT unnest(range(0, 200)) AS t)),
    n AS (SELECT rep, ceil((count(*) + 1) * 0.9 - 1e-9)::BIGINT AS k FROM s WHERE cal GROUP BY rep), o AS (SELECT rep, r, row_number() OVER (PARTITION BY rep ORDER BY r) AS i FROM s WHERE cal), q AS (SELECT rep, r AS q FROM o JOIN n USING (rep) WHERE i = k),
    c AS (SELECT rep, avg((r <= q)::INT) AS coverage, any_value(q) AS q FROM s JOIN q USING (rep) WHERE NOT cal GROUP BY rep), w AS (SELECT coverage, row_number() OVER (ORDER BY coverage) AS i, q FROM c)
    SELECT count(*) AS n_repeats, round(avg(coverage), 6) AS mean_coverage, round(avg(q), 3) AS mean_half_width, round(max(coverage) FILTER (i = 11), 6) AS p05, round(max(coverage) FILTER (i = 190), 6) AS p95 FROM w""")
def conformal_repeated(spark, sf):
    """Two hundred random calibration halves of the parts' mean residuals."""
    units = _residuals(spark, sf).groupBy("l_partkey").agg(F.avg("r").alias("r"))
    rows = materialise(units, "residuals").withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(199))))
    rows = rows.withColumn("cal", F.md5(F.concat(F.lit("rep"), F.col("rep").cast("string"), F.lit(":"), F.col("l_partkey").cast("string"))) < "8")
    q = M.conformal_quantile(rows.where("cal"), "r", 0.1, ["rep"]).select("rep", F.col("quantile").alias("q")).where("q IS NOT NULL")
    c = rows.where("NOT cal").join(F.broadcast(q), "rep").groupBy("rep").agg(F.avg((F.col("r") <= F.col("q")).cast("int")).alias("coverage"), F.first("q").alias("q"))
    s = F.sort_array(F.collect_list("coverage"))
    return c.agg(F.count(F.lit(1)).alias("n_repeats"), F.round(F.avg("coverage"), 6).alias("mean_coverage"), F.round(F.avg("q"), 3).alias("mean_half_width"), F.round(F.try_element_at(s, F.lit(11)), 6).alias("p05"), F.round(F.try_element_at(s, F.lit(190)), 6).alias("p95"))


@query(f"WITH {PAIRS} SELECT round(covar_pop(target, pred) / var_pop(target) FILTER (pred IS NOT NULL), 6) AS slope, round(avg(pred) - covar_pop(target, pred) / var_pop(target) FILTER (pred IS NOT NULL) * (avg(target) FILTER (pred IS NOT NULL)), 3) AS intercept, round(greatest(150, least(900, avg(pred))), 3) AS prompt FROM p")
def conditioning_slope(spark, sf):
    """Least squares of output on target, and a prompt clamped to its range."""
    b, a = slope(F.col("pred"), F.col("target"))
    return _pairs(spark, sf).where("pred IS NOT NULL").agg(F.round(b, 6).alias("slope"), F.round(a, 3).alias("intercept"), F.round(F.greatest(F.lit(150.0), F.least(F.lit(900.0), F.avg("pred"))), 3).alias("prompt"))


@query(f"WITH {PAIRS} SELECT l_returnflag, round(sum(h) / sum(n), 6) AS rate FROM (SELECT l_returnflag, l_linestatus, count_if(abs(pred - target) <= 10000) AS h, count(pred) AS n FROM p GROUP BY 1, 2) GROUP BY 1")
def pooled_rates(spark, sf):
    """Hits and denominators are pooled before the division: not a mean of rates."""
    hit = F.abs(F.col("pred") - F.col("target")) <= 10000
    g = _pairs(spark, sf).groupBy("l_returnflag", "l_linestatus").agg(F.count_if(hit).alias("h"), F.count("pred").alias("n"))
    return g.groupBy("l_returnflag").agg(F.round(safe_ratio(F.sum("h"), F.sum("n")), 6).alias("rate"))


@query("SELECT round(sum(l_extendedprice * l_quantity) / greatest(sum(l_quantity), 1), 4) AS loss, l_linestatus FROM lineitem GROUP BY l_linestatus")
def token_weighted_mean(spark, sf):
    lines = table(spark, sf, "lineitem")
    return lines.groupBy("l_linestatus").agg(F.round(F.sum(F.col("l_extendedprice") * F.col("l_quantity")) / F.greatest(F.sum("l_quantity"), F.lit(1.0)), 4).alias("loss"))


@query(f"SELECT lang, count(*) AS n_total, count(DISTINCT c) AS n_unique, round(count(DISTINCT c) / count(*), 6) AS unique_fraction, max(k)::BIGINT AS most_common_count, round(max(k) / count(*), 6) AS most_common_fraction FROM (SELECT lang, c, count(*) OVER (PARTITION BY lang, c) AS k FROM (SELECT lang, {Q.canonical('text')} AS c FROM documents)) GROUP BY lang")
def diversity(spark, sf):
    docs = table(spark, sf, "documents").select("lang", X.canonical(F.col("text")).alias("c"))
    return _rounded(M.diversity(docs, "c", ["lang"]), 6)


SAMPLE = "SELECT vec_id, embedding FROM embeddings ORDER BY md5('sample:' || vec_id), vec_id"


def _sample(spark, sf, n):
    """A seeded sample of n vectors."""
    h = F.md5(F.concat(F.lit("sample:"), F.col("vec_id").cast("string")))
    return table(spark, sf, "embeddings").select("vec_id", "embedding", h.alias("h")).orderBy("h", "vec_id").limit(n).select("vec_id", "embedding")


COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(f"SELECT count(*) AS n_pairs, round(avg({COS}), 5) AS mean_similarity FROM ({SAMPLE} LIMIT 200) a JOIN ({SAMPLE} LIMIT 200) b ON a.vec_id < b.vec_id")
def pairwise_similarity(spark, sf):
    """All pairs of a seeded sample of two hundred, which is the operator's definition."""
    v = _sample(spark, sf, 200)
    a, b = v.alias("a"), F.broadcast(v).alias("b")
    pairs = a.join(b, F.col("a.vec_id") < F.col("b.vec_id")).withColumn("s", M.cosine("a.embedding", "b.embedding"))
    return pairs.agg(F.count(F.lit(1)).alias("n_pairs"), F.round(F.avg("s"), 5).alias("mean_similarity"))


#: Vectors of the reference at most.
REFERENCE = 20_000
NEAREST = f"SELECT a.vec_id, max({COS}) AS nearest FROM embeddings a, (SELECT * FROM embeddings WHERE label % 2 = 0 ORDER BY md5('sample:' || vec_id), vec_id LIMIT {REFERENCE}) b WHERE a.label % 2 = 1 GROUP BY a.vec_id"


def _nearest(spark, sf):
    """Best similarity of the vectors of odd labels to those of even ones."""
    vectors = table(spark, sf, "embeddings")
    return M.nearest_of(vectors.where("label % 2 = 1"), vectors.where("label % 2 = 0"), "vec_id", "embedding", REFERENCE)


@query(f"SELECT vec_id, round(nearest, 5) AS nearest FROM ({NEAREST})")
def nearest_reference(spark, sf):
    return _nearest(spark, sf).select("vec_id", F.round("nearest", 5).alias("nearest"))


@query(f"WITH s AS (SELECT nearest, row_number() OVER (ORDER BY nearest) AS i, count(*) OVER () AS n FROM ({NEAREST})) SELECT round(avg(nearest), 5) AS mean, round(max(nearest) FILTER (i = round_even(0.9 * (n - 1), 0) + 1), 5) AS p90, round(avg((nearest >= 0.9)::INT), 6) AS near_copy_fraction FROM s")
def drift_stats(spark, sf):
    """Mean, nearest-rank 90 % point and share of near copies of the similarities."""
    rows = _nearest(spark, sf).where(is_finite(F.col("nearest")))
    one = rows.agg(F.round(F.avg("nearest"), 5).alias("mean"), F.round(F.avg((F.col("nearest") >= 0.9).cast("int")), 6).alias("near_copy_fraction"))
    p90 = M.nearest_rank(rows, "nearest", 0.9).select(F.round("value", 5).alias("p90"))
    return one.crossJoin(F.broadcast(p90)).select("mean", "p90", "near_copy_fraction")


@query("SELECT round(avg(len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))), 6) AS mean_tanimoto, count(*) AS n FROM (SELECT list_distinct(string_split(a.text, ' ')) AS x, list_distinct(string_split(b.text, ' ')) AS y FROM conversations a JOIN conversations b ON a.conv_id = b.conv_id AND a.turn + 1 = b.turn)")
def tanimoto(spark, sf):
    """Shared words of neighbouring turns."""
    t = table(spark, sf, "conversations").select("conv_id", "turn", F.array_distinct(F.split("text", " ")).alias("w"))
    pairs = t.alias("a").join(t.alias("b"), (F.col("a.conv_id") == F.col("b.conv_id")) & (F.col("a.turn") + 1 == F.col("b.turn")))
    return pairs.agg(F.round(F.avg(M.tanimoto("a.w", "b.w")), 6).alias("mean_tanimoto"), F.count(F.lit(1)).alias("n"))


@query(f"""WITH {SCREENED}, uu AS (SELECT count(DISTINCT canonical) FILTER (passed_sv) AS n_unique, count(DISTINCT canonical) FILTER (passed_sv AND NOT known) AS n_novel FROM s)
    SELECT count(*) AS n_generated, count_if(passed_sv)::BIGINT AS n_sv, n_unique, n_novel, round(1 - n_unique / count_if(passed_sv), 6) AS duplicate_rate, round(avg(n_chars) FILTER (passed_pv), 4) AS mean_chars,
    round(median(n_chars) FILTER (passed_pv), 4) AS median_chars, round(stddev_pop(n_chars) FILTER (passed_pv), 4) AS std_chars, round(count_if(passed_pv AND n_chars > 5000) / count_if(passed_pv), 6) AS frac_long FROM s, uu GROUP BY n_unique, n_novel""")
def generation_report(spark, sf):
    """Counts and rates of a screened batch, and a property of the full passes (population std)."""
    rows = _screened(spark, sf)
    full = F.when(F.col("passed_pv"), F.col("n_chars").cast("double"))
    n_sv, uniq = F.count_if("passed_sv"), F.count_distinct(F.when(F.col("passed_sv"), F.col("canonical")))
    return rows.agg(
        F.count(F.lit(1)).alias("n_generated"), n_sv.alias("n_sv"), uniq.alias("n_unique"), F.count_distinct(F.when(F.col("passed_tsd"), F.col("canonical"))).alias("n_novel"), F.round(F.lit(1.0) - safe_ratio(uniq, n_sv), 6).alias("duplicate_rate"),
        F.round(F.avg(full), 4).alias("mean_chars"), F.round(F.median(full), 4).alias("median_chars"), F.round(F.stddev_pop(full), 4).alias("std_chars"), F.round(safe_ratio(F.count_if(full > 5000), F.count(full)), 6).alias("frac_long"),
    )


@query(f"""WITH {SCREENED} SELECT count(*) AS n_generated, count_if(passed_sv)::BIGINT AS n_valid, count(DISTINCT canonical) FILTER (passed_sv) AS n_unique, count(DISTINCT canonical) FILTER (passed_tsd) AS n_novel,
    round(count_if(passed_sv) / count(*), 6) AS validity, round(count(DISTINCT canonical) FILTER (passed_sv) / count_if(passed_sv), 6) AS uniqueness, round(count(DISTINCT canonical) FILTER (passed_tsd) / count(DISTINCT canonical) FILTER (passed_sv), 6) AS novelty FROM s""")
def chem_metrics(spark, sf):
    """Rates with denominators of their own: all, valid, unique."""
    rows = _screened(spark, sf)
    n_valid, uniq, new = F.count_if("passed_sv"), F.count_distinct(F.when(F.col("passed_sv"), F.col("canonical"))), F.count_distinct(F.when(F.col("passed_tsd"), F.col("canonical")))
    return rows.agg(F.count(F.lit(1)).alias("n_generated"), n_valid.alias("n_valid"), uniq.alias("n_unique"), new.alias("n_novel")).select("*", F.round(safe_ratio(F.col("n_valid"), F.col("n_generated")), 6).alias("validity"), F.round(safe_ratio(F.col("n_unique"), F.col("n_valid")), 6).alias("uniqueness"), F.round(safe_ratio(F.col("n_novel"), F.col("n_unique")), 6).alias("novelty"))


@query(f"WITH {SCREENED} SELECT source, lang, {COUNTS}, round(avg(n_chars), 4) AS mean_length FROM s GROUP BY ALL")
def sweep_point(spark, sf):
    """One row for each configuration of a sweep (source and lang stand for it)."""
    from ..operators.screen import cascade_counts

    rows = _screened(spark, sf)
    length = rows.groupBy("source", "lang").agg(F.round(F.avg("n_chars"), 4).alias("mean_length"))
    return cascade_counts(rows, ["source", "lang"]).join(length, ["source", "lang"])


@query(f"""WITH t AS (SELECT DISTINCT l_shipdate::DATE::VARCHAR || l_returnflag AS text FROM lineitem UNION SELECT DISTINCT p_brand FROM part)
    SELECT text, array_to_string(list_sort(list_distinct(list_transform(range(1, length(text) - 1), lambda i: {Q.md5_long('substr(text, i, 3)')} % 2048))), ' ') AS bits FROM t WHERE length(text) >= 10""")
def reference_fps(spark, sf):
    """Fingerprints of a reference's texts (here bits of hashed trigrams); short texts have none."""

    def trigrams(c):
        at = F.sequence(F.lit(1), F.length(c) - 2)
        return F.when(F.length(c) >= 10, F.sort_array(F.array_distinct(F.transform(at, lambda i: X.md5_long(c.substr(i, F.lit(3))) % 2048))))

    dated = table(spark, sf, "lineitem").select(F.concat(F.col("l_shipdate").cast("date").cast("string"), "l_returnflag").alias("t"))
    texts = dated.unionByName(table(spark, sf, "part").select(F.col("p_brand").alias("t")))
    fps = M.reference_fingerprints(texts, F.col("t"), trigrams)
    return fps.select("text", F.array_join(F.transform("bits", lambda b: b.cast("string")), " ").alias("bits"))
