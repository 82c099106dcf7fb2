"""Queries that judge arms: line status and return flag stand for arms, the order key's remainder for
seeds."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.numbers import all_measured, safe_ratio
from ..operators import compare as K
from ..operators import loaders as L
from ..operators import metrics as M
from ..registry import query, table
from ..sources.scratch import materialise, scratch
from . import sql as Q
from .corpus import COUNTS, SCREENED, _screened
from .metrics import PAIRS, REPORT, _pairs, _rounded

REPEATS = 40
UNIT = Q.md5_unit("'boot:' || rep || ':' || k")
#: Cumulative probabilities of a Poisson(1) count.
STEPS = []
_p = _t = 0.36787944117144233
for _k in range(1, 13):
    STEPS.append(_t)
    _p = _p / _k
    _t = _t + _p
WEIGHT = " + ".join(f"(u >= {t!r})::INT" for t in STEPS)
BOOT = f"""r AS (SELECT l_returnflag AS arm, l_orderkey AS k, avg(l_discount) AS v FROM lineitem GROUP BY ALL),
    u AS (SELECT arm, rep, v, {UNIT} AS u FROM r, (SELECT unnest(range(0, {REPEATS})) AS rep)), w AS (SELECT arm, rep, v, {WEIGHT} AS w FROM u), m AS (SELECT arm, rep, sum(w * v) / sum(w) AS mean FROM w GROUP BY ALL),
    o AS (SELECT arm, avg(v) AS mean FROM r GROUP BY arm), d AS (SELECT m.arm, m.mean - b.mean AS d FROM m JOIN m b ON m.rep = b.rep AND b.arm = 'A' WHERE m.arm <> 'A'),
    c AS (SELECT arm, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high FROM d GROUP BY arm), x AS (SELECT o.arm, o.mean - b.mean AS delta, low, high FROM o JOIN c ON o.arm = c.arm, o b WHERE b.arm = 'A')"""


def _deltas(spark, sf):
    """Orders are the units that are resampled."""
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("arm"), F.col("l_orderkey").alias("k")).agg(F.avg("l_discount").alias("v"))
    rows = materialise(rows, "units")
    means = K.bootstrap_means(rows, ["arm"], F.col("k"), F.col("v"), REPEATS, "boot")
    return K.bootstrap_delta(means, rows.groupBy("arm").agg(F.avg("v").alias("mean")), "arm", "A")


@query(f"WITH {BOOT} SELECT arm, round(delta, 6) AS delta, round(low, 6) AS low, round(high, 6) AS high FROM x")
def bootstrap_delta_hash(spark, sf):
    return _rounded(_deltas(spark, sf), 6)


@query(f"WITH {BOOT} SELECT arm, delta >= 0.0001 AND low > 0 AS beats FROM x")
def success_verdict(spark, sf):
    return K.success(_deltas(spark, sf), 0.0001).select("arm", "beats")


SEEDS = "s AS (SELECT l_returnflag || l_linestatus AS arm, CASE WHEN l_linestatus = 'F' THEN l_orderkey % 3 ELSE 0 END AS seed, avg(l_discount) AS m FROM lineitem GROUP BY ALL)"


def _seeds(spark, sf):
    lines = table(spark, sf, "lineitem").withColumn("arm", F.concat("l_returnflag", "l_linestatus")).withColumn("seed", F.when(F.col("l_linestatus") == "F", F.col("l_orderkey") % 3).otherwise(0))
    return lines.groupBy("arm", "seed").agg(F.avg("l_discount").alias("m"))


@query(f"WITH {SEEDS} SELECT arm, count(m) AS n_seeds, round(avg(m), 6) AS mean, round(stddev_samp(m), 6) AS std, string_agg(seed, ',' ORDER BY seed) AS seeds FROM s GROUP BY arm")
def seed_aggregate(spark, sf):
    return _rounded(K.seed_aggregate(_seeds(spark, sf), "arm", "seed", "m"), 6)


MARGIN = f"{SEEDS}, b AS (SELECT avg(m) AS b FROM s), e AS (SELECT arm, CASE WHEN arm = 'NF' AND seed = 1 THEN NULL ELSE m - b END AS d FROM s, b), g AS (SELECT arm, avg(d) AS m, min(d) AS least, count(d) AS k, count(*) AS n FROM e GROUP BY arm)"


@query(f"WITH {MARGIN}, h AS (SELECT arm, CASE WHEN k > 0 THEN m >= 0 END AS mean_beats, CASE WHEN k = n THEN least >= 0 END AS unanimous FROM g) SELECT *, CASE WHEN mean_beats IS NOT NULL AND unanimous IS NOT NULL THEN mean_beats AND unanimous END AS combined FROM h")
def across_seed(spark, sf):
    """One seed of one arm is unmeasured, so its verdicts are unknown rather than false."""
    s = _seeds(spark, sf)
    b = s.agg(F.avg("m").alias("b"))
    d = s.crossJoin(F.broadcast(b)).select("arm", F.when(~((F.col("arm") == "NF") & (F.col("seed") == 1)), F.col("m") - F.col("b")).alias("d"))
    return K.across_seeds(d, "arm", "d", 0.0)


@query(f"WITH {MARGIN} SELECT arm, CASE WHEN k > 0 THEN least >= -0.001 END AS unanimous FROM g")
def unanimous(spark, sf):
    """Whether every measured seed reaches the margin by itself; unknown without a measured seed."""
    s = _seeds(spark, sf)
    d = s.crossJoin(F.broadcast(s.agg(F.avg("m").alias("b")))).select("arm", F.when(~((F.col("arm") == "NF") & (F.col("seed") == 1)), F.col("m") - F.col("b")).alias("d"))
    return K.unanimous(d, "arm", "d", -0.001)


@query(f"""WITH {SEEDS}, g AS (SELECT arm, count(m) AS n, string_agg(seed, ',' ORDER BY seed) AS seeds, avg(m) AS mean, stddev_samp(m) AS std, min(m) >= 0.0498 AS every FROM s GROUP BY arm)
    SELECT 0::BIGINT AS pos, '| arm | n_seeds | seeds | mean | spread | unanimous |' AS line UNION ALL SELECT 1, '|---:|---:|---:|---:|---:|---:|'
    UNION ALL SELECT row_number() OVER (ORDER BY arm) + 1, '| ' || arm || ' | ' || n || ' | ' || seeds || ' | ' || printf('%.4f', mean) || ' | ' || CASE WHEN n > 1 THEN printf('%.4f', std) ELSE '1 seed' END || ' | ' || CASE WHEN every THEN 'yes' ELSE 'no' END || ' |' FROM g""")
def seed_summary_md(spark, sf):
    """A table's lines, a row an arm; the spread of one seed is said in words, never zero."""
    s = _seeds(spark, sf)
    every = K.unanimous(s.withColumn("d", F.col("m") - 0.0498), "arm", "d", 0.0)
    rows = K.seed_aggregate(s, "arm", "seed", "m").join(every, "arm")
    spread = F.when(F.col("n_seeds") > 1, _cell(F.col("std"), "double")).otherwise("1 seed")
    cells = [F.col("arm"), F.col("n_seeds").cast("string"), F.col("seeds"), _cell(F.col("mean"), "double"), spread, _cell(F.col("unanimous"), "boolean")]
    body = rows.select((F.row_number().over(Window.orderBy("arm")) + 1).cast("long").alias("pos"), F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))
    head = ["arm", "n_seeds", "seeds", "mean", "spread", "unanimous"]
    return spark.createDataFrame([(0, f"| {' | '.join(head)} |"), (1, f"|{'---:|' * len(head)}")], "pos long, line string").unionByName(body)


ARMS = "a AS (SELECT l_returnflag || l_linestatus AS arm, avg(l_discount) AS m FROM lineitem GROUP BY 1 UNION ALL SELECT 'A9', NULL)"


def _arms(spark, sf):
    means = table(spark, sf, "lineitem").groupBy(F.concat("l_returnflag", "l_linestatus").alias("arm")).agg(F.avg("l_discount").alias("m"))
    return means.unionByName(spark.createDataFrame([("A9", None)], "arm string, m double"))


@query(f"WITH {ARMS} SELECT arm, round(m, 6) AS mean, round(m - 0.05, 6) AS delta, CASE WHEN m IS NULL THEN 'not run' WHEN m < 0.05 - 0.0001 THEN 'helps' WHEN m > 0.05 + 0.0001 THEN 'hurts' ELSE 'no effect' END AS verdict FROM a")
def ablation_matrix(spark, sf):
    return _rounded(K.ablation(_arms(spark, sf), "arm", "m", 0.05, 0.0001), 6)


@query(f"WITH {ARMS} SELECT arm, CASE WHEN m IS NULL THEN 'not measured' WHEN m - 0.05 < -0.0001 THEN 'regressed' WHEN m - 0.05 > 0.0001 THEN 'improved' ELSE 'no regression' END AS said FROM a")
def regression_check(spark, sf):
    return _arms(spark, sf).select("arm", K.regression_check(F.col("m") - 0.05, 0.0001).alias("said"))


@query(f"WITH {ARMS} SELECT arm, CASE WHEN m IS NULL THEN 'not_run' ELSE 'compared' END AS status, abs(m - 0.05) > 0.0001 AS diverges FROM a")
def b0_vs_frozen(spark, sf):
    return _arms(spark, sf).select("arm", F.when(F.col("m").isNull(), "not_run").otherwise("compared").alias("status"), (F.abs(F.col("m") - 0.05) > 0.0001).alias("diverges"))


@query(f"WITH {ARMS}, b AS (SELECT m AS b FROM a WHERE arm = 'AF') SELECT arm, round(m - b, 6) AS delta FROM a, b")
def baseline_cross_join(spark, sf):
    """Every arm beside the single baseline row."""
    arms = _arms(spark, sf)
    return arms.crossJoin(F.broadcast(arms.where("arm = 'AF'").select(F.col("m").alias("b")))).select("arm", F.round(F.col("m") - F.col("b"), 6).alias("delta"))


@query(f"WITH {ARMS} SELECT p.arm, round(a.m, 6) AS m, a.m IS NULL AS placeholder FROM (VALUES ('AF'), ('NF'), ('NO'), ('RF'), ('A9'), ('B7')) p(arm) LEFT JOIN a USING (arm)")
def placeholder_row(spark, sf):
    """Planned arms without a run keep their row, all measures null."""
    planned = spark.createDataFrame([(x,) for x in ("AF", "NF", "NO", "RF", "A9", "B7")], "arm string")
    return planned.join(F.broadcast(_arms(spark, sf)), "arm", "left").select("arm", F.round("m", 6).alias("m"), F.col("m").isNull().alias("placeholder"))


CRITERIA = [("pv_rate", 0.3, 0.3), ("tp_rate", 0.5, 0.55), ("mae", 28.7, None), ("margin", None, 0.01)]
CODED = ", ".join(f"('{n}', {a})" for n, a, _ in CRITERIA if a is not None)
FROZEN = ", ".join(f"('{n}', {b})" for n, _, b in CRITERIA if b is not None)


@query(f"SELECT coalesce(a.k, b.k) AS name, a.v::DOUBLE AS coded, b.v::DOUBLE AS frozen FROM (VALUES {CODED}) a(k, v) FULL JOIN (VALUES {FROZEN}) b(k, v) ON a.k = b.k WHERE a.v IS DISTINCT FROM b.v")
def prereg_diff(spark, sf):
    """Criteria in which code and frozen record differ, missing ones included."""
    a = spark.createDataFrame([(n, x) for n, x, _ in CRITERIA if x is not None], "k string, a double")
    b = spark.createDataFrame([(n, y) for n, _, y in CRITERIA if y is not None], "k string, b double")
    return a.join(b, "k", "full").where(~F.col("a").eqNullSafe(F.col("b"))).select(F.col("k").alias("name"), F.col("a").alias("coded"), F.col("b").alias("frozen"))


@query(f"SELECT k AS name, 'coded' AS side FROM (SELECT k FROM (VALUES {CODED}) a(k, v) EXCEPT SELECT k FROM (VALUES {FROZEN}) b(k, v)) UNION ALL SELECT k, 'frozen' FROM (SELECT k FROM (VALUES {FROZEN}) b(k, v) EXCEPT SELECT k FROM (VALUES {CODED}) a(k, v))")
def sym_diff_config(spark, sf):
    a = spark.createDataFrame([(n,) for n, x, _ in CRITERIA if x is not None], "name string")
    b = spark.createDataFrame([(n,) for n, _, y in CRITERIA if y is not None], "name string")
    return a.exceptAll(b).withColumn("side", F.lit("coded")).unionByName(b.exceptAll(a).withColumn("side", F.lit("frozen")))


def _cell(c, kind):
    if kind == "double":
        return F.when(c.isNull(), "n/a").otherwise(F.format_string("%.4f", c))
    if kind == "boolean":
        return F.when(c.isNull(), "n/a").when(c, "yes").otherwise("no")
    return F.coalesce(c.cast("string"), F.lit("n/a"))


@query(f"WITH {ARMS} SELECT '| ' || arm || ' | ' || CASE WHEN m IS NULL THEN 'n/a' ELSE printf('%.4f', m) END || ' | ' || CASE WHEN m IS NULL THEN 'n/a' WHEN m > 0.05 THEN 'yes' ELSE 'no' END || ' |' AS line FROM a")
def matrix_md(spark, sf):
    """A table's lines: unmeasured as n/a, flags as yes and no, numbers with four decimals."""
    rows = _arms(spark, sf).withColumn("above", F.col("m") > 0.05)
    cells = [_cell(F.col(c), t) for c, t in rows.dtypes]
    return rows.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"))


@query(f"WITH {ARMS} SELECT 'arm,m,above' AS line UNION ALL SELECT arm || ',' || coalesce(printf('%.6f', m), '') || ',' || coalesce(CASE WHEN m > 0.05 THEN 'true' ELSE 'false' END, '') FROM a WHERE m IS NOT NULL UNION ALL SELECT arm || ',,' FROM a WHERE m IS NULL")
def matrix_csv(spark, sf):
    """The matrix written as CSV in a fixed order of columns and read back as lines; unmeasured is empty."""
    path = scratch(spark, "matrix")
    rows = _arms(spark, sf).select("arm", F.format_string("%.6f", "m").alias("m"), (F.col("m") > 0.05).alias("above"))
    rows = rows.withColumn("m", F.when(F.col("above").isNotNull(), F.col("m")))
    rows.coalesce(1).write.option("header", True).option("nullValue", "").option("emptyValue", "").csv(path)
    return spark.read.text(path).withColumnRenamed("value", "line")


def _lines(one, rows):
    """A record's rows as fixed-width lines: (label, width, format, expression) each."""
    said = [F.concat(F.rpad(F.lit(label), width, " "), F.format_string(form, value)) for label, width, form, value in rows]
    return one.select(F.posexplode(F.array(*said)).alias("pos", "line")).select(F.col("pos").cast("long").alias("pos"), "line")


def _lines_sql(rows):
    return " UNION ALL ".join(f"SELECT {i}::BIGINT AS pos, rpad('{label}', {width}, ' ') || printf('{form}', {value}) AS line FROM one" for i, (label, width, form, value) in enumerate(rows))


CASCADE_LINES = [("generated", 26, "%10d", "n_input")] + [(label, 26, "%9.1f%%", f"{n}_rate * 100") for n, label in (("sv", "SV   valid structures"), ("tsd", "TSD  not in training"), ("dd", "DD   unique in batch"), ("pv", "PV   structural rule"))]
CASCADE_COUNTS = [(label, 26, "%10d", f"n_{n}") for n, label in (("sv", "SV   count"), ("tsd", "TSD  count"), ("dd", "DD   count"), ("pv", "PV   count"))]


@query(f"WITH {SCREENED}, one AS (SELECT {COUNTS} FROM s) {_lines_sql(CASCADE_LINES + CASCADE_COUNTS)}")
def console_summary(spark, sf):
    """The cascade as fixed-width lines: each stage's share of the raw batch, then its count."""
    from ..operators import screen as S

    rows = [(label, width, form, F.expr(value)) for label, width, form, value in CASCADE_LINES + CASCADE_COUNTS]
    return _lines(S.cascade_counts(_screened(spark, sf)), rows)


CONDITIONING = [("scored candidates", 34, "%10d", "n_valid"), ("no prediction (skipped)", 34, "%10d", "n_non_numeric"), ("MAE vs own target", 34, "%10.1f K", "mae"), ("RMSE", 34, "%10.1f K", "rmse")]


@query(f"WITH {PAIRS}, one AS (SELECT {REPORT} FROM p) {_lines_sql(CONDITIONING)}")
def conditioning_text(spark, sf):
    """Errors against each row's own target as fixed-width lines."""
    report = _rounded(M.regression_report(_pairs(spark, sf), F.col("target"), F.col("pred")))
    return _lines(report, [(label, width, form, F.expr(value)) for label, width, form, value in CONDITIONING])


@query(f"WITH {ARMS} SELECT rpad(arm, 8, ' ') || lpad(CASE WHEN m IS NULL THEN 'n/a' ELSE printf('%.4f', m) END, 10, ' ') AS line FROM a")
def ablation_text(spark, sf):
    """Fixed-width lines."""
    return _arms(spark, sf).select(F.concat(F.rpad("arm", 8, " "), F.lpad(_cell(F.col("m"), "double"), 10, " ")).alias("line"))


#: The grid in its nesting order: epochs, then top_p, then temperature.
GRID = "(SELECT e, p, t, (e - 1) * 9 + ((p * 20)::INT - 18) * 3 + (t * 2)::INT AS pos FROM (VALUES (1), (2)) e(e), (VALUES (0.9), (0.95), (1.0)) p(p), (VALUES (0.5), (1.0), (1.5)) t(t))"


def _grid(spark):
    axis = lambda name, values: spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"{name}_i int, {name} double")
    g = axis("epoch", [1.0, 2.0]).crossJoin(F.broadcast(axis("top_p", [0.9, 0.95, 1.0]))).crossJoin(F.broadcast(axis("temperature", [0.5, 1.0, 1.5])))
    pos = F.col("epoch_i") * 9 + F.col("top_p_i") * 3 + F.col("temperature_i") + 1
    return g.select(pos.cast("long").alias("pos"), F.col("epoch").cast("long").alias("epoch"), "top_p", "temperature")


@query(f"SELECT row_number() OVER (ORDER BY e, p, t) AS pos, e::BIGINT AS epoch, p::DOUBLE AS top_p, t::DOUBLE AS temperature FROM {GRID}")
def sweep_grid(spark, sf):
    return _grid(spark)


SCORES = f"g AS (SELECT row_number() OVER (ORDER BY e, p, t) AS pos FROM {GRID}), s AS (SELECT l_orderkey % 18 + 1 AS pos, round(avg((l_discount > 0.05)::INT), 2) AS pv, avg((l_tax > 0.04)::INT) AS dup FROM lineitem GROUP BY 1), r AS (SELECT g.pos, CASE WHEN g.pos <= 15 THEN pv END AS pv, CASE WHEN g.pos <= 15 THEN dup END AS dup FROM g LEFT JOIN s USING (pos))"


def _scores(spark, sf):
    """Scores of the grid's points, of which the last three are unmeasured."""
    s = table(spark, sf, "lineitem").groupBy((F.col("l_orderkey") % 18 + 1).alias("pos")).agg(F.round(F.avg((F.col("l_discount") > 0.05).cast("int")), 2).alias("pv"), F.avg((F.col("l_tax") > 0.04).cast("int")).alias("dup"))
    done = F.col("pos") <= 15
    return _grid(spark).join(s, "pos", "left").withColumn("pv", F.when(done, F.col("pv"))).withColumn("dup", F.when(done, F.col("dup")))


@query(f"WITH {SCORES} SELECT pos, pv FROM r WHERE pv IS NOT NULL ORDER BY pv DESC, pos LIMIT 1")
def select_best(spark, sf):
    """Ties go to the first; unmeasured points never win."""
    return _scores(spark, sf).where("pv IS NOT NULL").orderBy(F.desc("pv"), "pos").limit(1).select("pos", "pv")


@query(f"WITH {SCORES} SELECT pos, round(pv * (1 - dup), 6) AS composite FROM r")
def objectives(spark, sf):
    return _scores(spark, sf).select("pos", F.round(F.col("pv") * (1 - F.col("dup")), 6).alias("composite"))


@query(f"WITH {SCORES} SELECT pos, pv FROM r ORDER BY pv DESC NULLS LAST, pos")
def sort_desc_null_last(spark, sf):
    return _scores(spark, sf).orderBy(F.col("pv").desc_nulls_last(), "pos").select("pos", "pv")


@query(f"WITH {SCORES} SELECT pos, pv FROM r ORDER BY pv IS NULL, pv DESC, pos LIMIT 5")
def sweep_top5(spark, sf):
    return _scores(spark, sf).orderBy(F.col("pv").isNull(), F.desc("pv"), "pos").limit(5).select("pos", "pv")


@query(f"WITH {SCORES} SELECT pos FROM r WHERE pv IS NULL")
def sweep_resume(spark, sf):
    """Grid points that the result log lacks."""
    done = _scores(spark, sf).where("pv IS NOT NULL").select(F.col("pos").alias("d"))
    grid = _grid(spark)
    return grid.join(done, F.col("pos").eqNullSafe(F.col("d")), "left_anti").select("pos")


@query(f"WITH {PAIRS} SELECT l_returnflag AS arm, l_linestatus AS seed, {REPORT}, round(avg(l_linenumber), 6) AS mean_line FROM p GROUP BY ALL")
def arm_matrix_row(spark, sf):
    rows = _pairs(spark, sf).withColumn("arm", F.col("l_returnflag")).withColumn("seed", F.col("l_linestatus"))
    report = _rounded(M.regression_report(rows, F.col("target"), F.col("pred"), ["arm", "seed"]))
    return report.join(rows.groupBy("arm", "seed").agg(F.round(F.avg("l_linenumber"), 6).alias("mean_line")), ["arm", "seed"])


@query(f"WITH {PAIRS} SELECT l_linestatus AS split, {REPORT} FROM p WHERE l_returnflag = 'A' GROUP BY ALL")
def score_split(spark, sf):
    rows = _pairs(spark, sf).where("l_returnflag = 'A'").withColumn("split", F.col("l_linestatus"))
    return _rounded(M.regression_report(rows, F.col("target"), F.col("pred"), ["split"]))


@query(f"WITH {PAIRS} SELECT count(*) AS n, 'per_row' AS mode, NULL::DOUBLE AS tp_fixed, 'per-row targets: no fixed window' AS reason, round(count_if(abs(pred - target) <= 5000) / count(pred), 6) AS tp_own FROM p")
def evaluation_modes(spark, sf):
    """With targets of their own, rows have no fixed-window rate, and the reason is said."""
    g = _pairs(spark, sf).agg(F.count(F.lit(1)).alias("n"), F.count("target").alias("k"), F.round(M.target_rate(F.col("pred"), F.col("target"), 5000.0), 6).alias("tp_own"), M.target_rate(F.col("pred"), F.lit(500.0), 50.0).alias("fixed"))
    own = F.col("k") > 0
    return g.select("n", F.when(own, "per_row").otherwise("fixed").alias("mode"), F.when(~own, F.col("fixed")).alias("tp_fixed"), F.when(own, "per-row targets: no fixed window").alias("reason"), "tp_own")


@query("SELECT source, CASE WHEN count(*) FILTER (n_chars > 2000) > 20 THEN 'per_row' ELSE 'fixed' END AS mode FROM documents GROUP BY source")
def choose_mode(spark, sf):
    return table(spark, sf, "documents").groupBy("source").agg(F.when(F.count_if(F.col("n_chars") > 2000) > 20, "per_row").otherwise("fixed").alias("mode"))


@query(f"SELECT l_orderkey, l_linenumber, CASE WHEN a IS NULL OR b IS NULL THEN NULL ELSE a AND b END AS both FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <> 2 THEN l_tax > 0.04 END AS a, CASE WHEN l_linenumber <> 3 THEN l_discount > 0.05 END AS b FROM lineitem)")
def combined_clause(spark, sf):
    """Unknown beside false stays unknown."""
    a, b = F.when(F.col("l_linenumber") != 2, F.col("l_tax") > 0.04), F.when(F.col("l_linenumber") != 3, F.col("l_discount") > 0.05)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", all_measured(a, b).alias("both"))


@query("""WITH a AS (SELECT item_id AS x, row_number() OVER (ORDER BY item_id) - 1 AS i FROM benchmark), b AS (SELECT n_nationkey AS x, row_number() OVER (ORDER BY n_nationkey) - 1 AS i FROM nation)
    SELECT i AS step, 'a' AS loader, x::BIGINT AS item FROM a UNION ALL SELECT a.i, 'b', b.x::BIGINT FROM a JOIN b ON a.i % (SELECT count(*) FROM b) = b.i""")
def interleave(spark, sf):
    """Batches of two loaders by turns; the shorter is cycled to match the longer."""
    a = table(spark, sf, "benchmark").select(F.col("item_id").alias("x"))
    b = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("x"))
    return L.interleave(a, b, "x")


@query("SELECT l_returnflag AS arm, max((l_linestatus = 'F')::INT) = 1 AS uses_f, max((l_shipdate >= TIMESTAMP '1997-01-01')::INT) = 1 AS uses_late FROM lineitem GROUP BY 1 UNION ALL SELECT 'all', max((l_linestatus = 'F')::INT) = 1, max((l_shipdate >= TIMESTAMP '1997-01-01')::INT) = 1 FROM lineitem")
def arm_switch_union(spark, sf):
    """The last arm has the switches of all others."""
    g = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("arm")).agg(F.bool_or(F.col("l_linestatus") == "F").alias("uses_f"), F.bool_or(F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz")).alias("uses_late"))
    return g.unionByName(g.agg(F.lit("all").alias("arm"), F.bool_or("uses_f").alias("uses_f"), F.bool_or("uses_late").alias("uses_late")))
