"""Queries of the smaller named operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.numbers import safe_ratio
from ..registry import query, table
from . import sql as Q


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 3 THEN l_quantity / l_linenumber ELSE 0 END::DOUBLE AS ratio FROM lineitem")
def safe_ratio_rows(spark, sf):
    d = F.when(F.col("l_linenumber") > 3, F.col("l_linenumber")).otherwise(0)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", safe_ratio(F.col("l_quantity"), d).alias("ratio"))


@query("SELECT l_orderkey, l_linenumber, a.p_size::BIGINT AS size FROM lineitem JOIN part a ON l_partkey = p_partkey")
def positional_equi_join(spark, sf):
    """Pairs by an explicit key; both sides must have as many rows as pairs come out."""
    return table(spark, sf, "lineitem").join(table(spark, sf, "part"), F.col("l_partkey") == F.col("p_partkey")).select("l_orderkey", "l_linenumber", F.col("p_size").cast("long").alias("size"))


@query("SELECT k AS key, coalesce(b.v, a.v) AS value FROM (VALUES ('lr', '0.1'), ('batch', '32'), ('seed', '0')) a(k, v) LEFT JOIN (VALUES ('lr', '0.01')) b(k2, v) ON k = k2 UNION ALL SELECT 'epochs', '3'")
def config_overlay(spark, sf):
    """Right wins, missing keys are added: a map concatenation that keeps the last of a key."""
    m = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    base, over = m({"lr": "0.1", "batch": "32", "seed": "0"}), m({"lr": "0.01", "epochs": "3"})
    kept = F.map_filter(base, lambda k, v: ~F.map_contains_key(over, k))
    return spark.range(1).select(F.explode(F.map_concat(kept, over)).alias("key", "value"))


@query("""SELECT o_orderpriority AS generator, CASE WHEN o_orderpriority = '5-LOW' THEN 'unknown' WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 'shared' ELSE 'distinct' END AS provenance, count(*) AS n FROM orders GROUP BY 1, 2""")
def provenance_match(spark, sf):
    """Whether a generator's data is among the predictors': shared, distinct, or unknown."""
    predictors = spark.createDataFrame([("1-urgent",), ("2-high",)], "f string").withColumn("hit", F.lit(True))
    print_ = F.when(F.col("o_orderpriority") != "5-LOW", X.clean_path(F.col("o_orderpriority")))
    rows = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("generator"), print_.alias("p")).join(F.broadcast(predictors), F.col("p") == F.col("f"), "left")
    said = F.when(F.col("p").isNull(), "unknown").when(F.col("hit"), "shared").otherwise("distinct")
    return rows.groupBy("generator", said.alias("provenance")).agg(F.count(F.lit(1)).alias("n"))


@query(r"SELECT page_id, lower(replace(url, '\', '/')) AS fingerprint FROM pages")
def dataset_fingerprint(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.clean_path(F.col("url")).alias("fingerprint"))


@query(r"SELECT p_partkey, 'root/' || replace('a\' || p_name, '\', '/') AS path FROM part")
def normalise_path(spark, sf):
    p = F.replace(F.concat(F.lit("a\\"), F.col("p_name")), F.lit("\\"), F.lit("/"))
    return table(spark, sf, "part").select("p_partkey", F.concat(F.lit("root/"), p).alias("path"))


@query("SELECT run, CASE WHEN contains(run, '_seed') THEN NULL ELSE run || '_seed' || 3 END AS built FROM (SELECT unnest(['arm_a', 'arm_b_seed1']) AS run)")
def seed_from_name(spark, sf):
    runs = spark.createDataFrame([("arm_a",), ("arm_b_seed1",)], "run string")
    return runs.select("run", F.when(~F.col("run").contains("_seed"), F.concat("run", F.lit("_seed3"))).alias("built"))


@query("""SELECT DISTINCT substr(sha256('{"l_linenumber":' || l_linenumber || ',"l_linestatus":"' || l_linestatus || '","l_returnflag":"' || l_returnflag || '"}'), 1, 12) AS fingerprint FROM lineitem""")
def config_fingerprint(spark, sf):
    """Twelve hex digits of the digest of a record's JSON with sorted keys."""
    rec = F.to_json(F.struct(*sorted(["l_returnflag", "l_linestatus", "l_linenumber"])))
    return table(spark, sf, "lineitem").select(F.substring(F.sha2(rec, 256), 1, 12).alias("fingerprint")).distinct()


SECONDS = [-1.0, 0.0, 5.4, 89.0, 95.0, 3599.0, 5400.0, 100000.0, 172800.0, 1e6]


@query("SELECT s, CASE WHEN s < 0 THEN '--:--:--' ELSE printf('%02d:%02d:%02d', s::BIGINT // 3600, s::BIGINT % 3600 // 60, s::BIGINT % 60) END AS eta FROM (SELECT unnest([" + ", ".join(f"{x}::DOUBLE" for x in SECONDS) + "]) AS s)")
def format_eta(spark, sf):
    rows = spark.createDataFrame([(x,) for x in SECONDS], "s double")
    return rows.select("s", X.eta(F.col("s")).alias("eta"))


@query("SELECT s, CASE WHEN s < 0 THEN '?' WHEN s < 90 THEN printf('%.0fs', s) WHEN s < 5400 THEN printf('%.0fm', s / 60) WHEN s < 172800 THEN printf('%.1fh', s / 3600) ELSE printf('%.1fd', s / 86400) END AS said FROM (SELECT unnest([" + ", ".join(f"{x}::DOUBLE" for x in SECONDS) + "]) AS s)")
def human_duration(spark, sf):
    rows = spark.createDataFrame([(x,) for x in SECONDS], "s double")
    return rows.select("s", X.duration(F.col("s")).alias("said"))


@query("SELECT n, CASE WHEN n >= 1e9 THEN printf('%.2f GB', n / 1e9) WHEN n >= 1e6 THEN printf('%.2f MB', n / 1e6) WHEN n >= 1e3 THEN printf('%.2f KB', n / 1e3) ELSE n || ' B' END AS said FROM (SELECT unnest([0, 999, 1000, 123456, 98765432, 5000000000])::BIGINT AS n)")
def human_bytes(spark, sf):
    rows = spark.createDataFrame([(x,) for x in (0, 999, 1000, 123456, 98765432, 5000000000)], "n long")
    return rows.select("n", X.bytes_text(F.col("n")).alias("said"))


@query("SELECT rate, rate * 40 * 10000 AS plane_seconds, rate * 80 * 10000 AS full_seconds FROM (SELECT unnest([0.5, 0.25])::DOUBLE AS rate)")
def cost_projection(spark, sf):
    r = F.col("rate")
    return spark.createDataFrame([(0.5,), (0.25,)], "rate double").select("rate", (r * 40 * 10000).alias("plane_seconds"), (r * 80 * 10000).alias("full_seconds"))


@query("SELECT source, coalesce(max(n_chars) FILTER (lang = 'en'), max(n_chars) FILTER (lang = 'de'), 0)::BIGINT // 32 * 3 AS total_steps FROM documents GROUP BY source")
def plan_total_steps(spark, sf):
    """The first source that says a size wins; whole batches times epochs."""
    n = F.coalesce(F.max(F.when(F.col("lang") == "en", F.col("n_chars"))), F.max(F.when(F.col("lang") == "de", F.col("n_chars"))), F.lit(0))
    return table(spark, sf, "documents").groupBy("source").agg((F.floor(n / 32) * 3).cast("long").alias("total_steps"))


@query(f"SELECT DISTINCT {Q.canonical('text')} AS canonical FROM (SELECT * FROM documents ORDER BY doc_id LIMIT 300)")
def training_reference(spark, sf):
    """A novelty reference from the first rows of a corpus."""
    return table(spark, sf, "documents").orderBy("doc_id").limit(300).select(X.canonical(F.col("text")).alias("canonical")).distinct()


@query("SELECT p_partkey, p_retailprice AS mean, 0.0::DOUBLE AS std, 1::BIGINT AS n FROM part")
def auditor_triples(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.col("p_retailprice").alias("mean"), F.lit(0.0).alias("std"), F.lit(1).cast("long").alias("n"))


@query("SELECT 'discount' AS metric, l_orderkey AS candidate, l_discount AS x FROM lineitem WHERE l_returnflag = 'R'")
def sample_lookup(spark, sf):
    """The long table of samples, filtered to a metric and an arm."""
    rows = table(spark, sf, "lineitem").where("l_returnflag = 'R'")
    return rows.select(F.lit("discount").alias("metric"), F.col("l_orderkey").alias("candidate"), F.col("l_discount").alias("x"))


@query("SELECT k AS key, b.v::DOUBLE AS wanted, a.v::DOUBLE AS pinned, a.v IS DISTINCT FROM b.v AS refused FROM (VALUES ('tolerance', 100.0), ('sigma0', 20.0)) a(k, v) JOIN (VALUES ('tolerance', 100.0), ('sigma0', 25.0)) b(k2, v) ON k = k2")
def override_guard(spark, sf):
    """Overrides of pinned constants that change them."""
    a = spark.createDataFrame([("tolerance", 100.0), ("sigma0", 20.0)], "key string, pinned double")
    b = spark.createDataFrame([("tolerance", 100.0), ("sigma0", 25.0)], "key string, wanted double")
    return a.join(b, "key").select("key", "wanted", "pinned", (~F.col("pinned").eqNullSafe(F.col("wanted"))).alias("refused"))


@query(r"SELECT conv_id, turn, text AS source, CASE WHEN regexp_matches(role, '^u') THEN 1.5 END::DOUBLE AS value, regexp_matches(role, '^u') AS is_numeric FROM conversations")
def prediction_row(spark, sf):
    value = X.parse_strict(F.when(F.col("role").startswith("u"), "1.5").otherwise("soft"))
    return table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("source"), value.alias("value"), value.isNotNull().alias("is_numeric"))


@query("SELECT task_id::BIGINT AS task_id, count(*) AS n FROM (SELECT 0 AS task_id FROM part UNION ALL SELECT 1 FROM part WHERE p_size > 10) GROUP BY task_id")
def dataset_counts(spark, sf):
    """Items by task of the two streams."""
    p = table(spark, sf, "part")
    both = p.select(F.lit(0).cast("long").alias("task_id")).unionByName(p.where("p_size > 10").select(F.lit(1).cast("long").alias("task_id")))
    return both.groupBy("task_id").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT 0::BIGINT AS task_id, p_name AS source, format('{:.1f}', p_retailprice) AS target FROM part UNION ALL SELECT 1, format('{:.1f}', p_retailprice), p_name FROM part")
def task_stream(spark, sf):
    """Prediction items (marker 0) and generation items (marker 1) of the same pairs."""
    p = table(spark, sf, "part").withColumn("y", X.format_property(F.col("p_retailprice")))
    one = p.select(F.lit(0).cast("long").alias("task_id"), F.col("p_name").alias("source"), F.col("y").alias("target"))
    return one.unionByName(p.select(F.lit(1).cast("long").alias("task_id"), F.col("y").alias("source"), F.col("p_name").alias("target")))


@query("SELECT p_partkey AS source_index, w AS writing, i = 0 AS is_original FROM (SELECT p_partkey, unnest([p_name, upper(p_name), reverse(p_name)]) AS w, unnest([0, 1, 2]) AS i FROM part) QUALIFY row_number() OVER (PARTITION BY p_partkey, w ORDER BY i) = 1 AND length(w) <= 40")
def augment(spark, sf):
    """The original first, then other writings, distinct and not too long, tied to their source."""
    writings = F.array_distinct(F.array("p_name", F.upper("p_name"), F.reverse("p_name")))
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("source_index"), F.posexplode(writings).alias("i", "writing"))
    return rows.where(F.length("writing") <= 40).select("source_index", "writing", (F.col("i") == 0).alias("is_original"))


@query("""WITH s AS (SELECT doc_id, quality, toxic, CASE WHEN row_number() OVER (ORDER BY md5('6:' || doc_id), doc_id) <= round_even(0.8 * count(*) OVER (), 0) THEN 'train' ELSE 'test' END AS part FROM labels),
    k AS (SELECT * FROM s WHERE NOT (part = 'train' AND toxic = 1)), f AS (SELECT avg(n_chars) AS m, stddev_pop(n_chars) AS sd FROM k JOIN documents USING (doc_id) WHERE part = 'train')
    SELECT doc_id, part, round((n_chars - m) / sd, 5) AS z, CASE WHEN part = 'train' THEN round((1 / greatest(quality * 10, 5.6)) / avg(1 / greatest(quality * 10, 5.6)) OVER (PARTITION BY part), 5) ELSE 1 END::DOUBLE AS weight FROM k JOIN documents USING (doc_id), f""")
def assemble_split(spark, sf):
    """End to end: split, drop flagged rows from train only, standardise on train, weigh train."""
    from ..operators import corpus as C

    parts = C.random_split(table(spark, sf, "labels"), "doc_id", {"train": 0.8, "test": 0.2}, 6)
    kept = C.guarded_drop(parts, "part", F.col("toxic") == 1).join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    w = F.lit(1.0) / F.greatest(F.col("quality") * 10, F.lit(5.6))
    fit = kept.where("part = 'train'").agg(F.avg("n_chars").alias("m"), F.stddev_pop("n_chars").alias("sd"), F.avg(w).alias("mw"))
    z = F.round((F.col("n_chars") - F.col("m")) / F.col("sd"), 5)
    return kept.crossJoin(F.broadcast(fit)).select("doc_id", "part", z.alias("z"), F.when(F.col("part") == "train", F.round(w / F.col("mw"), 5)).otherwise(1.0).alias("weight"))


@query("SELECT o_orderkey, '{\"o_orderpriority\":\"' || o_orderpriority || '\",\"o_orderkey\":' || o_orderkey || '}' AS record, o_orderkey AS back FROM orders")
def to_dict(spark, sf):
    """A record as JSON and back."""
    j = F.to_json(F.struct("o_orderpriority", "o_orderkey"))
    return table(spark, sf, "orders").select("o_orderkey", j.alias("record"), F.from_json(j, "o_orderkey LONG")["o_orderkey"].alias("back"))


@query("SELECT n_nationkey, n_name AS name, n_regionkey::BIGINT AS region FROM nation")
def from_dict(spark, sf):
    """Typed columns from JSON records; a record that is no JSON is all null."""
    stored = table(spark, sf, "nation").select(F.to_json(F.struct("n_nationkey", F.col("n_name").alias("name"), F.col("n_regionkey").alias("region"))).alias("record"))
    return stored.select(F.from_json("record", "n_nationkey INT, name STRING, region LONG").alias("r")).select("r.*")


@query("SELECT l_orderkey, l_linenumber, 'discount' AS component, l_discount AS x FROM lineitem UNION ALL SELECT l_orderkey, l_linenumber, 'tax', l_tax FROM lineitem WHERE l_linenumber <= 3")
def map_components(spark, sf):
    """Each row's map of components, flattened; a component that was not measured is no key."""
    m = F.create_map(F.lit("discount"), F.col("l_discount"))
    both = F.when(F.col("l_linenumber") <= 3, F.map_concat(m, F.create_map(F.lit("tax"), F.col("l_tax")))).otherwise(m)
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.explode(both).alias("component", "x"))


@query("SELECT arm, found FROM (VALUES ('AF', true), ('NF', true), ('B7', false)) v(arm, found)")
def baseline_lookup(spark, sf):
    """Whether the frozen record has an arm; using one it lacks is an error."""
    frozen = table(spark, sf, "lineitem").select(F.concat("l_returnflag", "l_linestatus").alias("a")).distinct().withColumn("hit", F.lit(True))
    asked = spark.createDataFrame([("AF",), ("NF",), ("B7",)], "arm string")
    return asked.join(frozen, F.col("arm") == F.col("a"), "left").select("arm", F.coalesce("hit", F.lit(False)).alias("found"))


@query("SELECT n_nationkey AS run FROM nation WHERE n_regionkey <> 0")
def skip_done_runs(spark, sf):
    """Runs without a stored report."""
    runs = table(spark, sf, "nation").select(F.col("n_nationkey").alias("run"), F.col("n_regionkey").alias("r"))
    return runs.select("run").join(runs.where("r = 0").select("run"), "run", "left_anti")


@query("SELECT c.arm, c.i::BIGINT AS i FROM (VALUES ('a1', 0), ('a2', 1), ('a3', 2), ('a6', 3)) c(arm, i) WHERE arm IN ('a3', 'a1') ORDER BY i")
def config_select(spark, sf):
    """A subset of arms in their canonical order."""
    arms = spark.createDataFrame([("a1", 0), ("a2", 1), ("a3", 2), ("a6", 3)], "arm string, i long")
    return arms.join(F.broadcast(spark.createDataFrame([("a3",), ("a1",)], "arm string")), "arm", "left_semi").orderBy("i")


@query(f"SELECT row_id, array_to_string(list_transform(range(0, 16), lambda i: {Q.md5_long("'3:' || row_id || ':' || i")} % 400 + 10), ' ') AS ids FROM (SELECT unnest(range(0, 64)) AS row_id)")
def synthetic_batches(spark, sf):
    """Random identifier rows for a smoke run, a function of seed and row."""
    ids = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: X.md5_long(F.concat(F.lit("3:"), F.col("id").cast("string"), F.lit(":"), i.cast("string"))) % 400 + 10)
    return spark.range(64).select(F.col("id").alias("row_id"), F.array_join(F.transform(ids, lambda x: x.cast("string")), " ").alias("ids"))
