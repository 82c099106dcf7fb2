"""Queries of sinks, streams, joins, window frames and the UDF surface."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import corpus as C
from ..operators import joins as J
from ..operators import predictors as P
from ..operators import screen as S
from ..operators import tokens as T
from ..registry import query, table
from ..sources import adopt, sinks
from ..sources.scratch import scratch
from ..streaming import jobs
from . import sql as Q
from .compare import ARMS, GRID, _arms, _grid
from .corpus import COUNTS, SCREENED, _screened
from .tokens import CORRUPT, ENC, FORCED, PADDED, RANDOM, _corrupted, _encoded, _joined, _randomly_corrupted


# -- sinks: written to the shared folder and read back


@query(f"WITH {ENC} SELECT row_id, array_to_string(ids, ' ') AS ids, len(ids)::INT AS n_tokens FROM e")
def write_token_corpus(spark, sf):
    path = scratch(spark, "corpus")
    sinks.write_token_corpus(_encoded(spark, sf).select("row_id", "ids"), path)
    return sinks.read_token_corpus(spark, path).select("row_id", _joined(F.col("ids")).alias("ids"), "n_tokens")


@query("SELECT chunk::INT AS chunk, count(*) AS n FROM (SELECT doc_id % 3 AS chunk FROM documents) GROUP BY chunk")
def resume_append(spark, sf):
    """Chunks, one of them written twice as a resumed job would: no row is doubled."""
    path, docs = scratch(spark, "chunks"), table(spark, sf, "documents").select("doc_id")
    for chunk in (0, 1, 1, 2):
        sinks.append_chunk(docs.where(F.col("doc_id") % 3 == chunk), path, chunk)
    return spark.read.parquet(path).groupBy("chunk").agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT n_name AS value FROM nation")
def write_split_text(spark, sf):
    """One text file in shuffled order."""
    path = scratch(spark, "text")
    ranked = C.split_rank(table(spark, sf, "nation").select("n_nationkey", "n_name"), "n_nationkey", 1)
    sinks.write_lines(ranked, "n_name", "rank", path)
    return spark.read.text(path)


@query("SELECT p_name AS source, p_type AS target, CASE WHEN p_partkey % 10 = 0 THEN 'test' ELSE 'train' END AS part FROM part")
def write_pairs_jsonl(spark, sf):
    path = scratch(spark, "pairs")
    pairs = table(spark, sf, "part").select(F.col("p_name").alias("source"), F.col("p_type").alias("target"), F.when(F.col("p_partkey") % 10 == 0, "test").otherwise("train").alias("part"))
    sinks.write_pairs(pairs, path)
    return spark.read.schema("source string, target string, part string").json(path).select("source", "target", "part")


@query("SELECT n_nationkey AS id, n_name AS generated FROM nation")
def write_report(spark, sf):
    path = scratch(spark, "report")
    sinks.write_report({"n": 25}, table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("generated")), path)
    return spark.read.schema("id int, generated string").json(f"{path}/generations")


@query("SELECT n_nationkey AS run, n_regionkey AS score FROM nation")
def append_result(spark, sf):
    """Results appended one batch after the other are all there."""
    path, n = scratch(spark, "results"), table(spark, sf, "nation").select(F.col("n_nationkey").alias("run"), F.col("n_regionkey").alias("score"))
    for k in range(2):
        n.where(F.col("run") % 2 == k).write.mode("append").json(path)
    return spark.read.schema("run int, score int").json(path)


def _stored(spark, sf, name, key, value):
    """A table's column as the lines of one text file."""
    path = scratch(spark, name)
    table(spark, sf, name).orderBy(key).coalesce(1).select(value).write.text(path)
    return path


FILES = "f AS (SELECT string_agg(n_name || chr(10), '' ORDER BY n_nationkey) AS t FROM nation UNION ALL SELECT string_agg(r_name || chr(10), '' ORDER BY r_regionkey) FROM region)"


@query(f"WITH {FILES} SELECT strlen(t)::BIGINT AS bytes, sha256(t) AS sha256 FROM f")
def fetch_or_adopt(spark, sf):
    """Sizes and digests of files that are there."""
    return adopt.file_digests(spark, [_stored(spark, sf, "nation", "n_nationkey", "n_name"), _stored(spark, sf, "region", "r_regionkey", "r_name")]).select("bytes", "sha256")


@query("SELECT sha256(string_agg(r_name || chr(10), '' ORDER BY r_regionkey)) AS sha256 FROM region")
def config_hash(spark, sf):
    return adopt.file_digests(spark, [_stored(spark, sf, "region", "r_regionkey", "r_name")]).select("sha256")


@query("SELECT 'run --rows ' || count(*) AS argv, true AS has_version, true AS has_time FROM region")
def manifest(spark, sf):
    """A run's record: its arguments, the engine's version, the time in UTC."""
    m = adopt.manifest(spark, ["run", "--rows", str(table(spark, sf, "region").count())])
    row = spark.createDataFrame([(" ".join(m["argv"]), m["spark"], m["started_utc"])], "argv string, version string, started string")
    return row.select("argv", (F.col("version") == F.split(F.version(), " ")[0]).alias("has_version"), F.col("started").rlike(r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d.*\+00:00$").alias("has_time"))


@query(f"WITH {ARMS} SELECT '| ' || arm || ' | ' || CASE WHEN m IS NULL THEN 'n/a' ELSE printf('%.4f', m) END || ' |' AS line, row_number() OVER (ORDER BY m DESC NULLS LAST, arm) AS pos FROM a")
def sweep_md(spark, sf):
    """Lines of a table sorted by a measure, unmeasured last (the table is one row an arm)."""
    w = Window.orderBy(F.col("m").desc_nulls_last(), "arm")
    line = F.concat(F.lit("| "), F.col("arm"), F.lit(" | "), F.when(F.col("m").isNull(), "n/a").otherwise(F.format_string("%.4f", "m")), F.lit(" |"))
    return _arms(spark, sf).select(line.alias("line"), F.row_number().over(w).cast("long").alias("pos"))


# -- streams, drained with what is there


def _stream(spark, sf):
    schema = table(spark, sf, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)


def _drained(spark, frame, label, mode="append"):
    out = scratch(spark, label)
    jobs.run_once(frame, f"{out}/out", f"{out}/state", mode)
    return spark.read.parquet(f"{out}/out")


@query("SELECT DISTINCT user_id, event_type FROM events")
def incremental_dedup(spark, sf):
    """A stream's first rows by key."""
    return _drained(spark, jobs.incremental_dedup(_stream(spark, sf), ["user_id", "event_type"]), "dedup").select("user_id", "event_type")


@query("SELECT count(*) AS n, count(DISTINCT event_id) AS n_distinct FROM events")
def checkpoint_resume(spark, sf):
    """The same stream run twice over one checkpoint: the second run adds nothing."""
    out = scratch(spark, "resume")
    for _ in range(2):
        jobs.run_once(_stream(spark, sf).select("event_id"), f"{out}/out", f"{out}/state")
    return spark.read.parquet(f"{out}/out").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("n_distinct"))


@query("SELECT 3::BIGINT AS n_batches, 2::BIGINT AS most_files, count(*) AS n, count(DISTINCT event_id) AS n_distinct FROM events")
def backpressure(spark, sf):
    """Six files in batches of two at most: the batches, their files and all rows."""
    source, out = scratch(spark, "files"), scratch(spark, "bounded")
    table(spark, sf, "events").select("event_id").repartition(6).write.parquet(source)
    stream = jobs.tail_parquet(spark, source, "event_id long", files_a_trigger=2).select("event_id", F.col("_metadata.file_name").alias("file"))
    jobs.run_bounded(stream, f"{out}/out", f"{out}/state")
    batches = spark.read.parquet(f"{out}/out").groupBy("chunk").agg(F.count_distinct("file").alias("files"), F.count(F.lit(1)).alias("n"), F.count_distinct("event_id").alias("d"))
    return batches.agg(F.count(F.lit(1)).alias("n_batches"), F.max("files").alias("most_files"), F.sum("n").alias("n"), F.sum("d").alias("n_distinct"))


@query("SELECT event_id, event_type, value FROM events WHERE event_type = 'error'")
def tail_metrics(spark, sf):
    return _drained(spark, _stream(spark, sf).where("event_type = 'error'").select("event_id", "event_type", "value"), "tail")


@query("SELECT user_id AS key, count_if(gap > 100000)::BIGINT AS n FROM (SELECT user_id, (epoch_us(ts) - epoch_us(lag(ts) OVER (PARTITION BY user_id ORDER BY ts))) / 1e6 AS gap FROM events) GROUP BY user_id HAVING count_if(gap > 100000) > 0")
def stall_detect(spark, sf):
    """Pauses longer than a limit, from state kept for each key."""
    return _drained(spark, jobs.stalls(_stream(spark, sf), "user_id", "ts", 100000.0), "stalls").groupBy("key").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id FROM documents ANTI JOIN labels USING (doc_id)")
def skip_processed(spark, sf):
    """Rows that an earlier run, here the labelling, has not consumed."""
    return table(spark, sf, "documents").select("doc_id").join(table(spark, sf, "labels").select("doc_id"), "doc_id", "left_anti")


# -- joins and frames


@query("""SELECT e.event_id, (SELECT arg_max(v.value, v.ts) FROM events v WHERE v.user_id = e.user_id AND v.event_type = 'view' AND v.ts <= e.ts) AS last_view FROM events e WHERE e.event_type = 'purchase'""")
def asof_join(spark, sf):
    """The latest view's value at each purchase."""
    e = table(spark, sf, "events")
    left = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return J.asof_join(left, e.where("event_type = 'view'"), "user_id", "ts", "value", "last_view").select("event_id", "last_view")


@query("SELECT o_orderkey, n_nationkey::BIGINT AS span FROM orders JOIN nation ON o_orderkey >= n_nationkey * 70 AND o_orderkey < n_nationkey * 70 + 100")
def interval_join(spark, sf):
    spans = table(spark, sf, "nation").select(F.col("n_nationkey").cast("long").alias("span"))
    begin = F.col("span") * 70
    return J.interval_join(table(spark, sf, "orders").select("o_orderkey"), spans, F.col("o_orderkey"), begin, begin + 100, 64).select("o_orderkey", "span")


@query("SELECT coalesce(c_nationkey, s_nationkey)::INT AS nation, a.n AS n_customers, b.n AS n_suppliers FROM (SELECT c_nationkey, count(*) AS n FROM customer WHERE c_acctbal < 0 GROUP BY 1) a FULL JOIN (SELECT s_nationkey, count(*) AS n FROM supplier WHERE s_acctbal < 0 GROUP BY 1) b ON c_nationkey = s_nationkey")
def full_outer_join(spark, sf):
    a = table(spark, sf, "customer").where("c_acctbal < 0").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n_customers"))
    b = table(spark, sf, "supplier").where("s_acctbal < 0").groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("n_suppliers"))
    return a.join(b, a.c_nationkey == b.s_nationkey, "full").select(F.coalesce("c_nationkey", "s_nationkey").cast("int").alias("nation"), "n_customers", "n_suppliers")


@query("""SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY event_id RANGE BETWEEN 500 PRECEDING AND CURRENT ROW), 4) AS near_sum, ntile(4) OVER w AS quarter, round(percent_rank() OVER w, 6) AS percent_rank, round(cume_dist() OVER w, 6) AS cume_dist, lead(event_id) OVER w AS next_id
    FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)""")
def window_frames(spark, sf):
    w = Window.partitionBy("user_id").orderBy("event_id")
    near = F.sum("value").over(w.rangeBetween(-500, 0))
    return table(spark, sf, "events").select("event_id", F.round(near, 4).alias("near_sum"), F.ntile(4).over(w).cast("long").alias("quarter"), F.round(F.percent_rank().over(w), 6).alias("percent_rank"), F.round(F.cume_dist().over(w), 6).alias("cume_dist"), F.lead("event_id").over(w).alias("next_id"))


# -- batches


@query(f"WITH {PADDED} SELECT row_id, conv_id // 4 AS batch, array_to_string(list_resize(ids, 48, 0), ' ') AS ids, array_to_string(list_resize(ids[1:12], 12, -100), ' ') AS labels FROM p")
def collate_seq2seq(spark, sf):
    """Sources padded with zeros, targets with the ignored label."""
    rows = _encoded(spark, sf)
    both = rows.select("row_id", F.floor(F.col("conv_id") / 4).alias("batch"), T.pad(F.col("ids"), F.lit(48)).alias("s"), T.pad(F.slice("ids", 1, 12), F.lit(12), -100).alias("t"))
    return both.select("row_id", "batch", _joined(F.col("s")).alias("ids"), _joined(F.col("t")).alias("labels"))


@query(f"""WITH {RANDOM}, w AS (SELECT row_id // 800 AS batch, (ceil(max(len(inputs)) / 8) * 8)::BIGINT AS width FROM x GROUP BY 1)
    SELECT row_id, batch, array_to_string(list_resize(inputs, width, 0), ' ') AS ids, array_to_string(list_transform(range(1, width + 1), lambda i: (i <= len(inputs))::INT), ' ') AS mask, array_to_string(list_resize(labels, 64, -100), ' ') AS labels FROM x JOIN w ON row_id // 800 = batch""")
def collate_pretrain(spark, sf):
    """Corrupted rows, padded to their batch's width; labels padded with the ignored label."""
    rows = _randomly_corrupted(spark, sf).withColumn("batch", F.floor(F.col("row_id") / 800))
    wide = T.batch_width(rows, ["batch"], "inputs", 8)
    both = wide.select("row_id", "batch", T.pad(F.col("inputs"), F.col("width")).alias("i"), T.mask(F.size("inputs"), F.col("width")).alias("m"), T.pad(F.col("labels"), F.lit(64), -100).alias("l"))
    return both.select("row_id", "batch", _joined(F.col("i")).alias("ids"), _joined(F.col("m")).alias("mask"), _joined(F.col("l")).alias("labels"))


@query(f"WITH {CORRUPT} SELECT row_id % 2 AS task_id, array_to_string(list_resize({FORCED}, 40, 0), ' ') AS ids FROM c")
def collate_task(spark, sf):
    """Items of two tasks in one batch layout."""
    rows = _corrupted(spark, sf).select((F.col("row_id") % 2).alias("task_id"), T.pad(F.col("inputs"), F.lit(40)).alias("i"))
    return rows.select("task_id", _joined(F.col("i")).alias("ids"))


@query(f"WITH {ENC} SELECT row_id, array_to_string(list_resize(ids, 56, 0), ' ') AS ids FROM e")
def group_pad_concat(spark, sf):
    """Chunks of different widths brought to one and stacked."""
    rows = _encoded(spark, sf)
    parts = [rows.where(F.col("row_id") % 2 == k).select("row_id", T.pad(F.col("ids"), F.lit(56)).alias("p")) for k in (0, 1)]
    return parts[0].unionByName(parts[1]).select("row_id", _joined(F.col("p")).alias("ids"))


# -- the UDF surface


def _length_model():
    def predict(texts):
        if any(t.startswith("!") for t in texts):
            raise ValueError("a batch that fails")
        return [float(len(t)) for t in texts]

    return predict


@query("SELECT p_partkey, length(p_name)::DOUBLE AS predicted FROM part")
def predict_batch(spark, sf):
    """An injected predictor (here: length) in batches."""
    return table(spark, sf, "part").select("p_partkey", P.predictor(_length_model)(F.col("p_name")).alias("predicted"))


@query("SELECT p_partkey, CAST(NULL AS DOUBLE) AS predicted FROM part")
def failure_isolation(spark, sf):
    """Batches that fail are NaN (shown as null), and the query lives."""
    bad = F.concat(F.lit("!"), F.col("p_name"))
    p = P.predictor(_length_model)(bad)
    return table(spark, sf, "part").select("p_partkey", p.alias("p")).select("p_partkey", F.when(~F.isnan("p"), F.col("p")).alias("predicted"))


@query("SELECT p_partkey, length(p_name)::DOUBLE AS mean, 0.0::DOUBLE AS std, 2::BIGINT AS n_contributing FROM part")
def ensemble_predict(spark, sf):
    """Three members, of which one always fails."""

    def broken():
        def predict(texts):
            raise ValueError("no model")

        return predict

    members = [P.predictor(_length_model), P.predictor(broken), P.predictor(_length_model, batch=7)]
    return P.ensemble_predict(table(spark, sf, "part"), "p_partkey", "p_name", members)


@query(f"SELECT count(*) AS n, round(avg(length(text) - n_chars * 0.9), 4) AS mean_gap, round(avg(abs(length(text) - n_chars * 0.9)), 4) AS mean_abs_gap FROM documents")
def drift_auditor(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", F.length("text").cast("double").alias("reward"))
    out = P.drift(docs, "reward", lambda d: d.withColumn("audit", F.col("n_chars") * 0.9), "doc_id", "audit")
    return out.select("n", F.round("mean_gap", 4).alias("mean_gap"), F.round("mean_abs_gap", 4).alias("mean_abs_gap"))


@query("SELECT p_partkey, len(regexp_extract_all('[At]' || p_name || '[At]', '\\[At\\]'))::BIGINT AS n FROM part")
def count_termini(spark, sf):
    """The string analogue of counting end atoms."""
    s = F.concat(F.lit("[At]"), F.col("p_name"), F.lit("[At]"))
    return table(spark, sf, "part").select("p_partkey", F.size(F.regexp_extract_all(s, F.lit(r"\[At\]"), F.lit(0))).cast("long").alias("n"))


@query(f"SELECT doc_id, text = {Q.canonical('text')} AS reproducible FROM documents")
def reproducible(spark, sf):
    """Whether a text is its own canonical form: string equality, nothing normalised."""
    return table(spark, sf, "documents").select("doc_id", (F.col("text") == X.canonical(F.col("text"))).alias("reproducible"))


@query()
def bootstrap_delta(spark, sf):
    """Each arm's rows resampled 2,000 times: delta to the baseline and its 95 % interval."""
    from ..operators import compare as K

    lines = table(spark, sf, "lineitem")
    means = K.bootstrap_blocks(lines, "l_returnflag", F.concat_ws(":", "l_orderkey", "l_linenumber"), F.col("l_discount"), 2000)
    observed = lines.groupBy("l_returnflag").agg(F.avg(F.col("l_discount").cast("double")).alias("mean"))
    return K.bootstrap_delta(means, observed, "l_returnflag", "A").withColumnRenamed("l_returnflag", "arm")


@query(f"WITH {SCREENED}, rr AS (SELECT lang, {COUNTS} FROM s GROUP BY lang) SELECT lang, CASE WHEN pv_rate - 0.3 < -0.05 THEN 'regressed' WHEN pv_rate - 0.3 > 0.05 THEN 'improved' ELSE 'no regression' END AS said FROM rr")
def generation_check(spark, sf):
    """An arm's screened rates against frozen ones."""
    from ..operators.compare import regression_check

    rates = S.cascade_counts(_screened(spark, sf), ["lang"])
    return rates.select("lang", regression_check(F.col("pv_rate") - 0.3, 0.05).alias("said"))


@query(f"SELECT n_nationkey AS most, forced, n, n <= n_nationkey OR forced AS passed FROM nation, (SELECT count(*) AS n FROM {GRID}), (VALUES (false), (true)) v(forced)")
def sweep_guard(spark, sf):
    """Grids with more points than a limit are refused unless forced."""
    n = F.broadcast(_grid(spark).agg(F.count(F.lit(1)).alias("n")))
    asked = table(spark, sf, "nation").select(F.col("n_nationkey").alias("most"), F.explode(F.array(F.lit(False), F.lit(True))).alias("forced"))
    return asked.crossJoin(n).select("most", "forced", "n", ((F.col("n") <= F.col("most")) | F.col("forced")).alias("passed"))


@query("SELECT n_nationkey AS log, 'metrics.20240101' || CASE WHEN n_nationkey > 0 THEN '.' || n_nationkey ELSE '' END || '.jsonl' AS archived FROM nation WHERE n_nationkey < 3")
def archive_metrics(spark, sf):
    """Archived names do not clash."""
    import os
    import tempfile

    names = []
    with tempfile.TemporaryDirectory() as d:
        for _ in range(3):
            path = os.path.join(d, "metrics.jsonl")
            open(path, "w").close()
            names.append(os.path.basename(adopt.archive(path, "20240101")))
    return spark.createDataFrame(list(enumerate(names)), "log int, archived string")
