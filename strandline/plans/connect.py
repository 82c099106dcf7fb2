"""Queries of scans and sinks over the driver's tables: texts stand for files' lines, event properties
for JSON lines."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.numbers import is_finite
from ..operators import corpus as C
from ..sources import readers as R
from ..sources import sinks as W
from ..registry import query, table
from . import sql as Q

STRIPPED = Q.strip("p_name")


@query("SELECT p_name AS value FROM part ORDER BY p_partkey LIMIT 100")
def scan_csv_column(spark, sf):
    """One column, the first rows read."""
    return table(spark, sf, "part").orderBy("p_partkey").limit(100).select(F.col("p_name").alias("value"))


#: Labels of which some are no numbers, some infinite.
LABEL = "CASE WHEN p_size % 7 = 0 THEN 'n/a' WHEN p_size % 11 = 0 THEN 'inf' ELSE CAST(p_retailprice AS VARCHAR) END"


def _labelled(spark, sf):
    label = F.when(F.col("p_size") % 7 == 0, "n/a").when(F.col("p_size") % 11 == 0, "inf").otherwise(F.col("p_retailprice").cast("string"))
    return table(spark, sf, "part").select("p_partkey", "p_name", "p_size", label.alias("label"))


@query(f"SELECT {STRIPPED} AS text, p_retailprice AS value FROM part WHERE {STRIPPED} <> '' AND p_size % 7 <> 0 AND p_size % 11 <> 0")
def scan_csv_labelled(spark, sf):
    return R.labelled(_labelled(spark, sf), "p_name", "label")


@query("SELECT count(*) AS n_rows, 0::BIGINT AS n_no_text, count_if(p_size % 7 = 0 OR p_size % 11 = 0)::BIGINT AS n_no_label, count_if(p_size % 7 <> 0 AND p_size % 11 <> 0)::BIGINT AS n_kept FROM part")
def scan_drop_counts(spark, sf):
    return R.dropped(_labelled(spark, sf), "p_name", "label")


@query(f"SELECT {STRIPPED} AS text, p_retailprice AS value, CASE WHEN p_size % 5 = 0 THEN 0 ELSE p_size END::DOUBLE AS std, CASE WHEN p_size % 3 = 0 THEN 1 ELSE p_size END::BIGINT AS num_of_points, lower(p_brand) AS reliability, p_type AS kind, CASE WHEN p_size % 5 = 0 THEN NULL ELSE p_size * 2 END::DOUBLE AS d0 FROM part")
def scan_csv_wide(spark, sf):
    """Bad cells take their defaults; a bad descriptor is NaN (shown as null)."""
    p = table(spark, sf, "part")
    said = lambda k, c: F.when(F.col("p_size") % k == 0, "bad").otherwise(c.cast("string"))
    rows = p.select("p_name", "p_brand", "p_type", F.col("p_retailprice").alias("y"), said(5, F.col("p_size")).alias("std"), said(3, F.col("p_size")).alias("n"), said(5, F.col("p_size") * 2).alias("d"))
    wide = R.wide_records(rows, "p_name", "y", "std", "n", "p_brand", "p_type", ["d"])
    d = F.col("descriptors")[0]
    return wide.select("text", "value", "std", "num_of_points", "reliability", "kind", F.when(~F.isnan(d), d).alias("d0"))


@query("SELECT prefix, n::BIGINT AS n, n = 11 AS as_declared FROM (SELECT split_part(column_name, '_', 1) AS prefix, count(*) AS n FROM (DESCRIBE lineitem) GROUP BY 1)")
def schema_validate(spark, sf):
    """Columns by prefix group against the declared sizes."""
    columns = table(spark, sf, "lineitem").columns
    groups = R.require_columns(columns, ["l_orderkey", "l_quantity"], {"l_": 11})
    return spark.createDataFrame([(p.rstrip("_"), len(c), True) for p, c in groups.items()], "prefix string, n long, as_declared boolean")


@query("SELECT vec_id, dim::BIGINT AS dim, x FROM (SELECT vec_id, unnest(range(0, len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings)")
def descriptor_matrix(spark, sf):
    rows = table(spark, sf, "embeddings").select("vec_id", F.posexplode("embedding").alias("dim", "x"))
    return rows.select("vec_id", F.col("dim").cast("long").alias("dim"), F.col("x").cast("double").alias("x"))


@query(f"SELECT doc_id, {Q.strip('line')} AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) WHERE {Q.strip('line')} <> ''")
def scan_text_lines(spark, sf):
    lines = table(spark, sf, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))
    return lines.select("doc_id", X.strip(F.col("line")).alias("line")).where("line <> ''")


@query(f"SELECT file_no::BIGINT AS file_no, line_no, {Q.strip('value')} AS value FROM (SELECT *, row_number() OVER (ORDER BY file_no, line_no) AS pos FROM (SELECT 0 AS file_no, item_id AS line_no, text AS value FROM benchmark UNION ALL SELECT 1, n_nationkey, CASE WHEN n_nationkey % 5 = 0 THEN ' ' ELSE n_name END FROM nation)) WHERE pos > 10 AND pos <= 60 AND {Q.strip('value')} <> ''")
def scan_text_multi(spark, sf):
    """Two sources in order; skip and limit span both and count blank lines, which are not returned."""
    one = table(spark, sf, "benchmark").select(F.lit(0).cast("long").alias("file_no"), F.col("item_id").alias("line_no"), F.col("text").alias("value"))
    name = F.when(F.col("n_nationkey") % 5 == 0, " ").otherwise(F.col("n_name"))
    two = table(spark, sf, "nation").select(F.lit(1).cast("long").alias("file_no"), F.col("n_nationkey").cast("long").alias("line_no"), name.alias("value"))
    rows = one.unionByName(two).orderBy("file_no", "line_no").offset(10).limit(50)
    return rows.select("file_no", "line_no", X.strip(F.col("value")).alias("value")).where("value <> ''")


@query("SELECT event_id, json_extract_string(props, '$.k') AS value FROM events WHERE json_extract_string(props, '$.k') <> ''")
def scan_jsonl_field(spark, sf):
    return R.json_field(table(spark, sf, "events"), "props", "k").select("event_id", "value")


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE event_id % 9 <> 0 AND json_extract_string(props, '$.k') IS NOT NULL")
def scan_jsonl_records(spark, sf):
    """Malformed lines (every ninth is broken here) are skipped."""
    line = F.when(F.col("event_id") % 9 == 0, F.concat(F.lit("{"), F.col("props"))).otherwise(F.col("props"))
    parsed = F.from_json(line, "k LONG", {"mode": "PERMISSIVE"})["k"]
    return table(spark, sf, "events").select("event_id", parsed.alias("k")).where("k IS NOT NULL")


@query("SELECT event_id, event_type AS generated, CASE WHEN event_id % 4 <> 0 THEN json_extract_string(props, '$.k')::DOUBLE END AS target FROM events")
def scan_generations(spark, sf):
    """Targets as numbers, numbers in strings, or null."""
    raw = F.when(F.col("event_id") % 4 == 0, F.lit("soft")).otherwise(F.get_json_object("props", "$.k"))
    return table(spark, sf, "events").select("event_id", F.col("event_type").alias("generated"), X.parse_permissive(raw).alias("target"))


@query("SELECT event_id, CASE WHEN regexp_matches(event_type, '^[cp]') THEN event_type WHEN regexp_matches(json_extract_string(props, '$.k'), '^[cp0-9]') THEN json_extract_string(props, '$.k') END AS value FROM events")
def probe_field(spark, sf):
    """The first field in order of priority whose value matches."""
    record = F.to_json(F.struct(F.col("event_type").alias("target"), F.get_json_object("props", "$.k").alias("source")))
    rows = table(spark, sf, "events").withColumn("record", record)
    first = F.get_json_object("record", "$.target")
    return rows.select("event_id", F.coalesce(F.when(first.rlike("^[cp]"), first), R.probe(rows, "record", ["source"], "^[cp0-9]")).alias("value"))


@query("SELECT item_id, text AS source, length(text)::BIGINT AS target FROM benchmark")
def scan_pairs_strict(spark, sf):
    """Pairs; none at all is an error."""
    return R.nonempty(table(spark, sf, "benchmark"), "benchmark").select("item_id", F.col("text").alias("source"), F.length("text").cast("long").alias("target"))


@query("SELECT p_name AS source, p_type AS target FROM part WHERE p_name IS NOT NULL AND p_type IS NOT NULL")
def scan_finetune_pairs(spark, sf):
    pairs = table(spark, sf, "part").select(F.to_json(F.struct(F.col("p_name").alias("source"), F.col("p_type").alias("target"))).alias("j"))
    return pairs.select(F.from_json("j", "source STRING, target STRING").alias("r")).select("r.*").where("source IS NOT NULL AND target IS NOT NULL")


@query("SELECT conv_id, count(*) AS n_sequences, sum(length(text))::BIGINT AS n_tokens FROM conversations GROUP BY conv_id")
def scan_token_corpus(spark, sf):
    """A corpus of code points, one shard a conversation: sequences and tokens."""
    rows = table(spark, sf, "conversations").select("conv_id", F.transform(F.split("text", ""), F.ascii).alias("ids"))
    return rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_sequences"), F.sum(F.size("ids")).cast("long").alias("n_tokens"))


@query(f"SELECT count(*) AS n_entries, true AS sorted_ok FROM (SELECT DISTINCT {Q.md5_long('text')} AS h FROM documents)")
def scan_hash_index(spark, sf):
    """An index's entry count equals its distinct keys, and they are sorted and distinct."""
    h = table(spark, sf, "documents").select(X.md5_long(F.col("text")).alias("h"))
    a, b = h.distinct(), h.groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    n = a.agg(F.count(F.lit(1)).alias("n_entries"))
    return n.crossJoin(F.broadcast(b.agg(F.count(F.lit(1)).alias("m")))).select("n_entries", (F.col("n_entries") == F.col("m")).alias("sorted_ok"))


@query("SELECT space, CASE WHEN said IS NOT NULL AND wish IS NOT NULL AND said <> wish THEN 'conflict' WHEN said IS NULL AND wish IS NULL THEN 'unknown' ELSE coalesce(said, wish) END AS resolved FROM (VALUES (1, 'psmiles', NULL), (2, 'psmiles', 'canonical'), (3, NULL, 'canonical'), (4, NULL, NULL)) v(space, said, wish)")
def scan_dedup_sidecar(spark, sf):
    """The space of an index: what it says, else the wish; contradictions and silence are named."""
    rows = spark.createDataFrame([(1, "psmiles", None), (2, "psmiles", "canonical"), (3, None, "canonical"), (4, None, None)], "space int, said string, wish string")
    conflict = F.col("said").isNotNull() & F.col("wish").isNotNull() & (F.col("said") != F.col("wish"))
    return rows.select("space", F.when(conflict, "conflict").when(F.col("said").isNull() & F.col("wish").isNull(), "unknown").otherwise(F.coalesce("said", "wish")).alias("resolved"))


SOURCES = [("part", "part.parquet", "generated", 100_000, False), ("lineitem", "lineitem.parquet", "generated", 10_000_000, True), ("documents", "documents.parquet", "generated", 20_000_000, True)]


@query("SELECT * FROM (VALUES " + ", ".join(f"('{n}', '{f}', '{li}', {b}::BIGINT, {str(c).lower()})" for n, f, li, b, c in SOURCES) + ") v(name, filename, license, bytes, confirm)")
def source_registry(spark, sf):
    return R.source_registry(spark, SOURCES)


RUNS = ["arm_a", "arm_a_seed1", "arm_a_seed01", "arm_a_seed0", "arm_b_seed12", "arm_b_seed", "arm_b_seed-3"]


@query("SELECT run, CASE WHEN NOT contains(run, '_seed') THEN 0 WHEN regexp_extract(run, '_seed(0|-?[1-9]\\d*)$', 1) <> '' THEN regexp_extract(run, '_seed(0|-?[1-9]\\d*)$', 1)::BIGINT END AS seed FROM (SELECT unnest([" + ", ".join(f"'{r}'" for r in RUNS) + "]) AS run)")
def run_discovery(spark, sf):
    return spark.createDataFrame([(r,) for r in RUNS], "run string").select("run", X.seed_of_run(F.col("run")).alias("seed"))


@query("SELECT count(*) AS n_sequences, sum(length(text))::BIGINT AS n_tokens, 'uint32' AS dtype, sha256(string_agg(p_type, chr(10) ORDER BY p_type)) AS tokenizer_sha256 FROM conversations, (SELECT DISTINCT p_type FROM part WHERE p_partkey < 20) GROUP BY ALL HAVING false UNION ALL SELECT (SELECT count(*) FROM conversations), (SELECT sum(length(text))::BIGINT FROM conversations), 'uint32', (SELECT sha256(string_agg(t, chr(10) ORDER BY t)) FROM (SELECT DISTINCT p_type AS t FROM part))")
def write_corpus_metadata(spark, sf):
    """The metadata row of a corpus, with its vocabulary's digest."""
    c = table(spark, sf, "conversations").agg(F.count(F.lit(1)).alias("n_sequences"), F.sum(F.length("text")).cast("long").alias("n_tokens"))
    v = table(spark, sf, "part").select("p_type").distinct().agg(F.sha2(F.array_join(F.sort_array(F.collect_list("p_type")), "\n"), 256).alias("tokenizer_sha256"))
    return c.crossJoin(F.broadcast(v)).select("n_sequences", "n_tokens", F.lit("uint32").alias("dtype"), "tokenizer_sha256")


@query(f"SELECT DISTINCT {Q.md5_long('text')} AS h FROM documents WHERE text IS NOT NULL")
def write_hash_index(spark, sf):
    """What an index file holds: distinct keys, range-partitioned and sorted within files."""
    h = table(spark, sf, "documents").where("text IS NOT NULL").select(X.md5_long(F.col("text")).alias("h"))
    return h.distinct().repartitionByRange("h").sortWithinPartitions("h")


@query("SELECT part, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS fraction FROM (SELECT CASE WHEN r <= round_even(0.9 * n, 0) THEN 'train' WHEN r <= round_even((0.9 + 0.05) * n, 0) THEN 'val' ELSE 'test' END AS part FROM (SELECT row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) AS r, count(*) OVER () AS n FROM documents)) GROUP BY part")
def write_splits(spark, sf):
    """Sizes and fractions that a split's metadata states."""
    s = C.random_split(table(spark, sf, "documents").select("doc_id"), "doc_id", {"train": 0.9, "val": 0.05, "test": 0.05}, 42).groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    return s.crossJoin(F.broadcast(s.agg(F.sum("n").alias("t")))).select("part", "n", F.round(F.col("n") / F.col("t"), 6).alias("fraction"))


@query("SELECT event_id, value, NULL::BIGINT AS step, event_type FROM events WHERE event_type <> 'signup' UNION ALL SELECT event_id, NULL, event_id * 2, event_type FROM events WHERE event_type = 'signup'")
def log_metrics(spark, sf):
    """A log that later rows widen."""
    e = table(spark, sf, "events")
    old = e.where("event_type <> 'signup'").select("event_id", "value", "event_type")
    new = e.where("event_type = 'signup'").select("event_id", (F.col("event_id") * 2).alias("step"), "event_type")
    return W.log_metrics(old, new)


@query("SELECT id::BIGINT AS id, token || chr(9) || '0' AS line FROM (SELECT n_nationkey AS id, n_name AS token FROM nation) ORDER BY id")
def vocab_save(spark, sf):
    """Lines of the side file, in identifier order."""
    n = table(spark, sf, "nation")
    return n.select(F.col("n_nationkey").cast("long").alias("id"), F.concat("n_name", F.lit("\t0")).alias("line")).orderBy("id")


@query("SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber < 7 THEN l_quantity END AS x FROM lineitem WHERE l_linenumber < 7 AND isfinite(l_quantity)")
def finite_filter(spark, sf):
    x = F.when(F.col("l_linenumber") < 7, F.col("l_quantity"))
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", x.alias("x")).where(is_finite(F.col("x")))


@query("SELECT doc_id FROM documents ORDER BY doc_id LIMIT 25")
def limit_rows(spark, sf):
    return table(spark, sf, "documents").select("doc_id").orderBy("doc_id").limit(25)


@query(f"SELECT count_if({Q.canonical('text')} = '')::BIGINT AS n_bad, count(*) AS n, count_if({Q.canonical('text')} = '') / count(*) <= 0.05 AS passed FROM documents")
def max_drop_guard(spark, sf):
    bad = X.canonical(F.col("text")) == ""
    return table(spark, sf, "documents").agg(F.count_if(bad).alias("n_bad"), F.count(F.lit(1)).alias("n")).select("*", (F.col("n_bad") / F.col("n") <= 0.05).alias("passed"))


@query(f"SELECT doc_id, {Q.canonical('text')} <> '' AS valid, len(regexp_extract_all(text, '[.!?]'))::BIGINT AS n_ends, CASE WHEN {Q.canonical('text')} = '' THEN 'empty_input' WHEN NOT regexp_matches(text, '[.!?]\\s*$') THEN 'wrong_end' END AS reason FROM documents")
def validate(spark, sf):
    """The text analogue of a validator: valid, ends, reason."""
    c = X.canonical(F.col("text"))
    n = F.size(F.regexp_extract_all("text", F.lit("[.!?]"), F.lit(0))).cast("long")
    return table(spark, sf, "documents").select("doc_id", (c != "").alias("valid"), n.alias("n_ends"), F.when(c == "", "empty_input").when(~F.col("text").rlike(r"[.!?]\s*$"), "wrong_end").alias("reason"))


@query(f"SELECT doc_id, CASE WHEN {Q.canonical('text')} = '' OR lang <> 'en' THEN 0 ELSE 1 END::DOUBLE AS value, ({Q.canonical('text')} = '' OR lang <> 'en') AS gated FROM documents")
def validity_gate(spark, sf):
    ok = (X.canonical(F.col("text")) != "") & (F.col("lang") == "en")
    return table(spark, sf, "documents").select("doc_id", ok.cast("double").alias("value"), (~ok).alias("gated"))


@query("SELECT doc_id, n_chars BETWEEN 200 AND 20000 AND lang = 'en' AS passes FROM documents")
def structural_validity(spark, sf):
    return table(spark, sf, "documents").select("doc_id", (F.col("n_chars").between(200, 20000) & (F.col("lang") == "en")).alias("passes"))
