"""Queries of corpus building and screening over documents, labels and benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as X
from ..functions.numbers import safe_ratio
from ..operators import corpus as C
from ..operators import screen as S
from ..registry import query, table
from ..sources.scratch import materialise
from . import sql as Q

CANON = Q.canonical("text")


def _keyed(spark, sf):
    """Documents with the key of their canonical form and their word count, written once: the texts
    are read and brought to canonical form in one pass, whatever follows."""
    docs = table(spark, sf, "documents").withColumn("__c", X.canonical(F.col("text")))
    return materialise(docs.select("doc_id", "lang", "source", "n_chars", X.content_key(F.col("__c")).alias("canonical"), X.n_words(F.col("__c")).alias("words")), "keyed")


def _candidates(spark, sf):
    """Documents that stand for candidates, and those that stand for the training set."""
    docs = _keyed(spark, sf)
    return docs.where("doc_id % 10 <> 0"), docs.where("doc_id % 10 = 0")


def _texts(spark, sf):
    """The same with the canonical texts themselves."""
    docs = table(spark, sf, "documents").withColumn("canonical", X.canonical(F.col("text")))
    return docs.where("doc_id % 10 <> 0"), docs.where("doc_id % 10 = 0")


def _screened(spark, sf):
    candidates, reference = _candidates(spark, sf)
    structure = (F.col("lang") == "en") & F.col("n_chars").between(200, 20000)
    return S.cascade(candidates, "doc_id", "canonical", F.col("words") >= 50, structure, reference)


SCREENED = f"""
    d AS (SELECT *, {CANON} AS canonical FROM documents), r AS (SELECT DISTINCT canonical FROM d WHERE doc_id % 10 = 0),
    c AS (SELECT d.*, ({Q.words('text')}) >= 50 AS passed_sv, r.canonical IS NOT NULL AS known FROM d LEFT JOIN r USING (canonical) WHERE doc_id % 10 <> 0),
    t AS (SELECT *, passed_sv AND NOT known AS passed_tsd FROM c),
    u AS (SELECT *, passed_tsd AND doc_id = min(doc_id) FILTER (passed_tsd) OVER (PARTITION BY canonical) AS passed_dd0 FROM t),
    v AS (SELECT *, coalesce(passed_dd0, false) AS passed_dd FROM u),
    s AS (SELECT *, passed_dd AND lang = 'en' AND n_chars BETWEEN 200 AND 20000 AS passed_pv FROM v)"""
COUNTS = """count(*) AS n_input, count_if(passed_sv)::BIGINT AS n_sv, count_if(passed_tsd)::BIGINT AS n_tsd, count_if(passed_dd)::BIGINT AS n_dd, count_if(passed_pv)::BIGINT AS n_pv,
    round(count_if(passed_sv) / count(*), 6) AS sv_rate, round(count_if(passed_tsd) / count(*), 6) AS tsd_rate, round(count_if(passed_dd) / count(*), 6) AS dd_rate, round(count_if(passed_pv) / count(*), 6) AS pv_rate"""


@query(f"""WITH {SCREENED} SELECT doc_id, passed_sv, passed_tsd, passed_dd, passed_pv,
    CASE WHEN NOT passed_sv THEN 'SV' WHEN NOT passed_tsd THEN 'TSD' WHEN NOT passed_dd THEN 'DD' WHEN NOT passed_pv THEN 'PV' END AS failure_stage FROM s""")
def cascade_records(spark, sf):
    return _screened(spark, sf).select("doc_id", "passed_sv", "passed_tsd", "passed_dd", "passed_pv", "failure_stage")


@query(f"WITH {SCREENED} SELECT {COUNTS} FROM s")
def cascade_counts(spark, sf):
    return S.cascade_counts(_screened(spark, sf))


@query(f"WITH {SCREENED} SELECT lang, {COUNTS} FROM s GROUP BY lang")
def cascade_by_lang(spark, sf):
    return S.cascade_counts(_screened(spark, sf), ["lang"])


@query(f"WITH {SCREENED} SELECT CASE WHEN NOT passed_sv THEN 'SV' WHEN NOT passed_tsd THEN 'TSD' WHEN NOT passed_dd THEN 'DD' WHEN NOT passed_pv THEN 'PV' END AS failure_stage, count(*) AS n FROM s GROUP BY 1")
def failure_stage(spark, sf):
    return _screened(spark, sf).groupBy("failure_stage").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {SCREENED} SELECT doc_id, canonical AS form FROM s WHERE passed_dd")
def scored_candidates(spark, sf):
    """Rows that reach a stage, with the string to score and their position."""
    reached = _screened(spark, sf).where("passed_dd").select("doc_id")
    return table(spark, sf, "documents").join(reached, "doc_id").select("doc_id", X.canonical(F.col("text")).alias("form"))


@query(f"WITH {SCREENED} SELECT doc_id, lang, passed_pv FROM s WHERE passed_tsd")
def survivor_align_join(spark, sf):
    """Survivors keep their own target beside them: no join."""
    return _screened(spark, sf).where("passed_tsd").select("doc_id", "lang", "passed_pv")


def _attrition(spark, sf):
    c = F.col("__c")
    docs = table(spark, sf, "documents").withColumn("__c", X.canonical(F.col("text")))
    small = docs.select("doc_id", "lang", "source", "n_chars", X.content_key(c).alias("canonical"), X.n_words(c).alias("words"), F.col("text").rlike(r"[.!?]\s*$").alias("ends"), F.col("text").contains("#").alias("marked"))
    checks = [("n_parse_failed", F.col("words") >= 20), ("n_wrong_termini", F.col("ends")), ("n_encode_failed", ~F.col("marked")), ("n_too_long", F.col("words") <= 1000)]
    return C.attrition(materialise(small, "attrition"), "doc_id", checks, "canonical")


def _kept(spark, sf):
    """The rows that attrition keeps, with their canonical texts."""
    kept = _attrition(spark, sf).where("bucket = 'n_kept'").select("doc_id")
    return table(spark, sf, "documents").join(kept, "doc_id").withColumn("canonical", X.canonical(F.col("text")))


ATTRITION = f"""
    d AS (SELECT *, {CANON} AS canonical, {Q.words('text')} AS w FROM documents),
    f AS (SELECT *, CASE WHEN w < 20 THEN 'n_parse_failed' WHEN NOT regexp_matches(text, '[.!?]\\s*$') THEN 'n_wrong_termini' WHEN contains(text, '#') THEN 'n_encode_failed' WHEN w > 1000 THEN 'n_too_long' END AS failed FROM d),
    b AS (SELECT *, coalesce(failed, CASE WHEN doc_id > min(doc_id) FILTER (failed IS NULL) OVER (PARTITION BY canonical) THEN 'n_duplicate' ELSE 'n_kept' END) AS bucket FROM f)"""
BUCKET_COUNTS = "count(*) AS n_input, " + ", ".join(f"count_if(bucket = '{b}')::BIGINT AS {b}" for b in C.BUCKETS)


@query(f"WITH {ATTRITION} SELECT doc_id, bucket FROM b")
def attrition_bucket(spark, sf):
    return _attrition(spark, sf).select("doc_id", "bucket")


@query(f"WITH {ATTRITION} SELECT {BUCKET_COUNTS} FROM b")
def attrition_stats(spark, sf):
    return C.attrition_stats(_attrition(spark, sf))


@query(f"WITH {ATTRITION} SELECT source, {BUCKET_COUNTS} FROM b GROUP BY source")
def attrition_by_source(spark, sf):
    return C.attrition_stats(_attrition(spark, sf), ["source"])


@query(f"WITH {ATTRITION} SELECT doc_id, canonical FROM b WHERE bucket = 'n_kept'")
def prepare_corpus(spark, sf):
    return _kept(spark, sf).select("doc_id", "canonical")


@query(f"WITH {ATTRITION} SELECT doc_id, canonical, quality FROM b JOIN labels USING (doc_id) WHERE bucket = 'n_kept'")
def prepare_labelled(spark, sf):
    """The kept rows with their labels: of copies the first row's label wins."""
    return _kept(spark, sf).select("doc_id", "canonical").join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id")


@query(f"WITH {ATTRITION} SELECT doc_id, lang, source, n_chars FROM b WHERE bucket = 'n_kept'")
def prepare_labelled_rows(spark, sf):
    """Whole records ride along the same filters."""
    record = F.struct("lang", "source", "n_chars")
    return _attrition(spark, sf).withColumn("record", record).where("bucket = 'n_kept'").select("doc_id", "record.*")


@query(f"SELECT doc_id, ({Q.words('text')})::BIGINT AS n_tokens FROM documents WHERE ({Q.words('text')}) <= 200")
def length_filter(spark, sf):
    n = X.n_words(X.canonical(F.col("text"))).cast("long")
    return table(spark, sf, "documents").select("doc_id", n.alias("n_tokens")).where("n_tokens <= 200")


@query(f"SELECT min(doc_id) AS doc_id, {CANON} AS canonical FROM documents GROUP BY 2")
def keep_first_dedup(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", X.canonical(F.col("text")).alias("canonical"))
    return C.keep_first(docs, ["canonical"], "doc_id")


@query(f"SELECT {CANON} AS canonical, min(doc_id) AS first FROM documents GROUP BY 1 ORDER BY first")
def ordered_distinct(spark, sf):
    """Distinct values in order of first occurrence."""
    docs = table(spark, sf, "documents").select("doc_id", X.canonical(F.col("text")).alias("canonical"))
    return docs.groupBy("canonical").agg(F.min("doc_id").alias("first")).orderBy("first")


@query(f"SELECT canonical, count(*) AS n FROM (SELECT {CANON} AS canonical FROM documents) GROUP BY 1 HAVING count(*) > 1 ORDER BY n DESC, canonical LIMIT 20")
def most_common(spark, sf):
    docs = table(spark, sf, "documents").select(X.canonical(F.col("text")).alias("canonical"))
    return docs.groupBy("canonical").agg(F.count(F.lit(1)).alias("n")).where("n > 1").orderBy(F.desc("n"), "canonical").limit(20)


@query(f"SELECT DISTINCT {Q.md5_long(CANON)} AS h FROM documents ORDER BY h")
def sort_unique(spark, sf):
    docs = table(spark, sf, "documents").select(X.md5_long(X.canonical(F.col("text"))).alias("h"))
    return docs.distinct().orderBy("h")


NOVEL = f"d AS (SELECT *, {CANON} AS canonical FROM documents), r AS (SELECT DISTINCT canonical FROM d WHERE doc_id % 10 = 0), c AS (SELECT * FROM d WHERE doc_id % 10 <> 0)"


@query(f"WITH {NOVEL} SELECT doc_id FROM c ANTI JOIN r USING (canonical)")
def novel_anti_join(spark, sf):
    candidates, reference = _candidates(spark, sf)
    return C.novel(candidates, reference, "canonical").select("doc_id")


@query(f"WITH {NOVEL} SELECT doc_id, r.canonical IS NOT NULL AS is_member FROM c LEFT JOIN r USING (canonical)")
def member_semi_join(spark, sf):
    """Membership by a 64-bit key of the canonical form."""
    candidates, reference = _candidates(spark, sf)
    key = F.xxhash64("canonical")
    return C.member_flag(candidates.withColumn("h", key), reference.withColumn("h", key), "h").select("doc_id", "is_member")


@query("SELECT DISTINCT d.doc_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def novel_theta_contains(spark, sf):
    """Documents that contain a benchmark text."""
    return C.containing(table(spark, sf, "documents"), table(spark, sf, "benchmark"), "text", "text").select("doc_id")


@query(f"WITH {NOVEL} SELECT round(count_if(r.canonical IS NULL) / count(*), 6) AS novelty_rate, count(*) AS n FROM c LEFT JOIN r USING (canonical)")
def novelty_rate(spark, sf):
    candidates, reference = _candidates(spark, sf)
    flagged = C.member_flag(candidates, reference, "canonical")
    return flagged.agg(F.round(safe_ratio(F.count_if(~F.col("is_member")), F.count(F.lit(1))), 6).alias("novelty_rate"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {NOVEL} SELECT canonical FROM c EXCEPT SELECT canonical FROM r")
def except_novel(spark, sf):
    candidates, reference = _texts(spark, sf)
    return candidates.select("canonical").distinct().join(reference.select("canonical"), "canonical", "left_anti")


@query(f"WITH {NOVEL} SELECT canonical FROM c INTERSECT SELECT canonical FROM r")
def intersect_overlap(spark, sf):
    candidates, reference = _texts(spark, sf)
    return candidates.select("canonical").intersect(reference.select("canonical"))


@query(f"WITH {NOVEL}, u AS (SELECT doc_id, canonical, 'candidate' AS origin FROM c UNION ALL SELECT doc_id, canonical, 'reference' FROM d WHERE doc_id % 10 = 0) SELECT origin, count(*) AS n, count(DISTINCT canonical) AS n_distinct FROM u GROUP BY origin")
def union_concat(spark, sf):
    candidates, reference = _candidates(spark, sf)
    both = candidates.select("canonical", F.lit("candidate").alias("origin")).unionByName(reference.select("canonical", F.lit("reference").alias("origin")))
    return both.groupBy("origin").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("canonical").alias("n_distinct"))


@query(f"WITH {NOVEL}, k AS (SELECT r.canonical FROM r JOIN d USING (canonical) WHERE doc_id % 10 = 0) SELECT count(*) AS n_probed, count(*) AS n_hit, 1.0::DOUBLE AS hit_rate, true AS passed FROM k")
def self_check(spark, sf):
    """The index finds its own members: share of hits and whether it reaches 0.99."""
    _, reference = _candidates(spark, sf)
    key = F.xxhash64("canonical")
    hits = C.member_flag(reference.withColumn("h", key), reference.withColumn("h", key), "h")
    out = hits.agg(F.count(F.lit(1)).alias("n_probed"), F.count_if("is_member").alias("n_hit"))
    return out.select("*", safe_ratio(F.col("n_hit"), F.col("n_probed")).alias("hit_rate"), (safe_ratio(F.col("n_hit"), F.col("n_probed")) >= 0.99).alias("passed"))


def _ranked(seed: str, of: str = "documents", key: str = "doc_id") -> str:
    return f"SELECT {key}, row_number() OVER (ORDER BY md5('{seed}:' || {key}), {key}) AS rank, count(*) OVER () AS n FROM {of}"


@query(f"SELECT doc_id, CASE WHEN rank <= round_even(0.9 * n, 0) THEN 'train' WHEN rank <= round_even((0.9 + 0.05) * n, 0) THEN 'val' ELSE 'test' END AS part FROM ({_ranked('17')})")
def random_split(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return C.random_split(docs, "doc_id", {"train": 0.9, "val": 0.05, "test": 0.05}, 17).select("doc_id", "part")


@query(f"SELECT part, count(*) AS n FROM (SELECT CASE WHEN rank <= round_even(0.9 * n, 0) THEN 'train' WHEN rank <= round_even((0.9 + 0.05) * n, 0) THEN 'val' ELSE 'test' END AS part FROM ({_ranked('42')})) GROUP BY part")
def pretrain_split_sizes(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return C.random_split(docs, "doc_id", {"train": 0.9, "val": 0.05, "test": 0.05}, 42).groupBy("part").agg(F.count(F.lit(1)).alias("n"))


FOLDS = " UNION ALL ".join(f"SELECT doc_id, {i}::BIGINT AS split_no, CASE WHEN rank <= round_even(0.8 * n, 0) THEN 'train' ELSE 'test' END AS part FROM ({_ranked(str(100 + i))})" for i in range(5))


@query(FOLDS)
def kfold_random(spark, sf):
    return C.kfold_splits(table(spark, sf, "documents"), "doc_id", 5, 0.2, 100)


@query(f"""WITH s AS (SELECT doc_id, rank, n, round_even(0.8 * n, 0) AS n_train FROM ({_ranked('5')}))
    SELECT doc_id, CASE WHEN rank > n_train THEN 'test' WHEN rank <= round_even(n_train * 0.1, 0) THEN 'val' ELSE 'train' END AS part FROM s""")
def val_carve(spark, sf):
    """The first tenth of the shuffled train pool becomes val."""
    docs = table(spark, sf, "documents").select("doc_id")
    ranked = C.split_rank(docs, "doc_id", 5).crossJoin(F.broadcast(docs.agg(F.count(F.lit(1)).alias("n"))))
    n_train = F.bround(F.lit(0.8) * F.col("n"), 0)
    part = F.when(F.col("rank") > n_train, "test").when(F.col("rank") <= F.bround(n_train * 0.1, 0), "val").otherwise("train")
    return ranked.select("doc_id", part.alias("part"))


@query(f"WITH f AS ({FOLDS}) SELECT split_no, count(*) AS n_rows, count(DISTINCT doc_id) AS n_ids, count(*) = (SELECT count(*) FROM documents) AS covers, count(*) = count(DISTINCT doc_id) AS disjoint FROM f GROUP BY split_no")
def split_disjoint_check(spark, sf):
    """Parts are disjoint and cover all rows."""
    docs = table(spark, sf, "documents").select("doc_id")
    folds = C.kfold_splits(docs, "doc_id", 5, 0.2, 100)
    n = docs.agg(F.count(F.lit(1)).alias("n"))
    g = folds.groupBy("split_no").agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct("doc_id").alias("n_ids"))
    return g.crossJoin(F.broadcast(n)).select("split_no", "n_rows", "n_ids", (F.col("n_rows") == F.col("n")).alias("covers"), (F.col("n_rows") == F.col("n_ids")).alias("disjoint"))


@query(f"WITH f AS ({FOLDS}) SELECT a.split_no AS a, b.split_no AS b, count(*) AS n_shared FROM f a JOIN f b ON a.doc_id = b.doc_id AND a.split_no < b.split_no WHERE a.part = 'test' AND b.part = 'test' GROUP BY ALL")
def split_overlap(spark, sf):
    """Rows that two splits' test parts share."""
    test = C.kfold_splits(table(spark, sf, "documents"), "doc_id", 5, 0.2, 100).where("part = 'test'").select("doc_id", "split_no")
    a, b = test.alias("a"), test.alias("b")
    return a.join(b, (F.col("a.doc_id") == F.col("b.doc_id")) & (F.col("a.split_no") < F.col("b.split_no"))).groupBy(F.col("a.split_no").alias("a"), F.col("b.split_no").alias("b")).agg(F.count(F.lit(1)).alias("n_shared"))


@query(f"WITH f AS ({FOLDS}) SELECT doc_id FROM f WHERE split_no = 0 AND part = 'test'")
def load_split(spark, sf):
    return C.kfold_splits(table(spark, sf, "documents"), "doc_id", 5, 0.2, 100).where("split_no = 0 AND part = 'test'").select("doc_id")


@query(f"WITH f AS ({FOLDS}) SELECT count(DISTINCT split_no) AS n_splits, count_if(k > 1)::BIGINT AS n_in_two_parts FROM (SELECT split_no, doc_id, count(DISTINCT part) AS k FROM f GROUP BY ALL)")
def load_frozen_splits(spark, sf):
    """Checks of stored splits: how many, and rows that stand in two parts of one."""
    folds = C.kfold_splits(table(spark, sf, "documents"), "doc_id", 5, 0.2, 100)
    k = folds.groupBy("split_no", "doc_id").agg(F.count_distinct("part").alias("k"))
    return k.agg(F.count_distinct("split_no").alias("n_splits"), F.count_if(F.col("k") > 1).alias("n_in_two_parts"))


@query(f"WITH f AS ({FOLDS}), t AS (SELECT doc_id, text FROM documents) SELECT t.doc_id, length(text) AS n_chars FROM t JOIN f USING (doc_id) WHERE split_no = 1 AND part = 'test'")
def index_lookup_join(spark, sf):
    """Rows that an index list names."""
    index = C.kfold_splits(table(spark, sf, "documents"), "doc_id", 5, 0.2, 100).where("split_no = 1 AND part = 'test'")
    return table(spark, sf, "documents").join(index.select("doc_id"), "doc_id").select("doc_id", F.length("text").cast("long").alias("n_chars"))


@query(f"WITH f AS ({FOLDS}) SELECT d.doc_id FROM documents d SEMI JOIN (SELECT doc_id FROM f WHERE split_no = 2 AND part = 'train') i ON d.doc_id = i.doc_id")
def corpus_view(spark, sf):
    view = C.kfold_splits(table(spark, sf, "documents"), "doc_id", 5, 0.2, 100).where("split_no = 2 AND part = 'train'")
    return table(spark, sf, "documents").join(view.select("doc_id"), "doc_id", "left_semi").select("doc_id")


@query(f"SELECT doc_id, CASE WHEN rank <= 60 THEN 'calibration' ELSE 'rest' END AS part FROM ({_ranked('3')})")
def calibration_split(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id")
    return C.split_rank(docs, "doc_id", 3).select("doc_id", F.when(F.col("rank") <= 60, "calibration").otherwise("rest").alias("part"))


@query(f"SELECT doc_id FROM ({_ranked('9')}) WHERE rank <= 100")
def sample_cap(spark, sf):
    """A seeded sample of a hundred without replacement: a top-k, each task sends k rows at most."""
    docs = table(spark, sf, "documents").select("doc_id", F.md5(F.concat(F.lit("9:"), F.col("doc_id").cast("string"))).alias("h"))
    return docs.orderBy("h", "doc_id").limit(100).select("doc_id")


@query("SELECT step, doc_id FROM (SELECT s.step, doc_id, row_number() OVER (PARTITION BY s.step ORDER BY md5('replay:' || s.step || ':' || doc_id), doc_id) AS rn FROM documents, (SELECT unnest([1, 2, 3])::BIGINT AS step) s) WHERE rn <= 16")
def replay_sample(spark, sf):
    """Sixteen rows for each step, of a random stream of its own."""
    steps = spark.range(1, 4).withColumnRenamed("id", "step")
    docs = table(spark, sf, "documents").select("doc_id").crossJoin(F.broadcast(steps))
    hashed = docs.withColumn("h", F.md5(F.concat(F.lit("replay:"), F.col("step").cast("string"), F.lit(":"), F.col("doc_id").cast("string"))))
    from pyspark.sql import Window

    return hashed.withColumn("rn", F.row_number().over(Window.partitionBy("step").orderBy("h", "doc_id"))).where("rn <= 16").select("step", "doc_id")


@query("SELECT doc_id, quality, toxic FROM labels WHERE NOT coalesce(toxic = 1, false)")
def drop_flagged(spark, sf):
    return table(spark, sf, "labels").where(~F.coalesce(F.col("toxic") == 1, F.lit(False)))


@query(f"WITH p AS (SELECT doc_id, CASE WHEN rank <= round_even(0.8 * n, 0) THEN 'train' WHEN rank <= round_even((0.8 + 0.1) * n, 0) THEN 'val' ELSE 'test' END AS part FROM ({_ranked('8', 'labels')})) SELECT doc_id, part, toxic FROM p JOIN labels USING (doc_id) WHERE NOT (part IN ('train', 'val') AND coalesce(toxic = 1, false))")
def drop_flagged_guarded(spark, sf):
    labels = table(spark, sf, "labels")
    parts = C.random_split(labels, "doc_id", {"train": 0.8, "val": 0.1, "test": 0.1}, 8)
    return C.guarded_drop(parts, "part", F.col("toxic") == 1).select("doc_id", "part", "toxic")


@query("WITH w AS (SELECT l_orderkey, l_linenumber, 1 / greatest(l_quantity, 5.6::DOUBLE) AS w FROM lineitem) SELECT l_orderkey, l_linenumber, round(w / avg(w) OVER (), 6) AS weight FROM w")
def reliability_weight(spark, sf):
    return C.mean_one_weight(table(spark, sf, "lineitem"), "l_quantity").select("l_orderkey", "l_linenumber", F.round("weight", 6).alias("weight"))


LONG = "SELECT vec_id, unnest(range(0, len(embedding))) AS dim, unnest(embedding)::DOUBLE AS x FROM embeddings"
FIT = f"SELECT dim::BIGINT AS dim, avg(x) AS mean, stddev_pop(x) AS std, bool_and(isfinite(x)) AND stddev_pop(x) > 1e-8 AS keep FROM ({LONG}) GROUP BY dim"


@query(f"SELECT dim, round(mean, 6) AS mean, round(std, 6) AS std, keep FROM ({FIT})")
def standardise_fit(spark, sf):
    return C.standardise_fit(table(spark, sf, "embeddings"), "embedding").select("dim", F.round("mean", 6).alias("mean"), F.round("std", 6).alias("std"), "keep")


@query(f"SELECT vec_id, l.dim::BIGINT AS dim, round((x - mean) / std, 5) + 0.0 AS z FROM ({LONG}) l JOIN ({FIT}) f ON l.dim = f.dim WHERE keep")
def standardise_transform(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return C.standardise_apply(vectors, "vec_id", "embedding", C.standardise_fit(vectors, "embedding")).select("vec_id", "dim", (F.round("z", 5) + 0.0).alias("z"))


@query(f"SELECT vec_id, l.dim::BIGINT AS dim, round(x * std + mean, 5) + 0.0 AS z FROM ({LONG}) l JOIN ({FIT}) f ON l.dim = f.dim WHERE keep")
def standardise_inverse(spark, sf):
    vectors = table(spark, sf, "embeddings")
    return C.standardise_apply(vectors, "vec_id", "embedding", C.standardise_fit(vectors, "embedding"), inverse=True).select("vec_id", "dim", (F.round("z", 5) + 0.0).alias("z"))


@query("SELECT doc_id, round((quality - m) / s, 6) AS z FROM labels, (SELECT avg(quality) AS m, stddev_pop(quality) AS s FROM labels)")
def target_standardise(spark, sf):
    labels = table(spark, sf, "labels")
    fitted = labels.agg(F.avg("quality").alias("m"), F.stddev_pop("quality").alias("s"))
    return labels.crossJoin(F.broadcast(fitted)).select("doc_id", F.round((F.col("quality") - F.col("m")) / F.col("s"), 6).alias("z"))
