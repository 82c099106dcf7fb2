"""Queries of the grammar, vocabularies and token arrays. Part names stand for token strings: every
word of a text becomes a bracket group."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators import tokens as T
from ..registry import query, table
from . import sql as Q

#: A bracket string of each conversation turn: its words in brackets.
GROUPS = r"'[' || array_to_string(string_split_regex(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+'), '][') || ']'"
TURNS = f"t AS (SELECT conv_id, turn, conv_id * 100 + turn AS row_id, {GROUPS} AS s FROM conversations)"
TOK = r"regexp_extract_all(s, '\[[^\]]*\]')"


def _turns(spark, sf):
    c = table(spark, sf, "conversations")
    s = F.concat(F.lit("["), F.array_join(F.split(X.strip(F.col("text")), r"\s+"), "]["), F.lit("]"))
    return c.select("conv_id", "turn", (F.col("conv_id") * 100 + F.col("turn")).alias("row_id"), s.alias("s"))


STARRED = "'*' || p_name || '[*]' || '[' || p_size || '*:' || p_size || ']'"


@query(rf"SELECT p_partkey, replace(regexp_replace({STARRED}, '\[\d*\*(?::\d+)?\]', '[At]', 'g'), '*', '[At]') AS at FROM part")
def star_to_at(spark, sf):
    c = F.concat(F.lit("*"), F.col("p_name"), F.lit("[*]"), F.lit("["), F.col("p_size").cast("string"), F.lit("*:"), F.col("p_size").cast("string"), F.lit("]"))
    return table(spark, sf, "part").select("p_partkey", X.star_to_at(c).alias("at"))


@query("SELECT p_partkey, replace('[At]' || p_name || '[At]', '[At]', '[*]') AS star FROM part")
def at_to_star(spark, sf):
    return table(spark, sf, "part").select("p_partkey", X.at_to_star(F.concat(F.lit("[At]"), F.col("p_name"), F.lit("[At]"))).alias("star"))


@query(f"WITH {TURNS} SELECT row_id, pos::BIGINT AS pos, tok FROM (SELECT row_id, unnest(range(0, len({TOK}))) AS pos, unnest({TOK}) AS tok FROM t)")
def split_tokens(spark, sf):
    return _turns(spark, sf).select("row_id", F.posexplode(X.split_tokens(F.col("s"))).alias("pos", "tok")).withColumn("pos", F.col("pos").cast("long"))


@query(rf"WITH {TURNS} SELECT row_id, len(regexp_extract_all(s, '\[[^\]]+\]'))::BIGINT AS n FROM t")
def count_tokens(spark, sf):
    return _turns(spark, sf).select("row_id", X.count_tokens(F.col("s")).alias("n"))


@query(rf"WITH {TURNS} SELECT row_id, regexp_matches(s, '^(\[[^\[\]]+\])+$') AS pure, regexp_matches(s, '^(\[[^\[\]]+\])([\s\S]*)(\[[^\[\]]+\])$') AND regexp_matches(s, '^(\[[^\[\]]+\])(\[[^\[\]]+\])+$') AND NOT regexp_matches(s, '[\s*]') AS app, regexp_matches(s, '^(\[[^\[\]]*\])+$') AS depth FROM t")
def looks_like_tokens(spark, sf):
    """The three variants of what counts as a token string."""
    s = F.col("s")
    return _turns(spark, sf).select("row_id", X.is_pure_run(s).alias("pure"), X.is_pure_run_of_two(s).alias("app"), X.is_balanced_run(s).alias("depth"))


NUMBERS = ["1.5", " 2 ", "soluble", "nan", "inf", "1d", "1e3", ".5", "5.", "1_000", "", "-0.0", "+7", "1e400", "0x10", "1__0", "--1"]
VALUES = "(SELECT unnest([" + ", ".join(f"'{x}'" for x in NUMBERS) + "]) AS said)"


def _said(spark, sf):
    """Literal cases and the events' own values."""
    cases = spark.createDataFrame([(x,) for x in NUMBERS], "said string")
    return cases.unionByName(table(spark, sf, "events").select(F.col("event_type").alias("said")))


SAID = f"(SELECT said FROM {VALUES} UNION ALL SELECT event_type FROM events)"
STRIPPED = Q.strip("said")


@query(f"SELECT said, CASE WHEN regexp_matches({STRIPPED}, '{Q.STRICT}') AND isfinite(TRY_CAST({STRIPPED} AS DOUBLE)) THEN TRY_CAST({STRIPPED} AS DOUBLE) END AS value FROM {SAID}")
def parse_strict(spark, sf):
    return _said(spark, sf).select("said", X.parse_strict(F.col("said")).alias("value"))


@query(rf"SELECT said, CASE WHEN regexp_matches({STRIPPED}, '^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$') AND isfinite(TRY_CAST(replace({STRIPPED}, '_', '') AS DOUBLE)) THEN TRY_CAST(replace({STRIPPED}, '_', '') AS DOUBLE) END AS value FROM {SAID}")
def parse_permissive(spark, sf):
    return _said(spark, sf).select("said", X.parse_permissive(F.col("said")).alias("value"))


@query("SELECT l_orderkey, l_linenumber, format('{:.1f}', l_tax * 25 + l_quantity / 20) AS said FROM lineitem")
def format_property(spark, sf):
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", X.format_property(F.col("l_tax") * 25 + F.col("l_quantity") / 20).alias("said"))


@query("SELECT format('{:.1f}', p_retailprice) AS source, p_name AS target FROM part")
def build_generation_examples(spark, sf):
    return table(spark, sf, "part").select(X.format_property(F.col("p_retailprice")).alias("source"), F.col("p_name").alias("target"))


@query(f"SELECT doc_id, {Q.md5_long('text')} AS h FROM documents")
def hash64(spark, sf):
    """The hash that engines share; ``blake_hash64`` is the other."""
    return table(spark, sf, "documents").select("doc_id", X.md5_long(F.col("text")).alias("h"))


@query()
def blake_hash64(spark, sf):
    return table(spark, sf, "documents").select("doc_id", X.blake64(F.col("text")).alias("h"))


@query(f"SELECT doc_id, CASE WHEN {Q.canonical('text')} <> '' THEN {Q.md5_long(Q.canonical('text'))} END AS h, {Q.canonical('text')} <> '' AS usable FROM documents")
def hash_space_encode(spark, sf):
    """Strip, bring to the space's form, hash; unusable strings are flagged, not hashed."""
    c = X.canonical(F.col("text"))
    return table(spark, sf, "documents").select("doc_id", F.when(c != "", X.md5_long(c)).alias("h"), (c != "").alias("usable"))


VOCAB = f"{TURNS}, v AS (SELECT tok, count(*) AS n FROM (SELECT unnest({TOK}) AS tok FROM t) GROUP BY tok), k AS (SELECT tok, n, row_number() OVER (ORDER BY n DESC, tok) AS rank FROM v)"


def _vocab(spark, sf, size=200):
    toks = _turns(spark, sf).select(F.explode(X.split_tokens(F.col("s"))).alias("tok"))
    return T.vocab_counts(toks, "tok", size)


@query(f"WITH {VOCAB} SELECT tok, n AS count, rank FROM k WHERE rank <= 200")
def vocab_counts(spark, sf):
    return _vocab(spark, sf)


@query(f"WITH {VOCAB} SELECT r AS rank, coalesce(tok, '<unused_' || r || '>') AS tok FROM (SELECT unnest(range(1, 10001)) AS r) LEFT JOIN (SELECT * FROM k WHERE rank <= 10000) ON rank = r")
def vocab_pad(spark, sf):
    """Ranks beyond the corpus are placeholders."""
    return T.padded_vocab(_vocab(spark, sf, 10000), "tok", 10000)


@query(f"WITH {VOCAB} SELECT sha256(string_agg(tok, chr(10) ORDER BY rank)) AS sha, count(*) AS n FROM k WHERE rank <= 200")
def vocab_sha256(spark, sf):
    v = _vocab(spark, sf).agg(F.sort_array(F.collect_list(F.struct("rank", "tok"))).alias("v"), F.count(F.lit(1)).alias("n"))
    return v.select(F.sha2(F.array_join(F.transform("v", lambda x: x["tok"]), "\n"), 256).alias("sha"), "n")


SPECIAL = [("special", 5), ("sentinel", 100), ("base", 199), ("conditioning", 154)]


@query("SELECT grp, sum(n)::BIGINT AS n, min(first)::BIGINT AS first_id, max(last)::BIGINT AS last_id FROM (VALUES ('special', 5, 0, 4), ('sentinel', 100, 5, 104), ('base', 199, 105, 303), ('conditioning', 154, 304, 457), ('TOTAL', 458, 0, 457)) v(grp, n, first, last) GROUP BY grp")
def vocab_composition(spark, sf):
    """Groups of an assembled vocabulary: counts and identifier ranges, with a total row."""
    at, frames = 0, []
    for name, n in SPECIAL:
        frames.append(spark.range(at, at + n).select(F.lit(name).alias("grp"), "id"))
        at += n
    rows = frames[0]
    for f in frames[1:]:
        rows = rows.unionByName(f)
    g = rows.rollup("grp").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    return g.withColumn("grp", F.coalesce("grp", F.lit("TOTAL")))


@query("SELECT id::BIGINT AS id, CASE WHEN id < 5 THEN '<special_' || id || '>' WHEN id < 105 THEN '<extra_id_' || (id - 5) || '>' WHEN id < 304 THEN '[base_' || (id - 105) || ']' ELSE '<cond_' || (id - 304) || '>' END AS token FROM (SELECT unnest(range(0, 458)) AS id)")
def vocab_assemble(spark, sf):
    i = F.col("id")
    name = lambda p, a, q: F.concat(F.lit(p), (i - a).cast("string"), F.lit(q))
    return spark.range(458).select("id", F.when(i < 5, name("<special_", 0, ">")).when(i < 105, name("<extra_id_", 5, ">")).when(i < 304, name("[base_", 105, "]")).otherwise(name("<cond_", 304, ">")).alias("token"))


@query(f"WITH {VOCAB} SELECT tok, coalesce(k.rank, 0)::BIGINT AS id FROM (SELECT DISTINCT unnest({TOK}) AS tok FROM t) LEFT JOIN (SELECT * FROM k WHERE rank <= 50) k USING (tok)")
def token_id_lookup(spark, sf):
    """Identifier of each token, 0 for those outside the vocabulary."""
    toks = _turns(spark, sf).select(F.explode(X.split_tokens(F.col("s"))).alias("tok")).distinct()
    return toks.join(F.broadcast(_vocab(spark, sf, 50)), "tok", "left").select("tok", F.coalesce("rank", F.lit(0)).cast("long").alias("id"))


#: Token ids by rule, so both engines agree: 10 + md5 % 400.
IDS = f"list_transform({TOK}, lambda x: (10 + {Q.md5_long('x')} % 400)::INT)"
ENC = f"{TURNS}, e AS (SELECT row_id, conv_id, turn, {IDS} AS ids FROM t)"


def _encoded(spark, sf):
    ids = F.transform(X.split_tokens(F.col("s")), lambda x: (F.lit(10) + X.md5_long(x) % 400).cast("int"))
    return _turns(spark, sf).select("row_id", "conv_id", "turn", ids.alias("ids"))


def _joined(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


@query(f"WITH {ENC} SELECT row_id, array_to_string(list_append(ids[1:31], 1), ' ') AS ids FROM e")
def encode_bracket(spark, sf):
    """Ids with the end, cut to 32 so that the end stays last."""
    return _encoded(spark, sf).select("row_id", _joined(T.finish(F.col("ids"), 32)).alias("ids"))


PADDED = f"{ENC}, w AS (SELECT conv_id, (ceil(max(len(ids)) / 8) * 8)::INT AS width FROM e GROUP BY 1), p AS (SELECT e.*, width FROM e JOIN w USING (conv_id))"


@query(f"WITH {PADDED} SELECT row_id, array_to_string(list_resize(ids, width, 0), ' ') AS ids, array_to_string(list_transform(range(1, width + 1), lambda i: (i <= len(ids))::INT), ' ') AS mask FROM p")
def pad_and_mask(spark, sf):
    rows = T.batch_width(_encoded(spark, sf), ["conv_id"], "ids", 8)
    both = rows.select("row_id", T.pad(F.col("ids"), F.col("width")).alias("padded"), T.mask(F.size("ids"), F.col("width")).alias("mask"))
    return both.select("row_id", _joined(F.col("padded")).alias("ids"), _joined(F.col("mask")).alias("mask"))


@query(f"WITH {ENC} SELECT row_id, array_to_string(list_transform(range(1, 65), lambda i: (i <= len(ids))::INT), ' ') AS mask FROM e")
def length_mask(spark, sf):
    """From lengths alone: padding's value may be content."""
    return _encoded(spark, sf).select("row_id", _joined(T.mask(F.size("ids"), F.lit(64))).alias("mask"))


GENERATED = f"{ENC}, g AS (SELECT row_id, list_concat(ids[1:5], [0, 1]::INT[], ids[6:9], [1, 0]::INT[]) AS ids FROM e)"


def _generated(spark, sf):
    a = lambda *x: F.array(*[F.lit(v) for v in x])
    return _encoded(spark, sf).select("row_id", F.concat(F.slice("ids", 1, 5), a(0, 1), F.slice("ids", 6, 4), a(1, 0)).alias("ids"))


@query(f"WITH {GENERATED} SELECT row_id, array_to_string(list_filter(ids[1:list_position(ids, 1) - 1], lambda x: x <> 0), ' ') AS ids FROM g")
def trim_generated(spark, sf):
    return _generated(spark, sf).select("row_id", _joined(T.trim_generated(F.col("ids"))).alias("ids"))


@query(f"WITH {GENERATED} SELECT row_id, array_to_string(list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN i > list_position(ids, 1) THEN 0 ELSE ids[i] END), ' ') AS ids, list_position(ids, 1)::BIGINT AS length FROM g")
def freeze_after_eos(spark, sf):
    """The length counts the end itself."""
    return _generated(spark, sf).select("row_id", _joined(T.freeze_after(F.col("ids"))).alias("ids"), F.array_position("ids", F.lit(1)).cast("long").alias("length"))


@query(f"WITH {ENC}, d AS (SELECT row_id, list_filter(ids, lambda x: x % 7 <> 0) AS kept FROM e) SELECT row_id, array_to_string(list_transform(kept, lambda x: 't' || x), '') AS text FROM d")
def decode_tokens(spark, sf):
    """Reserved ids (here multiples of seven) are dropped, the others looked up and joined."""
    kept = F.filter("ids", lambda x: x % 7 != 0)
    return _encoded(spark, sf).select("row_id", F.array_join(F.transform(kept, lambda x: F.concat(F.lit("t"), x.cast("string"))), "").alias("text"))


CORRUPT = f"{ENC}, c AS (SELECT row_id, list_append(ids, 1) AS ids FROM e)"
#: Forced spans where a row is long enough; a shorter one stays as it is, with empty labels.
FORCED = "CASE WHEN len(ids) >= 13 THEN list_concat(ids[1:2], [1032], ids[5:7], [1031], ids[11:]) ELSE ids END"


def _corrupted(spark, sf):
    rows = _encoded(spark, sf).select("row_id", T.finish(F.col("ids")).alias("ids"))
    spans = F.when(F.size("ids") >= 13, F.array(F.struct(F.lit(2).alias("start"), F.lit(2).alias("len")), F.struct(F.lit(7).alias("start"), F.lit(3).alias("len")))).otherwise(F.from_json(F.lit("[]"), "array<struct<start:int,len:int>>"))
    inputs, labels = T.corrupt(F.col("ids"), spans, 1032)
    return rows.select("row_id", "ids", inputs.alias("inputs"), labels.alias("labels"))


@query(f"WITH {CORRUPT} SELECT row_id, array_to_string({FORCED}, ' ') AS inputs, CASE WHEN len(ids) >= 13 THEN array_to_string(list_concat([1032], ids[3:4], [1031], ids[8:10], [1030, 1]), ' ') ELSE '' END AS labels FROM c")
def span_corrupt_forced(spark, sf):
    return _corrupted(spark, sf).select("row_id", _joined(F.col("inputs")).alias("inputs"), _joined(F.col("labels")).alias("labels"))


@query(f"WITH {CORRUPT} SELECT row_id, array_to_string(ids, ' ') AS ids FROM c")
def reconstruct(spark, sf):
    """Corruption undone: equals the source."""
    back = T.reconstruct(F.col("inputs"), F.col("labels"), 1032, 1000)
    return _corrupted(spark, sf).select("row_id", _joined(back).alias("ids"))


def _randomly_corrupted(spark, sf):
    rows = _encoded(spark, sf).select("row_id", T.finish(F.col("ids")).alias("ids"))
    rows = T.hashed_spans(rows, "row_id", "ids", 13)
    inputs, labels = T.corrupt(F.col("ids"), F.col("spans"), 1032)
    return rows.select("row_id", "ids", "spans", inputs.alias("inputs"), labels.alias("labels"))


def _draw(tag, k):
    return Q.md5_unit(f"'13:{tag}:' || row_id || ':' || {k}")


#: Spans as lists of starts s and lengths n, and the corrupted rows.
RANDOM = f"""{CORRUPT}, b AS (SELECT row_id, ids, len(ids) - 1 AS free, least(24, floor(0.15 * (len(ids) - 1) + 1e-9))::BIGINT AS budget, list_transform(range(0, 8), lambda k: floor({_draw('length', 'k')} * 3)::BIGINT + 1) AS l FROM c),
    d AS (SELECT row_id, ids, free, list_filter(list_transform(range(0, 8), lambda k: least(l[k + 1], budget - coalesce(list_sum(l[1:k]), 0)::BIGINT)), lambda x: x > 0) AS n FROM b),
    m AS (SELECT row_id, ids, n, list_sort(list_transform(range(0, len(n)), lambda k: floor({_draw('place', 'k')} * (free - list_sum(n)::BIGINT - len(n) + 2))::BIGINT)) AS marks FROM d),
    s AS (SELECT row_id, ids, n, list_transform(range(0, len(n)), lambda k: marks[k + 1] + coalesce(list_sum(n[1:k]), 0)::BIGINT + k) AS s FROM m),
    x AS (SELECT row_id, ids, n, flatten(list_transform(range(1, len(ids) + 1), lambda i: CASE WHEN list_contains(s, i - 1) THEN [1033 - list_position(s, i - 1)] WHEN len(list_filter(range(1, len(s) + 1), lambda j: i - 1 > s[j] AND i - 1 < s[j] + n[j])) > 0 THEN [] ELSE [ids[i]] END)) AS inputs,
        CASE WHEN len(s) > 0 THEN list_concat(flatten(list_transform(range(1, len(s) + 1), lambda j: list_concat([1033 - j], ids[s[j] + 1:s[j] + n[j]]))), [1032 - len(s), 1]) ELSE [] END AS labels FROM s)"""


@query(f"WITH {RANDOM} SELECT row_id, array_to_string(inputs, ' ') AS inputs, coalesce(array_to_string(labels, ' '), '') AS labels FROM x")
def span_corrupt(spark, sf):
    """Random spans, seeded by row."""
    return _randomly_corrupted(spark, sf).select("row_id", _joined(F.col("inputs")).alias("inputs"), _joined(F.col("labels")).alias("labels"))


@query(f"""WITH {RANDOM}, y AS (SELECT len(n) AS k, coalesce(list_sum(n), 0)::BIGINT AS masked, len(ids) AS n FROM x), z AS (SELECT *, CASE WHEN masked > 0 THEN masked / n END AS part FROM y)
    SELECT round(avg(part), 6) AS mean_fraction, round(median(part), 6) AS median_fraction, round(avg(k) FILTER (masked > 0), 6) AS mean_spans, round(sum(masked) / sum(k), 6) AS mean_span_length, round(count_if(masked = 0) / count(*), 6) AS skipped_fraction FROM z""")
def corruption_stats(spark, sf):
    """Masked share, span counts and lengths over the rows that have spans, and the share skipped."""
    rows = _randomly_corrupted(spark, sf).withColumn("masked", F.aggregate(F.transform("spans", lambda s: s["len"]), F.lit(0), lambda a, x: a + x)).withColumn("n", F.size("ids")).withColumn("k", F.size("spans"))
    did = F.col("masked") > 0
    part = F.when(did, F.col("masked") / F.col("n"))
    return rows.agg(F.round(F.avg(part), 6).alias("mean_fraction"), F.round(F.median(part), 6).alias("median_fraction"), F.round(F.avg(F.when(did, F.col("k"))), 6).alias("mean_spans"), F.round(F.sum("masked") / F.sum("k"), 6).alias("mean_span_length"), F.round(F.count_if(~did) / F.count(F.lit(1)), 6).alias("skipped_fraction"))


@query(f"WITH {ENC} SELECT row_id, sum(len(ids)) OVER (PARTITION BY conv_id ORDER BY turn)::BIGINT AS end, (sum(len(ids)) OVER (PARTITION BY conv_id ORDER BY turn) - len(ids))::BIGINT AS begin FROM e")
def offsets_cumsum(spark, sf):
    """Offsets within a shard (a conversation)."""
    rows = _encoded(spark, sf).withColumn("n", F.size("ids").cast("long"))
    return T.ragged_offsets(rows, ["conv_id"], "turn", "n").select("row_id", "end", "begin")


@query(f"WITH {ENC}, o AS (SELECT row_id, conv_id, turn, sum(len(ids)) OVER (PARTITION BY conv_id ORDER BY turn) AS o FROM e) SELECT row_id, (o - lag(o, 1, 0) OVER (PARTITION BY conv_id ORDER BY turn))::BIGINT AS n FROM o")
def lag_diff_lengths(spark, sf):
    rows = T.ragged_offsets(_encoded(spark, sf).withColumn("n", F.size("ids").cast("long")), ["conv_id"], "turn", "n")
    return rows.select("row_id", (F.col("end") - F.lag("end", 1, 0).over(Window.partitionBy("conv_id").orderBy("turn"))).alias("n"))


@query(f"WITH {ENC} SELECT count(*) AS n_sequences, sum(len(ids))::BIGINT AS n_tokens, min(len(ids))::BIGINT AS min_length, max(len(ids))::BIGINT AS max_length, round(avg(len(ids)), 6) AS mean_length, sum(CASE WHEN row_id % 10 = 0 THEN len(list_filter(ids, lambda x: x = 13)) END)::BIGINT AS sampled_unknown FROM e")
def corpus_stats(spark, sf):
    n = F.size("ids").cast("long")
    unknown = F.when(F.col("row_id") % 10 == 0, F.size(F.filter("ids", lambda x: x == 13)).cast("long"))
    return _encoded(spark, sf).agg(F.count(F.lit(1)).alias("n_sequences"), F.sum(n).alias("n_tokens"), F.min(n).alias("min_length"), F.max(n).alias("max_length"), F.round(F.avg(n), 6).alias("mean_length"), F.sum(unknown).alias("sampled_unknown"))


@query(f"WITH {ENC} SELECT row_id, array_to_string(ids[1:16], ' ') AS ids FROM e")
def lazy_encode(spark, sf):
    """Encoded on read, cut to the window."""
    return _encoded(spark, sf).select("row_id", _joined(F.slice("ids", 1, 16)).alias("ids"))


@query("""WITH l AS (SELECT p_partkey, list_transform(regexp_extract_all(p_name, 'part|the|er|on|th|an|.'), lambda x: CASE WHEN regexp_full_match(x, 'part|the|er|on|th|an|[aeio #0-9]') THEN x ELSE '<unk>' END) AS l FROM part)
    SELECT p_partkey, array_to_string(list_filter(l, lambda x, i: NOT (x = '<unk>' AND i > 1 AND l[i - 1] = '<unk>')), '|') AS tokens FROM l""")
def tokenize_longest_match(spark, sf):
    """Left-to-right longest match over part names."""
    plain = ["a", "e", "i", "o", "er", "on", "th", "the", "an", "part", " ", "#"] + [str(d) for d in range(10)]
    return table(spark, sf, "part").select("p_partkey", F.array_join(T.longest_match(plain, [])(F.col("p_name")), "|").alias("tokens"))


@query(f"SELECT count(DISTINCT text) AS n_distinct, count(*) AS n, round(avg(length(text)), 6) AS mean_score FROM conversations")
def score_distinct_join_back(spark, sf):
    """Distinct keys are scored once and joined back: what a cache does for a costly predictor."""
    turns = table(spark, sf, "conversations")
    scored = turns.select("text").distinct().withColumn("score", F.length("text"))
    return turns.join(scored, "text").agg(F.count_distinct("text").alias("n_distinct"), F.count(F.lit(1)).alias("n"), F.round(F.avg("score"), 6).alias("mean_score"))
