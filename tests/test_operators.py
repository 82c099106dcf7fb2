"""Hand-computed cases and invariants of the operators."""

import pytest
from pyspark.sql import functions as F

from strandline.functions.numbers import is_finite
from strandline.functions.text import canonical
from strandline.operators import compare as K
from strandline.operators import corpus as C
from strandline.operators import metrics as M
from strandline.operators import policy as P
from strandline.operators import screen as S
from strandline.operators import tokens as T


def test_cascade_counts_of_the_eight_cases(spark):
    """Two fail to parse; two are in the reference; one is a copy; two fail the rule; one passes."""
    rows = [(0, None), (1, ""), (2, "known"), (3, "known"), (4, "good"), (5, "good"), (6, "bad one"), (7, "bad two")]
    df = spark.createDataFrame(rows, "pos long, text string").withColumn("canonical", canonical(F.col("text")))
    ref = spark.createDataFrame([("known",), ("never",), (None,)], "canonical string")
    out = S.cascade(df, "pos", "canonical", F.col("canonical") != "", F.col("canonical") == "good", ref)
    assert [r.failure_stage for r in out.orderBy("pos").collect()] == ["SV", "SV", "TSD", "TSD", None, "DD", "PV", "PV"]
    c = S.cascade_counts(out).first()
    assert (c.n_input, c.n_sv, c.n_tsd, c.n_dd, c.n_pv) == (8, 6, 4, 3, 1) and c.pv_rate == 0.125
    empty = S.cascade_counts(out.where("false")).first()
    assert empty.n_input == 0 and empty.sv_rate == 0.0
    no_ref = S.cascade(df, "pos", "canonical", F.col("canonical") != "", F.lit(True))
    assert S.cascade_counts(no_ref).first().n_tsd == 6  # without a reference nothing is known


def test_attrition_partitions_the_input(spark):
    rows = [(0, "[*]CCO[*]"), (1, "*CCO"), (2, "*CC(*)O*"), (3, "not_a_smiles"), (4, "*" + "C" * 250 + "*"), (5, "*OCC*"), (6, "*CCO*")]
    df = spark.createDataFrame(rows, "id long, s string").withColumn("key", F.sort_array(F.split(F.regexp_replace("s", r"\[\*\]|\*", ""), "")).cast("string"))
    ends = F.size(F.regexp_extract_all("s", F.lit(r"\*"), F.lit(0)))
    checks = [("n_parse_failed", F.col("s").contains("*")), ("n_wrong_termini", ends == 2), ("n_encode_failed", F.lit(True)), ("n_too_long", F.length("s") <= 200)]
    out = C.attrition(df, "id", checks, "key")
    assert {r.id: r.bucket for r in out.collect()} == {0: "n_kept", 1: "n_wrong_termini", 2: "n_wrong_termini", 3: "n_parse_failed", 4: "n_too_long", 5: "n_duplicate", 6: "n_duplicate"}
    s = C.attrition_stats(out).first()
    assert s.n_input == sum(s[b] for b in C.BUCKETS) == 7


def test_regression_report(spark):
    df = spark.createDataFrame([(1.0, "1.5"), (2.0, "2.5"), (3.0, "soluble"), (4.0, "3.5")], "t double, said string")
    from strandline.functions.text import parse_strict

    r = M.regression_report(df, F.col("t"), parse_strict(F.col("said"))).first()
    assert (r.n_total, r.n_valid, r.n_non_numeric, r.mae, r.rmse) == (4, 3, 1, 0.5, 0.5)
    flat = M.regression_report(spark.createDataFrame([(1.0, 1.0), (1.0, 2.0)], "t double, p double"), F.col("t"), F.col("p")).first()
    assert flat.r2 is None and flat.pearson is None


def test_over_splits(spark):
    df = spark.createDataFrame([(1.0, None), (2.0, None), (3.0, None)], "mae double, pearson double")
    got = {r.metric: r for r in M.over_splits(df, ["mae", "pearson"]).collect()}
    assert got["mae"]["mean"] == 2.0 and abs(got["mae"]["std"] - (2 / 3) ** 0.5) < 1e-12 and got["mae"]["n"] == 3
    assert got["pearson"]["mean"] is None and got["pearson"]["n"] == 0


@pytest.mark.parametrize("n,alpha,want", [(20, 0.1, 19.0), (10, 0.2, 9.0), (19, 0.1, 18.0), (5, 0.1, None)])
def test_conformal_quantile(spark, n, alpha, want):
    df = spark.createDataFrame([(float(i),) for i in range(n, 0, -1)], "r double")
    assert M.conformal_quantile(df, "r", alpha).first()["quantile"] == want
    by = M.conformal_quantile(df.withColumn("g", F.lit("x")), "r", alpha, ["g"]).first()
    assert by["quantile"] == want
    with pytest.raises(ValueError):
        M.conformal_quantile(df, "r", 1.0)


def test_running_total_and_nearest_rank(spark):
    df = spark.range(1, 1001).select(F.col("id").cast("double").alias("x"), F.lit(1).alias("n")).repartition(5)
    got = {r.x: r.upto for r in M.running_total(df, "x", "n", "upto", stretches=7).collect()}
    assert got == {float(i): i for i in range(1, 1001)}
    assert M.nearest_rank(df, "x", 0.9).first()["value"] == 900.0


@pytest.mark.parametrize("n", [1, 10, 97, 100])
def test_splits_are_exact(spark, n):
    df = spark.range(n).withColumnRenamed("id", "row_id").repartition(3)
    out = C.random_split(df, "row_id", {"train": 0.9, "val": 0.05, "test": 0.05}, 1)
    sizes = {r.part: r["count"] for r in out.groupBy("part").count().collect()}
    a, b = round(0.9 * n), round((0.9 + 0.05) * n)
    assert sizes.get("train", 0) == a and sizes.get("val", 0) == b - a and sizes.get("test", 0) == n - b
    assert sorted(r["rank"] for r in out.collect()) == list(range(1, n + 1))
    with pytest.raises(ValueError):
        C.random_split(df, "row_id", {"train": 0.9}, 1)


def test_keep_first_and_membership(spark):
    df = spark.createDataFrame([(3, "a"), (1, "a"), (2, None), (4, None)], "id long, k string")
    assert sorted(r.id for r in C.keep_first(df, ["k"], "id").collect()) == [1, 2]
    ref = spark.createDataFrame([("a",), (None,)], "k string")
    assert {r.id: r.is_member for r in C.member_flag(df, ref, "k").collect()} == {1: True, 3: True, 2: False, 4: False}


def test_weights_and_standardise(spark):
    df = spark.createDataFrame([(0.0,), (4.0,), (9.0,), (145.06,)], "std double")
    w = [r.weight for r in C.mean_one_weight(df, "std").collect()]
    assert abs(sum(w) / 4 - 1) < 1e-12 and w[0] == w[1] > w[2] > w[3]
    v = spark.createDataFrame([(1, [1.0, 5.0, float("nan")]), (2, [3.0, 5.0, 1.0])], "id long, x array<double>")
    fit = {r.dim: r for r in C.standardise_fit(v, "x").collect()}
    assert fit[0].mean == 2.0 and fit[0]["std"] == 1.0 and fit[0].keep and not fit[1].keep and not fit[2].keep
    z = {(r.id, r.dim): r.z for r in C.standardise_apply(v, "id", "x", C.standardise_fit(v, "x")).collect()}
    assert z == {(1, 0): -1.0, (2, 0): 1.0}


def test_group_advantage(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 5.0), (2, 5.0)], "g long, r double")
    got = [round(r.advantage, 6) for r in P.group_advantage(df, ["g"], "r").orderBy("g", "r").collect()]
    assert got == [-1.0, 1.0, 0.0, 0.0]


def test_sampling_masks(spark):
    import math

    df = spark.createDataFrame([(0, i, math.log(p)) for i, p in enumerate([0.5, 0.3, 0.15, 0.05])], "row long, token long, logit double")
    kept = lambda d: [r.token for r in d.where("kept").orderBy("token").collect()]
    assert kept(P.top_p_mask(df, ["row"], "token", "logit", 0.4)) == [0]
    assert kept(P.top_p_mask(df, ["row"], "token", "logit", 0.79)) == [0, 1]
    assert kept(P.top_p_mask(df, ["row"], "token", "logit", 0.0)) == [0]
    tied = spark.createDataFrame([(0, 0, 2.0), (0, 1, 1.0), (0, 2, 1.0), (0, 3, 0.0)], "row long, token long, logit double")
    assert kept(P.top_k_mask(tied, ["row"], "logit", 2)) == [0, 1, 2]


def test_span_corruption_round_trip(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    rows = [(i, [int(x) for x in rng.integers(5, 500, rng.integers(0, 120))] + [1]) for i in range(120)]
    df = spark.createDataFrame(rows, "row_id long, ids array<int>")
    df = T.hashed_spans(df, "row_id", "ids", 7)
    inputs, labels = T.corrupt(F.col("ids"), F.col("spans"), 1032)
    out = df.withColumn("inputs", inputs).withColumn("labels", labels)
    out = out.withColumn("back", T.reconstruct(F.col("inputs"), F.col("labels"), 1032, 1000)).collect()
    assert all(r.back == r.ids for r in out)
    for r in out:
        spans = [(s.start, s.len) for s in r.spans]
        assert len(spans) <= 8 and all(1 <= n <= 3 for _, n in spans) and sum(n for _, n in spans) <= int(0.15 * (len(r.ids) - 1) + 1e-9)
        assert all(a + n < b for (a, n), (b, _) in zip(spans, spans[1:])) and all(a + n <= len(r.ids) - 1 for a, n in spans)
        assert (r.labels == []) == (not spans)


def test_token_arrays(spark):
    df = spark.createDataFrame([([5, 6, 7],)], "ids array<int>")
    got = df.select(T.finish(F.col("ids"), 3).alias("cut"), T.pad(F.col("ids"), F.lit(5)).alias("pad"), T.pad(F.col("ids"), F.lit(2)).alias("short"), T.mask(F.lit(2), F.lit(4)).alias("mask")).first()
    assert got == ([5, 6, 1], [5, 6, 7, 0, 0], [5, 6], [1, 1, 0, 0])


def test_longest_match(spark):
    df = spark.createDataFrame([("[C][X]abx??b<e>",), ("",), (None,)], "s string")
    got = [r.x for r in df.select(T.longest_match(["a", "ab", "b", "["], ["[C]", "<e>"])("s").alias("x")).collect()]
    assert got == [["[C]", "[", "<unk>", "ab", "<unk>", "b", "<e>"], [], []]


def test_vocab(spark):
    df = spark.createDataFrame([(t,) for t in "b a b c a b".split()], "t string")
    assert [(r.t, r["count"], r["rank"]) for r in T.vocab_counts(df, "t", 2).orderBy("rank").collect()] == [("b", 3, 1), ("a", 2, 2)]
    assert [r.t for r in T.padded_vocab(T.vocab_counts(df, "t", 5), "t", 4).orderBy("rank").collect()] == ["b", "a", "c", "<unused_4>"]


def test_verdicts(spark):
    d = spark.createDataFrame([("a", 0.1, 0.02), ("b", 0.1, -0.01), ("c", None, 0.1), ("d", 0.001, 0.0001)], "arm string, delta double, low double")
    assert {r.arm: r.beats for r in K.success(d, 0.05).collect()} == {"a": True, "b": False, "c": None, "d": False}
    assert K.success(d, 0.05, F.lit(False)).where("beats IS NOT NULL").count() == 0
    s = spark.createDataFrame([("a", 0.1), ("a", 0.2), ("b", 0.2), ("b", None), ("c", 0.1), ("c", -0.05)], "arm string, d double")
    got = {r.arm: (r.mean_beats, r.unanimous, r.combined) for r in K.across_seeds(s, "arm", "d", 0.0).collect()}
    assert got == {"a": (True, True, True), "b": (True, None, None), "c": (True, False, False)}
    with pytest.raises(ValueError):
        K.ablation(d, "arm", "delta", 0.0, 0.0)


def test_bootstrap_is_deterministic_and_near(spark):
    df = spark.range(400).select(F.when(F.col("id") % 2 == 0, "a").otherwise("b").alias("arm"), F.col("id").alias("k"), (F.col("id") % 2 + (F.col("id") % 7) / 10).alias("v"))
    obs = df.groupBy("arm").agg(F.avg("v").alias("mean"))
    one, two = (K.bootstrap_delta(K.bootstrap_means(x, ["arm"], F.col("k"), F.col("v"), 50, "s"), obs, "arm", "a").first() for x in (df, df.repartition(5)))
    assert abs(one.low - two.low) < 1e-12 and one.low < one.delta < one.high and 0.8 < one.low and one.high < 1.2


def test_finite(spark):
    df = spark.createDataFrame([(1.0,), (None,), (float("nan"),), (float("inf"),), (-float("inf"),)], "x double")
    assert [r.x for r in df.where(is_finite(F.col("x"))).collect()] == [1.0]


def test_tanimoto_and_cosine(spark):
    df = spark.createDataFrame([([1, 2, 3], [2, 3, 4]), ([], []), (None, [1])], "a array<int>, b array<int>")
    assert [r.x for r in df.select(M.tanimoto("a", "b").alias("x")).collect()] == [0.5, 0.0, 0.0]
    assert [r.x for r in df.select(M.cosine("a", "b").alias("x")).collect()][1:] == [0.0, 0.0]


def test_asof_and_interval_joins(spark):
    from strandline.operators import joins as J

    left = spark.createDataFrame([("a", 5), ("a", 1), ("b", 9), ("a", 7)], "k string, t long")
    right = spark.createDataFrame([("a", 2, "x"), ("a", 5, "y"), ("a", 6, None), ("b", 10, "z")], "k string, t long, v string")
    assert {(r.k, r.t): r.got for r in J.asof_join(left, right, "k", "t", "v", "got").collect()} == {("a", 5): "y", ("a", 1): None, ("b", 9): None, ("a", 7): "y"}
    points = spark.range(-5, 40).withColumnRenamed("id", "p")
    spans = spark.createDataFrame([(0, 7), (5, 23), (-3, -1)], "a long, b long")
    got = sorted((r.p, r.a) for r in J.interval_join(points, spans, F.col("p"), F.col("a"), F.col("b"), 8).collect())
    assert got == sorted((p, a) for p in range(-5, 40) for a, b in ((0, 7), (5, 23), (-3, -1)) if a <= p < b)


def test_predictors(spark):
    from strandline.operators import predictors as P

    def load():
        def predict(texts):
            if "bad" in texts:
                raise ValueError
            return [len(t) for t in texts][: -1 if "short" in texts else None]

        return predict

    df = spark.createDataFrame([(1, "abc"), (2, "bad"), (3, "short"), (4, None)], "id long, s string")
    got = {r.id: r.x for r in df.select("id", P.predictor(load, batch=1)("s").alias("x")).collect()}
    assert got[1] == 3.0 and got[2] is None or got[2] != got[2] and got[4] == 0.0
    twice = df.unionByName(df)
    assert P.score_distinct(twice, "s", F.length, "n").count() == 8


def test_chemistry_is_refused_without_its_libraries():
    from strandline.functions import chemistry

    if not chemistry.available()["rdkit"]:
        with pytest.raises(chemistry.Unavailable):
            chemistry.canonical_psmiles()


def test_interleave(spark):
    from strandline.operators.loaders import interleave

    a, b = spark.createDataFrame([(1,), (2,), (3,), (4,), (5,)], "x long"), spark.createDataFrame([(10,), (20,)], "x long")
    assert [(r.loader, r.item) for r in interleave(a, b, "x").collect()] == [("a", 1), ("b", 10), ("a", 2), ("b", 20), ("a", 3), ("b", 10), ("a", 4), ("b", 20), ("a", 5), ("b", 10)]


def test_conformal_quantile_of_groups_by_ranges(spark):
    import random

    rng = random.Random(2)
    rows = [(g, round(rng.random(), 2)) for g, n in (("a", 400), ("b", 7), ("c", 60), (None, 5)) for _ in range(n)]
    got = {r.g: (r.n, r.quantile) for r in M.conformal_quantile(spark.createDataFrame(rows, "g string, r double"), "r", 0.2, ["g"]).collect() if r.g}
    for g in "abc":
        own = sorted(x for y, x in rows if y == g)
        k = -(-(len(own) + 1) * 8 // 10)
        assert got[g] == (len(own), own[k - 1])


def test_bootstrap_blocks_are_poisson_means(spark):
    import numpy as np

    values = np.random.default_rng(1).random(3000)
    df = spark.createDataFrame([("ab"[i % 2], i, float(v)) for i, v in enumerate(values)], "arm string, k long, v double")
    one, two = (sorted(map(tuple, K.bootstrap_blocks(x, "arm", F.col("k"), F.col("v"), 300).collect())) for x in (df, df.repartition(5)))
    assert len(one) == 600 and np.allclose([r[2] for r in one], [r[2] for r in two])
    for j, arm in enumerate("ab"):
        own, means = values[j::2], np.array([r[2] for r in one if r[0] == arm])
        assert abs(means.mean() - own.mean()) < 4 * own.std() / np.sqrt(len(own)) / np.sqrt(300)
        assert 0.8 < means.std() / (own.std() / np.sqrt(len(own))) < 1.2


def test_nearest_of_equals_all_pairs(spark):
    import numpy as np

    x = np.random.default_rng(3).normal(size=(40, 6))
    x[5] = 0
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    q, ref = (spark.createDataFrame(part, "i long, v array<float>") for part in (rows[:15], rows[15:]))
    unit = x.astype(np.float32).astype(float)
    want = {i: max(unit[i] @ unit[j] / np.linalg.norm(unit[i]) / np.linalg.norm(unit[j]) for j in range(15, 40)) for i in range(15) if i != 5}
    got = {r.i: r.nearest for r in M.nearest_of(q, ref, "i", "v").collect()}
    assert all(abs(got[i] - w) < 1e-9 for i, w in want.items()) and len(got) == 15
    assert [r.nearest for r in M.nearest_of(q, ref.where("false"), "i", "v").collect()] == [None] * 15
