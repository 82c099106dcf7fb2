"""Hand-computed cases of the column expressions."""

import math

import pytest
from pyspark.sql import functions as F

from strandline.functions import chat as H
from strandline.functions import numbers as N
from strandline.functions import text as X


def one(spark, c, **values):
    row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
    return row.select(c.alias("x")).first().x


def test_format_property_rounds_the_binary_value(spark):
    df = spark.createDataFrame([(0.25,), (0.35,), (2.25,), (1.05,), (None,)], "v double")
    assert [r.x for r in df.select(X.format_property("v").alias("x")).collect()] == ["0.2", "0.3", "2.2", "1.1" if f"{1.05:.1f}" == "1.1" else "1.0", None]


@pytest.mark.parametrize("said,strict,loose", [("1.5", 1.5, 1.5), (" 2 ", 2.0, 2.0), ("nan", None, None), ("inf", None, None), ("1d", None, None), ("1_000", None, 1000.0), ("1__0", None, None), (".5", 0.5, 0.5), ("5.", 5.0, 5.0), ("1e400", None, None), ("", None, None), ("soluble", None, None)])
def test_numbers_in_text(spark, said, strict, loose):
    assert one(spark, X.parse_strict(F.col("s")), s=said) == strict
    assert one(spark, X.parse_permissive(F.col("s")), s=said) == loose


@pytest.mark.parametrize("s,want", [("[*]CC[*]", "[At]CC[At]"), ("*CC*", "[At]CC[At]"), ("[1*]C[*:2]", "[At]C[At]"), ("", "")])
def test_star_to_at(spark, s, want):
    assert one(spark, X.star_to_at(F.col("s")), s=s) == want


def test_token_grammar(spark):
    assert one(spark, X.split_tokens(F.col("s")), s="x[A]y[][B") == ["[A]", "[]"]
    assert one(spark, X.count_tokens(F.col("s")), s="[A][][B]") == 2
    assert one(spark, X.is_pure_run(F.col("s")), s=" [A][B] ") and not one(spark, X.is_pure_run(F.col("s")), s="[A]x")
    assert one(spark, X.is_balanced_run(F.col("s")), s="[][A]") and not one(spark, X.is_pure_run_of_two(F.col("s")), s="[A]")


def test_three_valued_and(spark):
    df = spark.createDataFrame([(None, False), (True, None), (True, True), (True, False)], "a boolean, b boolean")
    assert [r.x for r in df.select(N.all_measured(F.col("a"), F.col("b")).alias("x")).collect()] == [None, None, True, False]


def test_guards(spark):
    assert one(spark, N.safe_ratio(F.lit(3), F.lit(0))) == 0.0
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert df.agg(N.pearson(F.col("x"), F.col("y")).alias("r")).first().r is None
    assert df.agg(N.slope(F.col("y"), F.col("x"))[0].alias("r")).first().r is None
    with pytest.raises(ValueError):
        N.learning_rate("nope", F.lit(1), 10, 1)


def test_pearson_takes_rows_with_both_sides(spark):
    df = spark.createDataFrame([(1.0, None), (None, 9.0), (2.0, 3.0), (4.0, 5.0), (5.0, 4.0)], "x double, y double")
    assert math.isclose(df.agg(N.pearson(F.col("x"), F.col("y")).alias("r")).first().r, 0.6546536707079772)
    assert df.where("x IS NULL OR y IS NULL OR x = 2").agg(N.pearson(F.col("x"), F.col("y")).alias("r")).first().r is None


def test_target_reward(spark):
    r = N.target_reward(F.lit(450.0), F.lit(0.0), F.lit(500.0), F.lit(1), 5)
    got = spark.range(1).select(*[c.alias(k) for k, c in r.items()]).first()
    assert got.closeness == 0.5 and math.isclose(got.confidence, 0.2 / (1 + 45.2 / 20)) and not got.gated and got.reason is None
    none = N.target_reward(F.lit(450.0), F.lit(0.0), F.lit(500.0), F.lit(0), 5)
    assert spark.range(1).select(none["value"].alias("v"), none["reason"].alias("r")).first() == (0.0, "no_contributing_members")
    bad = N.target_reward(F.lit(float("nan")), F.lit(0.0), F.lit(500.0), F.lit(2), 5)
    assert spark.range(1).select(bad["gated"].alias("g"), bad["reason"].alias("r")).first() == (True, "non_finite")


@pytest.mark.parametrize(
    "message,name,confidence,target",
    [
        ("generate 20 polymers with Tg near 450 K", "generate", 0.95, 450.0), ("predict Tg for [*]CCO[*]", "predict", 0.95, None), ("use temperature 0.9 and top_p 0.95", "params", 0.9, None),
        ("Help!", "help", 1.0, None), ("So, what are you?", "help", 1.0, None), ("Show me the commands", "help", 1.0, None), ("hello", "unknown", 0.0, None), (None, "unknown", 0.0, None), ("around 100 celsius", "generate", 0.7, 373.15), ("glass transition temperature of 500", "generate", 0.7, 500.0),
    ],
)
def test_chat_router(spark, message, name, confidence, target):
    df = spark.createDataFrame([(message,)], "m string")
    r = H.route(df, "m").first()
    assert (r["name"], r["confidence"], r["target"]) == (name, confidence, target)


def test_chat_knobs_are_not_read_twice(spark):
    r = H.route(spark.createDataFrame([("glass transition temperature of 500, n = 3, top_k 40, seed 7",)], "m string"), "m").first()
    assert (r["target"], r["count"], r["temperature"], r["top_k"], r["seed"]) == (500.0, 3, None, 40, 7)


def test_times(spark):
    assert one(spark, X.eta(F.lit(3661.0))) == "01:01:01" and one(spark, X.eta(F.lit(-1.0))) == "--:--:--"
    assert one(spark, X.eta(F.lit(1e6))) == "277:46:40"
    assert one(spark, X.bytes_text(F.lit(8140000000))) == "8.14 GB"


def test_blake64_is_the_standard_digest(spark):
    """BLAKE2b of eight bytes; the first is that of the empty string."""
    from strandline.functions.text import blake64

    got = [r.h for r in spark.createDataFrame([("",), ("abc",), (None,)], "s string").select(blake64("s").alias("h")).collect()]
    assert got[0] == got[2] == int.from_bytes(bytes.fromhex("e4a6a0577479b2b4"), "big", signed=True) and got[1] != got[0]
