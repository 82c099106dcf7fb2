import hashlib

import pytest

from strandline.llm.exact_dedup import exact_distinct, exact_groups

ROWS = [(5, "a"), (1, "a"), (9, "a"), (9, "a"), (2, None), (3, ""), (None, "a"), (None, "only null"), (7, "A"), (8, "x" * 100_000), (4, "x" * 100_000), (6, "x" * 99_999)]


def brute(rows, keep):
    groups = {}
    for i, t in rows:
        groups.setdefault(t or "", []).append(i)
    out = []
    seen = set()
    for i, t in rows:
        ids = groups[t or ""]
        known = [x for x in ids if x is not None]
        best = (max if keep == "largest" else min)(known) if known else None
        kept = i == best and (t or "") not in seen
        if kept:
            seen.add(t or "")
        out.append((i, best, len(ids), kept, hashlib.sha256((t or "").encode()).hexdigest()))
    return sorted(map(repr, out))


@pytest.mark.parametrize("keep", ["largest", "smallest"])
@pytest.mark.parametrize("rows_a_slice", [None, 1, 2])
def test_groups_equal_brute_force(spark, keep, rows_a_slice):
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    got = exact_groups(df, keep=keep, rows_a_slice=rows_a_slice).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(ROWS, keep)


def test_crowded_text_is_dealt_over_slices(spark):
    rows = [(i, "hot" if i % 3 else f"cold {i % 50}") for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = exact_groups(df, keep="largest", rows_a_slice=40).collect()
    assert sorted(repr(tuple(r)) for r in got) == brute(rows, "largest")


def test_distinct_keeps_columns_and_clashing_names(spark):
    df = spark.createDataFrame([(1, "a", "k", 3), (2, "a", None, 4), (3, "b", "k", 5)], "doc_id long, text string, keep_id string, group_size int")
    out = exact_distinct(df, rows_a_slice=1)
    assert out.columns == df.columns
    assert sorted(out.collect()) == [(1, "a", "k", 3), (3, "b", "k", 5)]
    assert exact_groups(df).columns == ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


def test_empty_and_normalised(spark):
    import pyspark.sql.functions as F

    empty = spark.createDataFrame([], "doc_id long, text string")
    assert exact_groups(empty).collect() == []
    assert exact_distinct(empty).collect() == []
    df = spark.createDataFrame([(1, "Ab "), (2, "ab")], "doc_id long, text string")
    assert [r.doc_id for r in exact_distinct(df, normalise=lambda c: F.lower(F.trim(c))).collect()] == [1]


def test_plan_has_no_python_and_one_exchange_of_texts(spark):
    df = spark.createDataFrame([(i, f"t{i}") for i in range(50)], "doc_id long, text string").repartition(2)
    plan = exact_groups(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "hashpartitioning(__" not in plan
