import hashlib
import math
from collections import Counter

import pytest

from strandline.llm import mixing as M


def unit(seed, i):
    return int(hashlib.md5(f"{seed}:{'text:' + hashlib.md5(b'').hexdigest() if i is None else i}".encode()).hexdigest()[:13], 16) / 16**13


def poisson_draw(mean, u):
    k, p = 0, math.exp(-mean)
    total = p
    while u >= total and p > 0:
        k += 1
        p *= mean / k
        total += p
    return k


def test_draws_equal_the_inversion(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 4}", f"t{i}") for i in range(600)] + [(None, None, None), (600, None, "x"), (0, "hot", "t0")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, source string, text string, copies int")
    out = M.mix_sources(df, seed=3, size=900)
    got = Counter((r.doc_id, r.source, r.text) for r in out.collect())
    n = Counter(s or "" for _, s, _ in rows)
    z = math.fsum(math.sqrt(x) for x in n.values())
    want = Counter()
    for i, s, t in rows:
        mean = math.sqrt(n[s or ""]) / z * 900 / n[s or ""]
        want[(i, s, t)] += poisson_draw(mean, unit(3, i))
    assert got == +want
    assert out.columns == [*df.columns, "__copy", "__copies", "__order"]
    order = [r["__order"] for r in out.collect()]
    assert order == sorted(order)


def test_given_weights_and_limits(spark):
    df = spark.createDataFrame([(i, "a" if i < 1000 else "b", "t") for i in range(2000)], "doc_id long, source string, text string")
    got = Counter(r.source for r in M.mix_sources(df, weights={"a": 3.0}, size=4000, seed=1).collect())
    assert set(got) == {"a"} and abs(got["a"] - 4000) < 4 * math.sqrt(4000)
    with pytest.raises(ValueError, match="sources"):
        M.mix_sources(df, max_sources=1)
    assert M.mix_sources(df.where("false")).collect() == []


@pytest.mark.parametrize("mean", [0.1, 1.0, 7.5, 120.0])
def test_thresholds_are_the_distribution(mean):
    t = M.poisson_thresholds(mean)
    assert all(a <= b for a, b in zip(t, t[1:])) and abs(t[-1] - 1) < 1e-12
    p = [t[0]] + [b - a for a, b in zip(t, t[1:])]
    assert abs(math.fsum(k * x for k, x in enumerate(p)) - mean) < 1e-9 * max(1, mean)


def test_no_rate_no_copies():
    assert M.poisson_thresholds(0.0) == [2.0]
    with pytest.raises(ValueError):
        M.poisson_thresholds(501)


@pytest.mark.parametrize("mean", [501.0, 835.0, 250_000.0])
def test_windows_are_the_distribution(mean):
    k, t = M.poisson_window(mean)
    p = [t[0]] + [b - a for a, b in zip(t, t[1:])]
    m = math.fsum((k + i) * x for i, x in enumerate(p))
    assert t[-1] == 1 and abs(m - mean) < 1e-6 * mean and abs(math.fsum((k + i - m) ** 2 * x for i, x in enumerate(p)) - mean) < 1e-3 * mean


def test_large_means_and_many_sources_end_with_a_result(spark):
    df = spark.createDataFrame([(i, f"s{i}" if i < 12_000 else "hot") for i in range(14_000)], "doc_id long, source string")
    assert M.mix_sources(df, weights={"hot": 1.0}, size=3000).where("source <> 'hot'").count() == 0
    got = Counter(r.source for r in M.mix_sources(df, weights={"s1": 2.0, "s2": 1.0}, size=6000).collect())
    assert set(got) == {"s1", "s2"} and abs(got["s1"] - 4000) < 6 * math.sqrt(4000) and abs(got["s2"] - 2000) < 6 * math.sqrt(2000)


def test_rows_without_identifier_draw_apart_and_no_weight_leaves_nothing(spark):
    df = spark.createDataFrame([(None, "s", f"t{i}") for i in range(1000)], "doc_id long, source string, text string")
    got = M.mix_sources(df, size=1500).count()
    assert abs(got - 1500) < 5 * math.sqrt(1500)
    assert M.mix_sources(df, weights={}).collect() == []
    with pytest.raises(ValueError, match="negative"):
        M.mix_sources(df, weights={"s": -1.0})


def test_a_small_source_may_be_repeated_thousands_of_times(spark):
    df = spark.createDataFrame([(i, "b" if i else "a", "t") for i in range(2000)], "doc_id long, source string, text string")
    got = Counter(r.source for r in M.mix_sources(df, exponent=0.0).collect())
    assert abs(got["a"] - 1000) < 5 * math.sqrt(1000) and abs(got["b"] - 1000) < 5 * math.sqrt(1000)


def test_the_join_without_a_broadcast_draws_alike(spark, monkeypatch):
    df = spark.createDataFrame([(i, "hot" if i % 3 else None, f"t{i}") for i in range(300)], "doc_id long, source string, text string")
    want = sorted((r.doc_id, r["__copy"]) for r in M.mix_sources(df, seed=2).collect())
    monkeypatch.setattr(M, "BROADCAST_THRESHOLDS", 0)
    assert sorted((r.doc_id, r["__copy"]) for r in M.mix_sources(df, seed=2).collect()) == want
