import random

import numpy as np
import pytest
import xxhash

from strandline.llm import simhash as S


def brute_print(text, k):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(values, near):
    parent = {v: v for v in values}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    vs = list(values)
    for i, a in enumerate(vs):
        for b in vs[i + 1 :]:
            if near(a, b):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
    return {v: find(v) for v in vs}


def words(rng, n):
    return " ".join(rng.choice("alpha beta gamma delta eps zeta eta theta".split()) for _ in range(n))


def test_fingerprint_equals_brute_force():
    rng = random.Random(0)
    for k in (1, 3, 5):
        for text in ["", " \t\n", "One", "a b", "A B C", "é É x\x0by", "x\x00 y z w"] + [words(rng, rng.randint(0, 60)) for _ in range(40)]:
            assert S.simhash(text, k) == brute_print(text, k)


def test_bk_tree_finds_what_a_scan_finds():
    rng = random.Random(1)
    values = list({rng.getrandbits(10) for _ in range(300)})
    tree = S.BKTree(values[0])
    for v in values[1:]:
        tree.add(v)
    for q in range(0, 1024, 37):
        for r in (0, 1, 2, 3):
            assert sorted(tree.within(q, r)) == sorted(v for v in values if (v ^ q).bit_count() <= r)


@pytest.mark.parametrize("shard_rows", [1000, 20, 3])
def test_links_have_the_components_of_all_pairs(spark, shard_rows):
    rng = random.Random(shard_rows)
    values = [0, (1 << 64) - 1]
    for _ in range(250):  # chains of near fingerprints, many of which share bands
        values.append(rng.choice(values) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(20)) ^ (1 << rng.randrange(20)))
    values = list(dict.fromkeys(values))
    df = spark.createDataFrame([(S._signed(v),) for v in values], "fp long")
    got = {v: v for v in values}
    pairs = [(r.a & (1 << 64) - 1, r.b & (1 << 64) - 1) for r in S.links(df, 2, shard_rows).collect()]
    assert all((a ^ b).bit_count() > 0 for a, b in pairs)
    linked = set(pairs) | {(b, a) for a, b in pairs}
    got = components(values, lambda a, b: (a, b) in linked)
    want = components(values, lambda a, b: (a ^ b).bit_count() <= 2)
    assert got == want


def test_near_groups_equal_brute_force(spark):
    rng = random.Random(3)
    texts = [None, "", "  ", "one", "ONE", "one two"]
    for _ in range(40):
        base = words(rng, rng.randint(3, 90)).split()
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            copy[rng.randrange(len(copy))] = "changed"
            texts.append(" ".join(copy))
    texts += ["copy of many"] * 60
    rows = [(100 + i, t, i) for i, t in enumerate(texts)] + [(None, "one", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp int")
    got = {(r.doc_id, r.fp & (1 << 64) - 1): r.component_id for r in S.near_groups(df, shard_rows=10).collect()}
    prints = {i: brute_print(t, 3) for i, t, _ in rows if i is not None}
    near = components(prints, lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 2)
    assert {i: got[(i, prints[i])] for i in prints} == near
    assert got[(None, brute_print("one", 3))] == near[103]
    empty = df.where("false")
    assert S.near_groups(empty).collect() == []


@pytest.mark.parametrize("one_task", [0, 10_000])
def test_stars_of_a_long_path(spark, one_task):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(500, 501), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in S.stars(edges, one_task=one_task).collect()}
    assert got == {i: 0 for i in range(1, 201)} | {501: 500}


@pytest.mark.parametrize("shard_rows", [1000, 5])
def test_similar_groups_against_jaccard(spark, shard_rows):
    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(5000)]
    docs, group = [], []
    for g in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(150, 400))]
        for _ in range(rng.choice([1, 1, 2, 12])):
            copy = list(base)
            copy[rng.randrange(len(copy))] = "changed"
            docs.append(" ".join(copy))
            group.append(g)
    rows = [(i, t) for i, t in enumerate(docs)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in S.similar_groups(df, shard_rows=shard_rows).collect()}
    assert [got[i] for i in range(len(docs))] == [group.index(g) for g in group]
    assert got[900] == got[901] == 900
    kept = S.near_distinct(df, shard_rows=shard_rows)
    assert sorted(r.doc_id for r in kept.collect()) == sorted({group.index(g) for g in group} | {900})
    assert kept.columns == df.columns


def test_unlike_texts_are_not_linked(spark):
    rng = random.Random(5)
    shared = [f"s{i}" for i in range(40)]  # a passage that all texts share
    rows = [(i, " ".join([f"u{i}x{k}" for k in range(rng.randint(100, 200))] + shared)) for i in range(60)]
    got = S.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), shard_rows=5).collect()
    assert all(r.doc_id == r.component_id for r in got)


def test_a_hub_with_more_copies_than_a_shard_keeps_all_of_them(spark):
    rng = random.Random(6)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for c in range(800):  # at most 30 of 296 shingles change: 0.816 to the original, about 0.67 among copies
        copy = list(base)
        for k in rng.sample(range(300), 6):
            copy[k] = f"c{c}x{k}"
        texts.append(" ".join(copy))
    rows = list(enumerate([*texts, " ".join(base)]))
    got = S.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), shard_rows=200).collect()
    assert {r.component_id for r in got} == {0}


def test_merged_equals_all_pairs():
    rng = random.Random(7)
    for _ in range(30):
        n = rng.randint(2, 60)
        values = [rng.getrandbits(12) for _ in range(n)]
        labels = [rng.choice([i, i, i, i % 7]) for i in range(n)]
        got = S.merged(labels, lambda i, others: [(values[i] ^ values[j]).bit_count() <= 2 for j in others])  # noqa: B023
        linked = {(a, b) for a, b in got} | {(b, a) for a, b in got}
        rows = {x: [v for v, y in zip(values, labels) if x == y] for x in labels}
        want = components(rows, lambda a, b: any((x ^ y).bit_count() <= 2 for x in rows[a] for y in rows[b]))  # noqa: B023
        want = {x: min(y for y in want if want[y] == want[x]) for x in want}
        assert {x: min([b for a, b in got if a == x], default=x) for x in rows} == want and len(linked) == 2 * len(got)


def test_groups_are_those_of_exact_jaccard_at_the_limit_and_for_short_texts(spark):
    rng = random.Random(8)
    texts = []
    for n in [5, 6, 7, 8, 9, 10, 11, 15, 24, 64, 90, 150, 300]:
        for c in range(6):
            base = [f"n{n}c{c}w{i}" for i in range(n)]
            texts.append(" ".join(base))
            for extra in {1, 2, n // 5, (n - 4) // 4, (n - 4) // 4 + 1}:  # (n - 4) // 4 words more: 0.8, if it divides
                texts.append(" ".join([*base, *[f"t{rng.random()}" for _ in range(extra)]]))
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))})
    want = components(range(len(texts)), lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= 0.8)
    got = {r.doc_id: r.component_id for r in S.similar_groups(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), shard_rows=50).collect()}
    assert got == want


def jaccard(a, b, k=5):
    def sets(t):
        w = t.split()
        return {tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))}

    x, y = sets(a), sets(b)
    return len(x & y) / len(x | y)


@pytest.mark.parametrize("shard_rows", [1000, 12])
def test_recall_against_all_pairs(spark, shard_rows):
    """Identifiers divisible by 100 against all rows: near copies of many strengths, crowded bands."""
    rng = random.Random(9)
    passage = [f"p{i}" for i in range(120)]
    texts = []
    for family in range(24):
        base = [f"f{family}w{i}" for i in range(rng.randint(60, 260))]
        if family % 3 == 0:
            base += passage
        for _ in range(50):
            copy = list(base)
            for k in rng.sample(range(len(copy)), rng.randint(0, max(1, len(copy) // 28))):
                copy[k] = f"x{rng.random()}"
            texts.append(" ".join(copy))
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in S.similar_groups(df, shard_rows=shard_rows).collect()}
    pairs = [(q, d) for q in range(0, len(texts), 100) for d in range(len(texts)) if q != d and jaccard(texts[q], texts[d]) >= 0.8]
    assert len(pairs) > 30
    assert sum(got[q] == got[d] for q, d in pairs) / len(pairs) >= 0.99
    of_families = {}
    for i, t in enumerate(texts):
        of_families.setdefault(got[i], set()).add(t.split()[40][:2] if t.split()[40].startswith("f") else None)
    assert all(len(x - {None}) <= 24 for x in of_families.values())


def test_texts_that_share_a_passage_hardly_meet(spark):
    """2,000 texts, 300 words in common and 74 of their own (similarity 0.66): the shards of rare shingles
    hold next to none of them, so there is next to nothing to compare."""
    rng = random.Random(10)
    passage = " ".join(f"p{i}" for i in range(300))
    rows = [(i, b"", [0], " ".join(f"u{i}x{rng.random()}" for _ in range(80)) + " " + passage) for i in range(2000)]
    sketch = S.with_shingles(spark.createDataFrame(rows, "id long, fp binary, keys array<long>, t string"), 5).cache()
    from pyspark.sql import functions as F

    rare = S._rare_shingles(sketch.select("id", "shingles").withColumn("label", F.col("id")), S._bucket_counts(sketch), 0.8)
    mixed = S._mixed(rare)
    met = mixed.groupBy("shard").count().selectExpr("coalesce(sum(count * (count - 1) / 2), 0)").first()[0]
    assert met <= 2000


def test_rarest_shingles_of_similar_sets_meet():
    rng = np.random.default_rng(4)
    counts = rng.integers(0, 50, S.BUCKETS)
    for n in (1, 2, 4, 5, 9, 10, 40, 333):
        for _ in range(20):
            x = np.unique(rng.integers(0, 1 << 62, n, np.uint64))
            for drop in range(n + 1):  # subsets of the similarity or more
                y = np.sort(rng.permutation(x)[: n - drop])
                if len(y) and len(y) / len(x) >= 0.8:
                    assert set(S.rarest(x, counts, 0.8)) & set(S.rarest(y, counts, 0.8))


def test_units_hold_every_pair_of_labels_once_blocks_are_small(spark):
    rng = random.Random(11)
    rows = [(1, i, 7 if i < 60 else rng.randint(100, 130), 8) for i in range(100)] + [(2, 200 + i, i, 8) for i in range(5)] + [(3, 300 + i, i % 2, S.BLOCK_BYTES) for i in range(4)]
    mixed = spark.createDataFrame(rows, "shard long, id long, label long, size long")
    units = {}
    for r in S._units(mixed, 10).collect():
        units.setdefault(r.unit, []).append((r.id, r.label))
    assert all(len(x) <= 40 for x in units.values())
    together = {(a[0], b[0]) for x in units.values() for a in x for b in x if a[1] != b[1]}
    for shard in (1, 2, 3):
        own = [(i, label) for s, i, label, _ in rows if s == shard]
        assert all((a, b) in together for a, la in own for b, lb in own if la != lb)
    top = sum(1 for x in units.values() if any(label == 7 for _, label in x) for _ in x)
    assert top <= 6 * 4 * 40  # the largest label's rows are dealt to the others' blocks, not to each other's


def test_rows_that_share_an_identifier_are_kept_apart(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(3, base), (5, base + " tail"), (5, "a wholly different text of its own"), (5, "a wholly different text of its own"), (None, base)]
    got = S.near_distinct(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.text) for r in got) == [(3, base), (5, "a wholly different text of its own")]


def test_copies_make_fewer_links_than_rows(spark):
    rng = random.Random(12)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(400):
        copy = list(base)
        for k in rng.sample(range(300), 3):
            copy[k] = f"c{i}x{k}"
        rows.append((i, copy))
    df = spark.createDataFrame([(i, " ".join(c)) for i, c in rows], "i long, t string").selectExpr("i", "t", "0L t0", "i t1")
    prints = S.sketches(df).selectExpr("i id", "fp", "keys").cache()
    nodes, found = S.similar_links(prints, lambda some: S.with_shingles(some.join(df, some.id == df.i), 5), shard_rows=50)
    labels = {r.label for r in nodes.collect()}
    assert found.distinct().count() <= len(labels) <= len(rows)


def test_similar_links_start_from_trees(spark):
    """Texts near by SimHash are linked although they share no band, far ones and dissimilar ones are not."""
    rng = random.Random(11)
    words = [rng.choice(["%03d" % k for k in range(900)]) for _ in range(400)]
    texts = [" ".join(words), " ".join(words[:-2] + ["end"] * 2), " ".join(rng.sample(words, 400)), " ".join(rng.sample(words, 400))]
    prints = [int.from_bytes(S.majority(S.mixed(S.shingle_set(t, 5), 0)), "big") for t in texts]
    assert 0 < (prints[0] ^ prints[1]).bit_count() <= S.RADIUS < (prints[0] ^ prints[2]).bit_count()
    df = spark.createDataFrame([(k, t, 0, 0) for k, t in enumerate(texts)], "i long, t string, t0 long, t1 long")
    apart = S.sketches(df).selectExpr("i id", "CASE WHEN i = 3 THEN X'" + "00" * 128 + "' ELSE fp END AS fp", "transform(keys, x -> i) AS keys")
    tree = {(r.shard, r.id) for r in S._tree_groups(apart, S.RADIUS, 1000).collect()}
    assert {i for _, i in tree} == {0, 1} and len({s for s, _ in tree}) == 1
    nodes, found = S.similar_links(apart, lambda some: S.with_shingles(some.join(df, some.id == df.i), 5))
    labels = {r.id: r.label for r in nodes.collect()}
    assert labels == {0: 0, 1: 0} and found.isEmpty()
