import hashlib
import math
import os
import random
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("corpus_pipeline")
P = pytest.importorskip("public_tokenizers")
spm = pytest.importorskip("sentencepiece")

from strandline.llm import pipeline, toxicity  # noqa: E402


def documents(seed=0):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 7))) for _ in range(3000)]
    rows = []
    for i in range(300):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(60, 200))]
        if i % 6 == 0:
            words[3:3] = ["idiot", "scum"]
        rows.append(" ".join(words))
    rows += [rows[1]] * 40 + [rows[7]] * 3 + [rows[13].replace(" ", "  ", 1), rows[19] + " tail", rows[0] + " again"]
    return [(k, t, "en", "hot" if k % 3 else f"s{k % 5}", len(t)) for k, t in enumerate(rows)]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("sf"))
    rows = documents()
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    labels = [(i, 1, int("idiot" in t)) for i, t, *_ in rows if i < 300 and i % 2 == 0 or i < 100]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    return d


def test_run_equals_brute_force(spark, folder):
    rows = documents()
    clean = [r for r in rows if "idiot" not in r[1]]
    first = {}
    for r in clean:
        first.setdefault(r[1], r)
    distinct = list(first.values())

    def shingles(t):
        w = t.split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    kept, sets = [], []
    for r in distinct:
        s = shingles(r[1])
        if not any(len(s & x) / len(s | x) >= 0.8 for x in sets):
            kept.append(r)
        sets.append(s)
    n = Counter(r[3] for r in kept)
    z = math.fsum(math.sqrt(x) for x in n.values())
    lib = spm.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    want = Counter()
    for i, t, _, s, _ in kept:
        mean, u = math.sqrt(n[s]) / z * len(kept) / n[s], int(hashlib.md5(f"{pipeline.MIX_SEED}:{i}".encode()).hexdigest()[:13], 16) / 16**13
        k, p = 0, math.exp(-mean)
        total = p
        while u >= total:
            k += 1
            p *= mean / k
            total += p
        ids = lib.encode(t, add_bos=True, add_eos=True)
        want[(i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(lib.decode(ids).encode()).hexdigest())] += k
    got = Counter(tuple(r[:4]) for r in pipeline.run(spark, folder).collect())
    assert got == +want


def test_stages_return_columns_of_documents(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name


def test_stages_take_empty_tables_nulls_and_odd_columns(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    odd = spark.createDataFrame([(1, None, None, None, None, "x"), (None, "", "en", "s", 0, "y"), (1, None, None, None, None, "x")], "doc_id long, text string, lang string, source string, n_chars long, keep_id string")
    for df in (docs.where("false"), odd):
        for name, stage in pipeline.STAGES:
            stage(spark, df, folder).collect()


def test_stages_of_the_testdata_keep_clean_documents(spark):
    sf = "/root/testdata/sf0.01"
    if not os.path.exists(sf):
        pytest.skip("no testdata")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    kept = {r.doc_id for r in pipeline.reject_toxic(spark, docs, sf).select("doc_id").collect()}
    clean = {r.doc_id for r in labels.where("toxic = 0").collect()}
    assert len(clean - kept) <= 0.01 * len(clean)
    assert toxicity.CATEGORIES[-1] == "toxic"
