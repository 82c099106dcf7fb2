import random

import numpy as np

from strandline.llm import toxicity as T


def corpus(n, seed):
    rng = random.Random(seed)
    plain = [f"{a}{b}{c}" for a in "blorn tavi mesk".split() for b in "aeiou" for c in "dra kel fin".split()]
    rows = []
    for i in range(n):
        kind = rng.random()
        words = [rng.choice(plain) for _ in range(rng.randint(20, 80))]
        toxic = kind < 0.2
        for _ in range(rng.randint(2, 4) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(["Idiot", "SCUM!"]) if kind < 0.1 else "grulvo" + rng.choice(["na", "ti", "mo"]))
        rows.append((i, " ".join(words), int(toxic)))
    return rows


def test_held_out_accuracy(spark):
    rows = corpus(1200, 1)
    df = spark.createDataFrame([(i, t, i) for i, t, _ in rows] + [(5000, None, 0), (5001, "", 0)], "doc_id long, text string, __score long")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 2] + [(None, 1), (3, None)], "doc_id long, toxic int")
    chain = T.train(df, labels)
    got = {r.doc_id: r for r in T.score(df, chain).collect()}
    held = [(got[i]["__toxic"], y, t) for i, t, y in rows if i % 2 == 0]
    assert sum(a == bool(y) for a, y, _ in held) / len(held) > 0.99
    by_family = {f: [got[i]["__p_overt"] > got[i]["__p_veiled"] for i, t, y in rows if y and any(w in t.lower() for w in f)] for f in (("idiot", "scum"), ("grulvo",))}
    assert all(sum(x) / len(x) > 0.9 or sum(x) / len(x) < 0.1 for x in by_family.values())
    assert not got[5000]["__toxic"] and not got[5001]["__toxic"] and got[5000]["__p_toxic"] == got[5001]["__p_toxic"]
    assert T.score(df, chain).columns == [*df.columns, "__p_overt", "__p_veiled", "__p_toxic", "__toxic"]


def test_later_models_use_out_of_fold_predictions():
    rng = np.random.default_rng(0)
    a = rng.random(400) < 0.3
    indices = [np.array([0] if x else [1]) for x in a]
    chain, held = T.fit_chain(indices, np.stack([a, a], 1), np.arange(400) % 4, {"f": 0, "g": 1})
    assert held.shape == (400, 2) and len(chain.models[1].weights) == 3 and len(chain.models[0].weights) == 2
    assert ((held[:, 1] > 0.5) == a).all() and 0.1 <= chain.threshold <= 0.9
    fold0 = T.fit_linear(T.Rows([indices[i] for i in range(400) if i % 4], np.zeros((300, 0))), a[np.arange(400) % 4 != 0].astype(float), 2)
    assert np.allclose(held[::4, 0], T.sigmoid(fold0.logit(T.Rows(indices[::4], np.zeros((100, 0))))))


def test_gradient_reaches_the_optimum():
    rows = T.Rows([np.array([0])] * 30 + [np.array([1])] * 70, np.zeros((100, 0)))
    y = np.array([1.0] * 20 + [0.0] * 10 + [1.0] * 7 + [0.0] * 63)
    p = T.sigmoid(T.fit_linear(rows, y, 2, penalty=1e-6, steps=3000).logit(rows))
    assert abs(p[0] - 2 / 3) < 1e-2 and abs(p[-1] - 0.1) < 1e-2


def test_without_labels_nothing_is_rejected(spark):
    df = spark.createDataFrame([(1, "idiot"), (2, "x")], "doc_id long, text string")
    for labels in ([], [(1, 1)], [(2, 0)]):
        chain = T.train(df, spark.createDataFrame(labels, "doc_id long, toxic int"))
        assert chain is None and [r["__toxic"] for r in T.score(df, chain).collect()] == [False, False]
    empty = df.where("false")
    assert T.score(empty, T.train(empty, spark.createDataFrame([(1, 1)], "doc_id long, toxic int"))).collect() == []


def test_few_labels_still_make_a_model(spark):
    rows = [(i, f"grulvo w{i} idiot" if i % 3 == 0 else f"w{i} plain words") for i in range(30)]
    chain = T.train(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(i, int(i % 3 == 0)) for i, _ in rows], "doc_id long, toxic int"))
    assert [chain.score(t)[-1] >= chain.threshold for _, t in rows] == [i % 3 == 0 for i, _ in rows]


def test_chain_equals_brute_force():
    """Scores by dense arithmetic over the chain's own weights; models by fitting each link alone."""
    rng = np.random.default_rng(3)
    words = ["ab", "cd", "ef", "gh"]
    texts = [" ".join(w for w in words if rng.random() < 0.5) for _ in range(120)]
    vocabulary = {w: k for k, w in enumerate(words)}
    indices = [np.array(sorted(vocabulary[w] for w in t.split()), np.int64) for t in texts]
    y = np.array(["ab" in t.split() for t in texts])
    targets, fold = np.stack([y & np.array(["cd" in t for t in texts]), y & np.array(["cd" not in t for t in texts]), y], 1), np.arange(120) % 3
    chain, _ = T.fit_chain(indices, targets, fold, vocabulary)
    dense = np.array([[w in t.split() for w in words] for t in texts], float)
    held = np.zeros((120, 0))
    for c, model in enumerate(chain.models):
        alone = T.fit_linear(T.Rows(indices, held), targets[:, c].astype(float), 4)
        assert np.allclose(model.weights, alone.weights) and np.isclose(model.bias, alone.bias)
        next_ = np.zeros(120)
        for f in range(3):
            part = T.fit_linear(T.Rows([indices[i] for i in np.flatnonzero(fold != f)], held[fold != f]), targets[fold != f, c].astype(float), 4)
            next_[fold == f] = 1 / (1 + np.exp(-(np.hstack([dense, held])[fold == f] @ part.weights + part.bias)))
        held = np.column_stack([held, next_])
    for t, x in zip(texts, dense):
        said = []
        for model in chain.models:
            said.append(1 / (1 + np.exp(-(np.array([*x, *said]) @ model.weights + model.bias))))
        assert np.allclose(chain.score(t), said)


def test_overt_takes_the_fewest_signs():
    indices = [np.array([0]), np.array([0, 1]), np.array([1]), np.array([2]), np.array([0])]
    y = np.array([True, True, True, True, False])
    assert T.overt(indices, y, np.array([0, 1, 2])).tolist() == [True, True, False, False, False]
