"""Toxicity by a classifier chain of linear models.

Categories are predicted one after another; each later logistic model sees, besides the words, the
probabilities of the categories before it. In training those probabilities are out-of-fold
predictions, so a later model learns from the errors an earlier one makes on texts it has not seen;
for scoring every model is fitted again on the whole sample.

Training uses a sample of labelled rows, bounded by ``max_positive`` and ``max_negative`` and chosen by
a hash of the identifier. Word and word-beginning features are counted by Spark; those whose
association with the label passes a chi-square test are kept, ``max_features`` at most. Scoring reads
every whole text row by row in Arrow batches, without a shuffle; what the tasks get is the model.

The labels know one class, toxic, so the chain's categories are made of it: ``overt`` (toxic, with one
of the strongest signs of the class: the fewest features, by association, that half of the toxic sample
has), ``veiled`` (toxic, with none of them) and last ``toxic`` itself, whose probability decides. The
last link so predicts what the first two have in common; labels of more classes would give it more to do.

Defined results: null text counts as empty; a text without known words gets the base rate; without
labelled rows of both classes nothing is rejected (all probabilities 0); repeated labels of a document
count as their maximum; of documents that share a labelled identifier the smallest text is the sample's;
labels that are null are left out; texts are read whole, however long; repeated rows repeat their
results; empty tables give empty results; other columns are carried along, and a column whose name is
taken already gets underscores after it.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import arrow_map, filled, free_names, materialise, strings

WORDS = re.compile(r"[^\W\d_]+")
BEGINNINGS = (4, 5, 6)
CATEGORIES = ("overt", "veiled", "toxic")
#: Association (chi-square) that a feature needs in any sample, and its share of the sample's size.
LEAST_CHI2, LEAST_PHI2 = 8.0, 0.0034
#: So many features are used where none has the association.
WEAK_FEATURES = 20


def word_features(text: str) -> set[str]:
    """Words of the lower-cased text, and their beginnings (marked by a trailing hyphen)."""
    words = set(WORDS.findall(text.lower()))
    return words | {w[:n] + "-" for w in words for n in BEGINNINGS if len(w) > n}


@dataclass
class Linear:
    weights: np.ndarray
    bias: float

    def logit(self, rows: Rows) -> np.ndarray:
        return rows.dot(self.weights) + self.bias


class Rows:
    """Sparse binary rows (feature indices) and dense columns (earlier categories' probabilities)."""

    def __init__(self, indices: list[np.ndarray], dense: np.ndarray):
        self.lengths = np.array([len(x) for x in indices], np.int64)
        self.flat = np.concatenate([*indices, np.zeros(0, np.int64)]).astype(np.int64)
        self.row = np.repeat(np.arange(len(indices)), self.lengths)
        self.indices, self.dense = indices, dense

    def dot(self, w: np.ndarray) -> np.ndarray:
        k = len(w) - self.dense.shape[1]
        return np.bincount(self.row, w[:k][self.flat], len(self.lengths)) + self.dense @ w[k:]

    def back(self, r: np.ndarray, k: int) -> np.ndarray:
        return np.concatenate([np.bincount(self.flat, r[self.row], k), self.dense.T @ r])

    def take(self, keep: np.ndarray) -> Rows:
        return Rows([self.indices[i] for i in keep], self.dense[keep])


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit_linear(rows: Rows, y: np.ndarray, k: int, penalty: float = 1e-4, steps: int = 300) -> Linear:
    """Logistic regression: mean log-loss plus penalty / 2 times the squared weights, by accelerated
    gradient steps."""
    n, d = len(y), k + rows.dense.shape[1]
    if not n or y.min() == y.max():
        return Linear(np.zeros(d), 6.0 if n and y.min() == 1 else -6.0)
    base = float(np.log(y.mean() / (1 - y.mean())))
    w = z = np.zeros(d)
    b = c = base
    # the curvature is at most a quarter of the mean squared row length, bias included
    rate = 4.0 / (float(np.mean(rows.lengths + (rows.dense**2).sum(1))) + 1.0)
    for t in range(steps):
        r = (sigmoid(rows.dot(z) + c) - y) / n
        w1, b1 = z - rate * (rows.back(r, k) + penalty * z), c - rate * r.sum()
        m = t / (t + 3)
        z, c = w1 + m * (w1 - w), b1 + m * (b1 - b)
        w, b = w1, b1
    return Linear(w, float(b))


@dataclass
class Chain:
    """vocabulary: feature to index; models: one for each category; threshold of the last."""

    vocabulary: dict[str, int]
    models: list[Linear]
    threshold: float

    def score(self, text: str) -> list[float]:
        """Probability of each category."""
        get = self.vocabulary.get
        found = [i for f in word_features(text) if (i := get(f)) is not None]
        out: list[float] = []
        k = len(self.vocabulary)
        for m in self.models:
            x = m.bias + sum(m.weights[i] for i in found) + sum(p * w for p, w in zip(out, m.weights[k:], strict=True))
            out.append(1 / (1 + np.exp(-max(-30.0, min(30.0, x)))))
        return [float(p) for p in out]


def fit_chain(indices: list[np.ndarray], targets: np.ndarray, fold: np.ndarray, vocabulary: dict[str, int]) -> tuple[Chain, np.ndarray]:
    """targets: (rows, categories). Returns the chain and the out-of-fold probabilities."""
    n, k = len(indices), len(vocabulary)
    out = np.zeros((n, 0))
    models = []
    for c in range(targets.shape[1]):
        rows, y = Rows(indices, out), targets[:, c].astype(float)
        held = np.zeros(n)
        for f in np.unique(fold):
            inside, outside = np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            held[outside] = sigmoid(fit_linear(rows.take(inside), y[inside], k).logit(rows.take(outside)))
        models.append(fit_linear(rows, y, k))
        out = np.concatenate([out, held[:, None]], 1)
    return Chain(vocabulary, models, _threshold(out[:, -1], targets[:, -1])), out


def _threshold(p: np.ndarray, y: np.ndarray) -> float:
    """Middle of the gap at the best F1, within 0.1 and 0.9."""
    order = np.argsort(-p, kind="stable")
    hits = np.cumsum(y[order])
    f1 = 2 * hits / (np.arange(1, len(p) + 1) + max(1, y.sum()))
    ranked = p[order]
    cut = np.append(ranked[:-1] > ranked[1:], True)  # equal probabilities stay together
    best = int(np.argmax(np.where(cut, f1, -1)))
    below = ranked[best + 1] if best + 1 < len(p) else 0.0
    return float(min(0.9, max(0.1, (ranked[best] + below) / 2)))


def _one_of_each(sample: DataFrame) -> DataFrame:
    """Of copies and most near copies one row: those that agree in three minimum hashes of their
    features. Else the chance words of a text copied often would pass for signs of its class."""
    minima = [F.array_min(F.transform("f", lambda w, k=k: F.xxhash64(F.lit(k), w))).alias(f"__m{k}") for k in range(3)]
    first = Window.partitionBy("__m0", "__m1", "__m2", "y").orderBy("h", "i")
    return sample.select("*", *minima).withColumn("__rn", F.row_number().over(first)).where("__rn = 1").select(*sample.columns)


def overt(indices: list[np.ndarray], y: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Which positive rows have one of the first signs (feature indices, the strongest first), so many of
    them as half of the positive rows need."""
    held = np.zeros(len(indices), bool)
    rows, flat = np.repeat(np.arange(len(indices)), [len(x) for x in indices]), np.concatenate([*indices, np.zeros(0, np.int64)]).astype(np.int64)
    for sign in signs:
        if held.sum() * 2 >= y.sum():
            break
        held[rows[flat == sign]] = True
        held &= y
    return held


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_positive: int = 4000, max_negative: int = 8000, max_features: int = 4000, folds: int = 4) -> Chain | None:
    """The chain fitted on a sample of the labelled rows, or None without rows of both classes."""
    known = labels.select(F.col(id_col).alias("i"), F.col(label_col).alias("y")).where("i IS NOT NULL AND y IS NOT NULL").groupBy("i").agg((F.max("y") > 0).alias("y"))
    known = known.select("i", "y", F.xxhash64(F.lit("toxicity"), "i").alias("h"))
    picked = known.where("y").orderBy("h", "i").limit(max_positive).unionByName(known.where("NOT y").orderBy("h", "i").limit(max_negative))
    texts = docs.select(F.col(id_col).alias("d"), filled(text_col).alias("t")).join(F.broadcast(picked), F.col("d") == F.col("i"))
    texts = texts.groupBy("i", "y", "h").agg(F.min("t").alias("t")).select(F.col("i").cast("string").alias("i"), "y", "h", "t")

    def extract(batches):
        for batch in batches:
            feats = [sorted(word_features(t)) for t in strings(batch.column(3))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(feats, pa.list_(pa.string()))], ["i", "y", "h", "f"])

    sample = materialise(arrow_map(texts, extract, "i string, y boolean, h long, f array<string>"), "toxicity-sample")
    sample = materialise(_one_of_each(sample), "toxicity-distinct")
    n1, n0 = sample.agg(F.count_if("y"), F.count_if(~F.col("y"))).first()
    if not n1 or not n0:
        return None
    n = n1 + n0
    counts = sample.select("y", F.explode("f").alias("f")).groupBy("f").agg(F.count_if("y").alias("a"), F.count_if(~F.col("y")).alias("b"))
    total = F.col("a") + F.col("b")
    gap = F.col("a") * F.lit(float(n0)) - F.col("b") * F.lit(float(n1))
    chi2 = F.lit(float(n)) * gap * gap / (F.lit(float(n1)) * F.lit(float(n0)) * total * F.greatest(F.lit(float(n)) - total, F.lit(1.0)))
    ranked = counts.withColumn("x", chi2).orderBy(F.desc("x"), "f").select("f", "x", (gap > 0).alias("sign"), total.alias("n"))
    best = ranked.where("n >= 3").limit(max_features).collect() or ranked.limit(WEAK_FEATURES).collect()  # without any frequent feature, rare ones
    chosen = [r for r in best if r["x"] >= max(LEAST_CHI2, LEAST_PHI2 * n)] or best[:WEAK_FEATURES]
    vocabulary = {r["f"]: k for k, r in enumerate(chosen)}
    signs = np.array([k for k, r in enumerate(chosen) if r["sign"]], np.int64)

    def project(batches):
        for batch in batches:
            found = [[k for w in ws if (k := vocabulary.get(w)) is not None] for ws in batch.column(3).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(3)), pa.array(found, pa.list_(pa.int32()))], ["i", "y", "h", "f"])

    rows = arrow_map(sample, project, "i string, y boolean, h long, f array<int>").toPandas().sort_values(["h", "i"], kind="stable")
    indices, y = [np.asarray(x, np.int64) for x in rows["f"]], rows["y"].to_numpy(bool)
    plain = overt(indices, y, signs)
    fold = (rows["h"].to_numpy(np.int64) % folds).astype(int)
    return fit_chain(indices, np.stack([plain, y & ~plain, y], 1), fold, vocabulary)[0]


def score(docs: DataFrame, chain: Chain | None, text_col: str = "text") -> DataFrame:
    """docs with __p_overt, __p_veiled, __p_toxic and __toxic; no shuffle."""
    *names, verdict = free_names(docs.columns, [*[f"__p_{c}" for c in CATEGORIES], "__toxic"])
    if chain is None:
        return docs.select("*", *[F.lit(0.0).alias(x) for x in names], F.lit(False).alias(verdict))
    at = docs.columns.index(text_col)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            p = np.array([chain.score(t) for t in strings(batch.column(at).cast(pa.string()))]).reshape(-1, len(names))
            columns = [pa.array(p[:, k]) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns, pa.array(p[:, -1] >= chain.threshold)], [*batch.schema.names, *names, verdict])

    fields = [*docs.schema.fields, *[T.StructField(x, T.DoubleType()) for x in names], T.StructField(verdict, T.BooleanType())]
    return arrow_map(docs, run, T.StructType(fields))


def clean(docs: DataFrame, chain: Chain | None, text_col: str = "text") -> DataFrame:
    """The rows of docs that the chain does not call toxic."""
    return score(docs, chain, text_col).where(~F.col(free_names(docs.columns, ["__toxic"])[0])).select(*[F.col(f"`{c}`") for c in docs.columns])
