"""Vocabularies, token arrays, padding, span corruption, ragged offsets."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import md5_unit

PAD, EOS, UNK = 0, 1, 2


def vocab_counts(tokens: DataFrame, token: str, size: int) -> DataFrame:
    """token, count, rank (from 1; by count descending, then token): the ``size`` most frequent.
    A top-k over map-side-combined counts; the rank window sees only those."""
    counts = tokens.groupBy(token).agg(F.count(F.lit(1)).alias("count"))
    top = counts.orderBy(F.desc("count"), token).limit(size)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("count"), token)).cast("long"))


def padded_vocab(top: DataFrame, token: str, size: int) -> DataFrame:
    """rank and token for ranks 1 .. size; missing ones are <unused_k>."""
    ranks = top.sparkSession.range(1, size + 1).withColumnRenamed("id", "rank")
    joined = ranks.join(F.broadcast(top), "rank", "left")
    return joined.select("rank", F.coalesce(F.col(token), F.concat(F.lit("<unused_"), F.col("rank").cast("string"), F.lit(">"))).alias(token))


def lookup(ids: dict[str, int], token: Column, unknown: int = UNK) -> Column:
    """Identifier of a token by a literal map, for vocabularies of a few thousand."""
    table = F.create_map(*[F.lit(x) for kv in sorted(ids.items()) for x in kv])
    return F.coalesce(F.try_element_at(table, token), F.lit(unknown))


def finish(ids: Column, length: int | None = None, eos: int = EOS) -> Column:
    """ids with the end appended, cut so that the end is always the last."""
    body = ids if length is None else F.slice(ids, 1, length - 1)
    return F.concat(body, F.array(F.lit(eos)))


def pad(ids: Column, width: Column, fill: int = PAD) -> Column:
    """Right-padded to width, or cut to it."""
    cut = F.slice(ids, F.lit(1), width)
    return F.concat(cut, F.array_repeat(F.lit(fill), F.greatest(width - F.size(cut), F.lit(0))))


def mask(length: Column, width: Column) -> Column:
    """Ones for the first ``length`` places, from lengths and not from the padding's value."""
    return F.transform(F.sequence(F.lit(1), width), lambda i: (i <= length).cast("int"))


def batch_width(df: DataFrame, batch: list[str], ids: str, multiple: int = 1) -> DataFrame:
    """df with ``width``: the batch's longest row, rounded up to a multiple."""
    longest = df.groupBy(*batch).agg(F.max(F.size(ids)).alias("__w"))
    return df.join(longest, batch).withColumn("width", (F.ceil(F.col("__w") / multiple) * multiple).cast("int")).drop("__w")


def trim_generated(ids: Column, eos: int = EOS, fill: int = PAD) -> Column:
    """What stands before the first end, without padding."""
    at = F.array_position(ids, F.lit(eos))
    return F.filter(F.when(at > 0, F.slice(ids, F.lit(1), (at - 1).cast("int"))).otherwise(ids), lambda x: x != fill)


def freeze_after(ids: Column, eos: int = EOS, fill: int = PAD) -> Column:
    """Everything after the first end becomes padding."""
    at = F.array_position(ids, F.lit(eos))
    return F.transform(ids, lambda x, i: F.when((at > 0) & (i >= at), F.lit(fill)).otherwise(x))


def corrupt(ids: Column, spans: Column, sentinel: int, eos: int = EOS) -> tuple[Column, Column]:
    """Inputs and labels of given spans (array of struct<start, len>, starts from 0, ascending): each
    span is replaced by a sentinel (counting down) in the inputs; the labels hold each sentinel with
    its span, a final sentinel and the end. Without spans the row is unchanged, its labels empty."""
    n = F.size(spans)
    inside = F.transform(spans, lambda s, i: F.concat(F.array(F.lit(sentinel) - i), F.slice(ids, s["start"] + 1, s["len"])))
    labels = F.concat(F.flatten(inside), F.array(F.lit(sentinel) - n, F.lit(eos)))
    keep = F.transform(
        ids,
        lambda x, i: F.aggregate(
            F.transform(spans, lambda s, k: F.struct(s["start"].alias("a"), s["len"].alias("l"), k.alias("k"))),
            F.array(x),
            lambda acc, s: F.when(i == s["a"], F.array(F.lit(sentinel) - s["k"])).when((i > s["a"]) & (i < s["a"] + s["l"]), F.array().cast("array<int>")).otherwise(acc),
        ),
    )
    return F.when(n > 0, F.flatten(keep)).otherwise(ids), F.when(n > 0, labels).otherwise(F.array().cast("array<int>"))


def reconstruct(inputs: Column, labels: Column, sentinel: int, least: int) -> Column:
    """Inverse of ``corrupt``: sentinels of the inputs replaced by their spans in the labels.
    Sentinels are the identifiers from least to sentinel."""

    def span(x: Column) -> Column:
        begin = F.array_position(labels, x)
        rest = F.slice(labels, (begin + 1).cast("int"), F.size(labels))
        stop = F.array_position(F.transform(rest, lambda y: y.between(least, sentinel)), F.lit(True))
        return F.slice(rest, F.lit(1), (stop - 1).cast("int"))

    return F.flatten(F.transform(inputs, lambda x: F.when(x.between(least, sentinel), span(x)).otherwise(F.array(x))))


def hashed_spans(df: DataFrame, key: str, ids: str, seed: int, ratio: float = 0.15, longest: int = 3, most: int = 8, protect: int = 1) -> DataFrame:
    """df with ``spans`` (array of struct<start, len>): random spans over a row's tokens, of which the
    last ``protect`` are safe. Lengths from 1 to longest are drawn up to the budget (a share of the free
    tokens, most * longest at most) and placed with a gap of one at least. Draws are MD5s of seed and
    row key, so spans depend on no partition."""

    def draw(tag: str, k: Column) -> Column:
        return md5_unit(F.concat(F.lit(f"{seed}:{tag}:"), F.col(key).cast("string"), F.lit(":"), k.cast("string")))

    def upto(k: Column) -> Column:
        return F.aggregate(F.slice("__drawn", F.lit(1), k), F.lit(0), lambda x, y: x + y)

    def span(k: Column) -> Column:
        return F.struct((F.element_at("__marks", k + 1) + upto(k) + k).cast("int").alias("start"), F.element_at("__drawn", k + 1).alias("len"))

    def counting(n: Column) -> Column:
        return F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))

    free = F.size(ids) - protect
    budget = F.greatest(F.lit(0), F.least(F.lit(most * longest), F.floor(F.lit(ratio) * free + 1e-9).cast("int")))
    k = F.sequence(F.lit(0), F.lit(most - 1))
    rows = df.withColumn("__drawn", F.transform(k, lambda i: F.floor(draw("length", i) * longest).cast("int") + 1)).withColumn("__budget", budget)
    within = F.filter(F.transform(k, lambda i: F.least(F.element_at("__drawn", i + 1), F.col("__budget") - upto(i))), lambda x: x > 0)
    rows = rows.withColumn("__drawn", within)
    rows = rows.withColumn("__drawn", F.filter("__drawn", lambda x, i: upto(i + 1) + i <= free))
    n = F.size("__drawn")
    slack = free - upto(n) - (n - 1)
    rows = rows.withColumn("__marks", F.sort_array(F.transform(counting(n), lambda i: F.floor(draw("place", i) * (slack + 1)).cast("int"))))
    return rows.withColumn("spans", F.transform(counting(n), span)).drop("__drawn", "__budget", "__marks")


def longest_match(plain: list[str], brackets: list[str], unk: str = "<unk>"):
    """A pandas UDF that scans text from the left: a known [..] or <..> group is one token, else the
    longest plain token; what matches nothing becomes one unknown token for each maximal run."""
    groups, words = frozenset(brackets), frozenset(plain)
    longest = max(map(len, words), default=1)

    def scan(s: str) -> list[str]:
        out, i, lost = [], 0, False
        while i < len(s):
            hit = None
            if s[i] in "[<":
                j = s.find("]" if s[i] == "[" else ">", i)
                if j > 0 and s[i : j + 1] in groups:
                    hit = s[i : j + 1]
            if hit is None:
                hit = next((s[i : i + n] for n in range(min(longest, len(s) - i), 0, -1) if s[i : i + n] in words), None)
            if hit is None:
                if not lost:
                    out.append(unk)
                lost = True
                i += 1
            else:
                out.append(hit)
                lost = False
                i += len(hit)
        return out

    @F.pandas_udf("array<string>")
    def tokenise(v: pd.Series) -> pd.Series:
        return v.map(lambda s: scan(s or ""))

    return tokenise


def ragged_offsets(df: DataFrame, by: list[str], order: str, n: str) -> DataFrame:
    """df with ``end``, the running sum of n within by, and ``begin``."""
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = df.withColumn("end", F.sum(n).over(w))
    return end.withColumn("begin", F.col("end") - F.col(n))
