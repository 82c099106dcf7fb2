"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked within a Hamming radius by
BK-trees, and the connected components of the links.

Fingerprints are made row by row in Arrow batches. Everything after works on distinct fingerprints,
so copies, however many, are one row. Two fingerprints within r bits agree in one of r + 1 bands, so
each fingerprint is dealt to the r + 1 shards (band, value) and a shard's BK-tree holds the
fingerprints that agree there: children are keyed by their Hamming distance to the parent and a
search follows only the edges within the radius. Trees stay where their shard lies; broadcasting them
would mean to gather every fingerprint at the driver. A shard of over ``shard_rows`` fingerprints
agrees in some band already, so it is dealt again by bands of its remaining bits, until no shard is
larger: with b bits left a shard cannot have more than 2 ** b distinct fingerprints, so this ends,
and no candidate is lost. A tree emits a spanning forest of its links, at most one link a
fingerprint, which has the same components as all of them.

Components come from alternating large-star and small-star rounds over the links, each round a
written table in the shared folder, until nothing changes or so few links are left that one task can
finish them.

Similar texts (``similar_links``) are linked by fingerprints and trees first. Radii that fit a similarity of
0.8 let no tree leave out a branch, so the pairs beyond a small radius are found by sorted bands of minimum
hashes, wide fingerprints and rare shingles. The exact similarity of the shingle sets decides for all.

Defined results: null text counts as empty; a text without words has fingerprint zero and is linked
like any other; a text of fewer words than a shingle is one shingle; a text is read whole, however long,
in the memory of some 30 times its bytes; a null identifier takes part in the links but is not chosen as
a component's smallest unless the component has no other; repeated rows repeat their results, but
``near_distinct`` keeps one of them; empty tables give empty results; other columns are ignored, by
``near_distinct`` carried along, and may have any names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import arrow_map, filled, map_rows, materialise, strings

SEED = 42
BITS = 64


def shingle_hashes(text: str, shingle: int) -> np.ndarray:
    """XXH64 of each shingle, repeats included: lower-cased ASCII, words between ASCII white space,
    joined by spaces; fewer words than a shingle are one shingle, no words none."""
    words = text.encode().lower().split()
    joined = b" ".join(words)
    if len(words) <= shingle:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)] if words else [], np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest, n = xxhash.xxh64_intdigest, len(words) - shingle + 1
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), ends[shingle - 1 :].tolist(), strict=True)), np.uint64, n)


def majority(hashes: np.ndarray) -> bytes:
    """Eight bytes, most significant first: a bit is set if over half the hashes set it."""
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), 1 << 15):  # the unpacked bits of a block at a time
        block = hashes[k : k + (1 << 15)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1).sum(0, dtype=np.int64)
    return np.packbits(counts * 2 > len(hashes)).tobytes()


def simhash(text: str, shingle: int = 3) -> int:
    """Fingerprint, as an unsigned 64-bit integer; zero for a text without words."""
    return int.from_bytes(majority(shingle_hashes(text, shingle)), "big")


def mixed(hashes: np.ndarray, k: int) -> np.ndarray:
    """The k-th of a family of hash functions of the hashes (splitmix64's finaliser)."""
    x = hashes + np.uint64((0x9E3779B97F4A7C15 * (k + 1)) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def fingerprints(docs: DataFrame, shingle: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col and fp, the fingerprint as a signed long."""
    kind = docs.schema[id_col].dataType.simpleString()

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            prints = np.array([simhash(t, shingle) for t in strings(batch.column(1))], np.uint64)
            return pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints.view(np.int64))], ["__id", "fp"])

        return one

    return map_rows(docs.select(docs[id_col], filled(text_col).alias("t")), make, f"__id {kind}, fp long").withColumnRenamed("__id", id_col)


def shingle_set(text: str, shingle: int) -> np.ndarray:
    """The distinct shingle hashes, ascending: the similarity is one of sets."""
    return np.unique(shingle_hashes(text, shingle))


def sketches(rows: DataFrame, shingle: int = 5, words: int = 16, minima: int = 16) -> DataFrame:
    """rows (columns i, t: text, t0, t1) with fp (a fingerprint of ``words`` times 64 bits, binary), keys
    (``minima`` minimum hashes of the shingles) and same (a digest of their set) in the place of the
    text, from one pass over it."""
    kind = rows.schema["i"].dataType.simpleString()

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            prints, keys, same = [], [], []
            for text in strings(batch.column(1)):
                hashes = shingle_set(text, shingle)
                prints.append(b"".join(majority(mixed(hashes, k)) for k in range(words)))
                keys.append(np.array([mixed(hashes, 100 + k).min() if len(hashes) else 0 for k in range(minima)], np.uint64).view(np.int64))
                same.append(xxhash.xxh3_128_digest(hashes.tobytes()))
            columns = [pa.array(prints, pa.binary()), pa.array(keys, pa.list_(pa.int64())), pa.array(same, pa.binary())]
            return pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), batch.column(3), *columns], ["i", "t0", "t1", "fp", "keys", "same"])

        return one

    return map_rows(rows.select("i", "t", "t0", "t1"), make, f"i {kind}, t0 long, t1 long, fp binary, keys array<long>, same binary")


def with_shingles(rows: DataFrame, shingle: int) -> DataFrame:
    """rows (columns id, fp, keys, t: text) with shingles (``shingle_set``, eight bytes each) in the place
    of the text."""

    def make():
        def one(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [shingle_set(t, shingle).tobytes() for t in strings(batch.column(3))]
            return pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(sets, pa.binary())], ["id", "fp", "keys", "shingles"])

        return one

    return map_rows(rows.select("id", "fp", "keys", "t"), make, "id long, fp binary, keys array<long>, shingles binary")


class BKTree:
    """Burkhard-Keller tree of integers under the Hamming distance."""

    def __init__(self, root: int):
        self.root = root
        self.children: dict[int, dict[int, int]] = {root: {}}

    def add(self, value: int) -> None:
        node = self.root
        while True:
            d = (node ^ value).bit_count()
            if d == 0:
                return
            below = self.children[node]
            if d not in below:
                below[d] = value
                self.children[value] = {}
                return
            node = below[d]

    def within(self, value: int, radius: int) -> list[int]:
        found, stack = [], [self.root]
        while stack:
            node = stack.pop()
            d = (node ^ value).bit_count()
            if d <= radius:
                found.append(node)
            below = self.children[node]
            if below:
                for edge in range(max(1, d - radius), d + radius + 1):
                    if edge in below:
                        stack.append(below[edge])
        return found


def forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Links (value, smallest of its component) of the values within the radius of each other."""
    tree, parent = BKTree(values[0]), {values[0]: values[0]}

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for value in values[1:]:
        near = tree.within(value, radius)
        tree.add(value)
        parent.setdefault(value, value)
        for other in near:
            a, b = sorted((find(value), find(other)))
            parent[b] = a
    return [(v, r) for v in parent if (r := find(v)) != v]


def _bands(free: int, radius: int) -> list[int]:
    """Widths of radius + 1 bands of the free bits."""
    n = radius + 1
    return [free // n + (k < free % n) for k in range(n)]


def _shards(prints: DataFrame, radius: int, shard_rows: int) -> DataFrame:
    """fp, __shard: shards of which none has over shard_rows fingerprints, unless few bits are left.

    ``__free`` holds the bits that the shard's rows need not agree in; a band is the next run of them."""
    rows = prints.select("fp", F.lit("").alias("__shard"), F.lit(-1).cast("long").alias("__free"))
    done: DataFrame | None = None
    free = BITS
    while True:
        widths, arms, at = _bands(free, radius), [], 0
        for k, width in enumerate(widths):
            mask = _band_mask("__free", at, width)
            arms.append(F.struct(F.concat_ws("/", "__shard", F.lit(str(k)), F.hex(F.col("fp").bitwiseAND(mask))).alias("s"), F.col("__free").bitwiseAND(F.bitwise_not(mask)).alias("f")))
            at += width
        dealt = rows.select("fp", F.explode(F.array(*arms)).alias("d")).select("fp", F.col("d.s").alias("__shard"), F.col("d.f").alias("__free"))
        free -= min(widths)
        crowded = materialise(dealt.groupBy("__shard").count().where(F.col("count") > shard_rows).select("__shard"), "simhash-crowded")
        if free <= 10 or crowded.isEmpty():
            return (done.unionByName(dealt) if done is not None else dealt).select("fp", "__shard")
        small = dealt.join(crowded, "__shard", "left_anti")
        done = done.unionByName(small) if done is not None else small
        rows = materialise(dealt.join(crowded, "__shard", "left_semi"), "simhash-dealt")


def _band_mask(free_col: str, at: int, width: int):
    """The lowest set bits number at .. at + width - 1 of the free bits, as a mask. The free bits of
    a first deal are all 64; later ones are what earlier masks left, so they are found bit by bit."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.getbit(F.col(free_col), i) == 1)
    return F.aggregate(F.slice(bits, at + 1, width), F.lit(0).cast("long"), lambda m, i: m.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))


def links(prints: DataFrame, radius: int = 2, shard_rows: int = 1000) -> DataFrame:
    """a > b pairs (fp values) whose components are those of all pairs within the radius.

    prints: a column fp of distinct longs."""
    return _shard_links(_shards(prints, radius, shard_rows), radius)


def _shard_links(shards: DataFrame, radius: int) -> DataFrame:
    """A spanning forest of each shard's links. shards: fp, __shard."""
    dealt = shards.select("fp", "__shard").repartition("__shard").sortWithinPartitions("__shard", "fp")

    def flush(values: list[int]) -> list[tuple]:
        if len(values) < 2:
            return []
        return [(_signed(a), _signed(b)) for a, b in forest([v & 0xFFFFFFFFFFFFFFFF for v in dict.fromkeys(values)], radius)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, values = None, []
        for batch in batches:
            prints, codes = batch.column(0).to_pylist(), batch.column(1).dictionary_encode()
            ids, names = codes.indices.to_numpy(), codes.dictionary.to_pylist()
            found: list[tuple] = []
            starts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist()] if len(ids) else []
            for a, b in zip(starts, [*starts[1:], len(ids)], strict=True):
                if (name := names[ids[a]]) != key:
                    found += flush(values)
                    key, values = name, []
                values += prints[a:b]
            yield _pairs(found, pa.int64())
        yield _pairs(flush(values), pa.int64())

    return arrow_map(dealt, run, "a long, b long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _pairs(found: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], kind), pa.array([x[1] for x in found], kind)], ["a", "b"])


#: Bits within which BK-trees link the fingerprints of similar texts.
RADIUS = 3
#: Minimum hashes that name a band.
FIRST_KEYS = 2
#: Minimum hashes by which the candidates of one band are ordered.
ORDER_KEYS = 4
#: Bytes of shingles in a block, unless a single text has more.
BLOCK_BYTES = 32 << 20
#: Buckets in which shingles are counted, to tell rare ones from common ones.
BUCKETS = 1 << 17


def similar_links(prints: DataFrame, shingled: Callable[[DataFrame], DataFrame], similarity: float = 0.8, words: int = 16, shard_rows: int = 1000, bands: int = 8, radius: int = RADIUS) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, label) and links (a > b, of labels): their components are those of all pairs of the
    similarity or more that are linked by a BK-tree or share a band.

    First come SimHash fingerprints of 64 bits, links within ``radius`` by BK-trees in shards and their components,
    as in ``links``. A component is sorted by minimum hashes and the shingles of neighbours decide, block by block;
    what is linked there gets one label, and pass 3 compares what blocks part. Pairs of the similarity differ in
    some 10 bits, so the trees alone would miss most of them.

    A band is two minimum hashes of the shingles: texts of Jaccard similarity j share one of ``bands``
    with probability 1 - (1 - j^2)^bands, 0.9997 at 0.8. Texts that share none with any other and
    have no link by a tree go no further; the rest are candidates. Two passes find most links at little cost, a third loses none:

    1. Candidates are sorted by the first band and further minimum hashes and searched in blocks of
       neighbours. What is linked there gets one label.
    2. In each other band one candidate stands for all of a label; the bands that hold several labels
       are sorted and searched in blocks likewise. Linked labels become one.
    3. Two sets of similarity s share one of the rarest (1 - s) of either's shingles, by any order that
       all sets agree on. Candidates with such a shingle in common form a shard, so that texts which
       share no more than a passage hardly meet. Shards of one label need no search; in the others all
       pairs of different labels are compared, block by block, by fingerprint and number of shingles.
       What these can't tell apart forms a cluster, and in a cluster, where a text stands once however
       many shards it had, the shingles themselves are compared, block by block again.

    No task holds more than two blocks, whatever the size of a group. Copies, however many, cost a few
    comparisons each. Texts that are alike even in their rare shingles, but under the similarity, cost
    the square of their number, spread over as many tasks as there are pairs of blocks.

    prints: id, fp, keys of ``sketches``, one row for each set of shingles; shingled: gives such rows the
    column shingles."""
    names = [F.xxhash64(F.lit(k), *[F.col("keys")[FIRST_KEYS * k + i] for i in range(FIRST_KEYS)]) for k in range(bands)]
    dealt = prints.select("id", F.explode(F.array(*names)).alias("shard"))
    shared = dealt.groupBy("shard").agg(F.min("id").alias("x"), F.max("id").alias("y")).where("x <> y").select("shard")
    tree = materialise(_tree_groups(prints, radius, shard_rows), "simhash-tree")
    rows = materialise(dealt.join(shared, "shard", "left_semi").select("id").unionByName(tree.select("id")).distinct(), "simhash-shared")
    sketch = materialise(shingled(prints.join(rows, "id", "left_semi")), "simhash-candidates")

    search = _searcher(similarity, words, shard_rows)
    order = [F.col("keys")[FIRST_KEYS * bands - 1 - i].alias(f"k{i}") for i in range(min(ORDER_KEYS, FIRST_KEYS * bands))]
    linked = tree.join(sketch, "id").select("shard", F.col("id").alias("label"), "fp", "shingles", *order, "id")
    labelled = _relabelled(sketch.select("id", F.col("id").alias("label")), _neighbours(linked, search, shard_rows))
    made = materialise(_neighbours(labelled.join(sketch, "id").select(names[0].alias("shard"), "label", "fp", "shingles", *order, "id"), search, shard_rows), "simhash-first")
    labelled = _relabelled(labelled, made).join(sketch.select("id", "keys"), "id")
    found = made
    if bands > 1:
        one = labelled.select("id", "label", F.explode(F.array(*names[1:])).alias("shard")).groupBy("shard", "label").agg(F.min("id").alias("id"))
        chosen = _mixed(materialise(one, "simhash-chosen")).join(sketch, "id")
        found = made.unionByName(materialise(_neighbours(chosen.select("shard", "label", "fp", "shingles", *order, "id"), search, shard_rows), "simhash-bands"))
    roots = stars(found, "simhash-stars")
    nodes = materialise(labelled.join(roots, F.col("label") == F.col("node"), "left").select("id", F.coalesce("root", "label").alias("label")), "simhash-nodes")

    rare = _rare_shingles(sketch.select("id", "shingles").join(nodes, "id"), _bucket_counts(sketch), similarity)
    mixed = materialise(_mixed(materialise(rare, "simhash-rare")), "simhash-mixed")
    units = _units(mixed, shard_rows).join(sketch.select("id", "fp"), "id").select("unit", "label", "fp", "size", "id")
    roots = stars(_grouped(units, _pairing(similarity, words)), "simhash-clusters")
    clusters = roots.select(F.col("root").alias("shard"), F.col("node").alias("id")).unionByName(roots.select(F.col("root").alias("shard"), F.col("root").alias("id")).distinct())
    clusters = materialise(clusters.join(nodes, "id").join(sketch.select("id", F.octet_length("shingles").cast("long").alias("size")), "id"), "simhash-clustered")
    units = _units(clusters, shard_rows).join(sketch.select("id", "fp", "shingles"), "id").select("unit", "label", "fp", "shingles")
    return nodes, materialise(_grouped(units, search), "simhash-links")


def _tree_groups(prints: DataFrame, radius: int, shard_rows: int) -> DataFrame:
    """shard, id: the components, of more than one row, of the links within the radius of 64-bit fingerprints
    (the first 64 bits of fp), found by BK-trees. Equal fingerprints of different sets are linked too."""
    prints = materialise(prints.select("id", F.conv(F.hex(F.substring("fp", 1, BITS // 8)), 16, -10).cast("long").alias("fp")), "simhash-prints")
    roots = stars(links(prints.select("fp").distinct(), radius, shard_rows), "simhash-tree-stars")
    groups = prints.join(roots, F.col("fp") == F.col("node"), "left").select(F.coalesce("root", "fp").alias("shard"), "id")
    several = groups.groupBy("shard").count().where("count > 1").select("shard")
    return groups.join(several, "shard", "left_semi")


def _relabelled(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """Nodes (id, label) with one label for those that the links found among labels join."""
    roots = stars(found, "simhash-relabelled")
    return materialise(nodes.join(roots, F.col("label") == F.col("node"), "left").select("id", F.coalesce("root", "label").alias("label")), "simhash-labelled")


def _mixed(dealt: DataFrame) -> DataFrame:
    """The rows of shards with several labels; of shards with the same members one."""
    sign = [F.bit_xor(F.xxhash64(F.lit(k), "id")).alias(f"x{k}") for k in range(2)]
    shards = dealt.groupBy("shard").agg(F.count("*").alias("n"), F.min("label").alias("least"), F.max("label").alias("most"), *sign).where("least <> most")
    once = shards.groupBy("n", "least", "most", "x0", "x1").agg(F.min("shard").alias("shard")).select("shard")
    return dealt.join(once, "shard", "left_semi")


def _neighbours(rows: DataFrame, search: Callable[..., list[tuple]], shard_rows: int) -> DataFrame:
    """a, b: links in blocks of consecutive rows of a shard. rows: shard, label, fp, shingles, then the
    columns of the order, by which even a crowded shard is dealt over many tasks."""
    order = ["shard", *rows.columns[4:]]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(*rows.columns[:4])
    return arrow_map(dealt, lambda batches: _by_shard(batches, search, shard_rows), "a long, b long")


def _bucket_counts(sketch: DataFrame) -> np.ndarray:
    """How many shingles fall in each of BUCKETS buckets: a table of fixed size, so it may go to the
    driver and to every task."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS, np.int64)
        for batch in batches:
            flat = np.frombuffer(b"".join(batch.column(0).to_pylist()), np.uint64)
            total += np.bincount(_bucket(flat), minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], ["k", "n"])

    counts = arrow_map(sketch.select("shingles"), count, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    out = np.zeros(BUCKETS, np.int64)
    out[counts["k"].to_numpy(np.int64)] = counts["n"].to_numpy(np.int64)
    return out


def _bucket(shingles: np.ndarray) -> np.ndarray:
    return (shingles & np.uint64(BUCKETS - 1)).astype(np.int64)


def rarest(shingles: np.ndarray, counts: np.ndarray, similarity: float) -> np.ndarray:
    """The first shingles by (count of their bucket, value), so many that two sets of the similarity have
    one of them in common."""
    n = len(shingles)
    most = n - int(np.ceil(similarity * n - 1e-9)) + 1
    return shingles[np.lexsort((shingles, counts[_bucket(shingles)]))[:most]]


def _rare_shingles(rows: DataFrame, counts: np.ndarray, similarity: float) -> DataFrame:
    """shard (a rare shingle), id, label, size (bytes of all the text's shingles). rows: id, shingles, label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.frombuffer(x, np.uint64) for x in batch.column(1).to_pylist()]
            rare = [rarest(x, counts, similarity) for x in sets]
            times = np.array([len(x) for x in rare], np.int64)
            flat = np.concatenate([*rare, np.zeros(0, np.uint64)]).astype(np.uint64)
            columns = [np.repeat(x, times) for x in (batch.column(0).to_numpy(), batch.column(2).to_numpy(), np.array([x.nbytes for x in sets], np.int64))]
            yield pa.RecordBatch.from_arrays([pa.array(flat.view(np.int64)), *[pa.array(x, pa.int64()) for x in columns]], ["shard", "id", "label", "size"])

    return arrow_map(rows.select("id", "shingles", "label"), run, "shard long, id long, label long, size long")


def _grouped(rows: DataFrame, search: Callable[..., list[tuple]]) -> DataFrame:
    """search over the rows of each unit, the first column."""
    dealt = rows.repartition("unit").sortWithinPartitions("unit")
    return arrow_map(dealt, lambda batches: _by_shard(batches, search), "a long, b long")


def _pairing(similarity: float, words: int) -> Callable[..., list[tuple]]:
    """Links of the identifiers in a unit that fingerprints and numbers of shingles do not tell apart,
    pairs of one label left out."""
    radius = radius_of(similarity, BITS * words, SLACK)

    def search(labels: list[int], prints: list[bytes], sizes: list[int], ids: list[int]) -> list[tuple]:
        bits = np.frombuffer(b"".join(prints), np.uint64).reshape(len(prints), words)
        of, counts = np.array(labels, np.int64), np.array(sizes, np.int64) // 8
        return merged(ids, lambda i, others: maybe_similar(i, others, counts, bits, similarity, radius) & (of[others] != of[i]))

    return search


def _units(mixed: DataFrame, shard_rows: int) -> DataFrame:
    """id, label, size, unit: rows that a task compares at once. A shard that fits in a block is a unit. Of a
    larger one the rows of its largest label, which need no comparison with each other, are dealt to
    blocks, and so are the others; the units are the pairs of blocks, but for those within that label.

    mixed: shard, id, label, size."""

    def blocks(n, size):
        return F.ceil(F.greatest(n / F.lit(shard_rows), size / F.lit(BLOCK_BYTES))).cast("int")

    by_label = mixed.groupBy("shard", "label").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    shards = by_label.groupBy("shard").agg(F.sum("n").alias("n"), F.sum("size").alias("size"), F.max(F.struct("n", "size", "label")).alias("top"))
    fits = blocks(F.col("n"), F.col("size")) <= 1
    plan = shards.select(
        "shard",
        F.when(~fits, F.col("top.label")).alias("top"),
        F.when(fits, F.lit(1)).otherwise(F.greatest(F.lit(1), blocks(F.col("n") - F.col("top.n"), F.col("size") - F.col("top.size")))).alias("others"),
        F.when(fits, F.lit(0)).otherwise(F.greatest(F.lit(1), blocks(F.col("top.n"), F.col("top.size")))).alias("tops"),
    )
    plan = materialise(plan, "simhash-plan")
    of_top = F.coalesce(F.col("label") == F.col("top"), F.lit(False))
    rows = mixed.join(plan, "shard").withColumn("own", F.pmod(F.xxhash64(F.lit("block"), "id"), F.when(of_top, F.col("tops")).otherwise(F.col("others"))).cast("int"))

    def unit(kind: str, i, j):
        return F.xxhash64(F.lit(kind), F.col("shard"), i, j)

    def count(n: str):  # 0 .. n - 1
        return F.slice(F.sequence(F.lit(0), F.col(n)), F.lit(1), F.col(n))

    among = F.transform(count("others"), lambda j: unit("others", F.least("own", j), F.greatest("own", j)))
    across = F.transform(count("tops"), lambda j: unit("across", F.col("own"), j))
    units = F.when(of_top, F.transform(count("others"), lambda j: unit("across", j, F.col("own")))).otherwise(F.concat(among, across))
    return rows.select("id", "label", "size", F.explode(units).alias("unit"))


def merged(labels: list[int], near: Callable[[int, np.ndarray], np.ndarray]) -> list[tuple[int, int]]:
    """Links (label, smallest label of its component) of rows whose equal labels are one component
    already. near(i, others): which of the others row i is linked to. A row that was reached is not
    compared with again, so a group of copies costs one comparison a row, and no link that joins two
    components is missed."""
    rows: dict[int, list[int]] = {}
    for i, label in enumerate(labels):
        rows.setdefault(label, []).append(i)
    rest, found, open_ = np.arange(len(labels)), [], np.ones(len(labels), bool)
    for label, own in rows.items():
        if not open_[own[0]]:
            continue
        group, stack = [label], list(own)
        open_[own] = False
        rest = rest[open_[rest]]
        while stack and len(rest):
            hits = rest[near(stack.pop(), rest)]
            for other in dict.fromkeys(labels[i] for i in hits):
                group.append(other)
                stack += rows[other]
                open_[rows[other]] = False
            if len(hits):
                rest = rest[open_[rest]]
        root = min(group)
        found += [(x, root) for x in group if x != root]
    return found


#: Texts of fewer shingles are compared whatever their fingerprints, which ties and chance govern there.
FEW_SHINGLES = 64
#: Standard deviations beyond the similarity's mean distance within which fingerprints are candidates.
SLACK = 6.0


def maybe_similar(i: int, others: np.ndarray, sizes: np.ndarray, bits: np.ndarray, similarity: float, radius: int) -> np.ndarray:
    """Which of the others may have the Jaccard similarity to row i, by sizes and fingerprints."""
    least, most = np.minimum(sizes[others], sizes[i]), np.maximum(sizes[others], sizes[i])
    out = least >= similarity * most
    at = np.flatnonzero(out & (least >= FEW_SHINGLES))
    out[at] = np.bitwise_count(bits[others[at]] ^ bits[i]).sum(1, dtype=np.int64) <= radius
    return out


def similar_to(i: int, others: np.ndarray, sets: list[np.ndarray], sizes: np.ndarray, bits: np.ndarray, similarity: float, radius: int) -> np.ndarray:
    """Which of the others have the Jaccard similarity to row i: sizes and fingerprints leave out what
    cannot have it, the shingles decide."""
    at = np.flatnonzero(maybe_similar(i, others, sizes, bits, similarity, radius))
    out = np.zeros(len(others), bool)
    if len(at):
        members, own = [sets[k] for k in others[at]], sets[i]
        flat = np.concatenate(members)
        shared = own[np.minimum(np.searchsorted(own, flat), len(own) - 1)] == flat
        starts = np.concatenate([[0], np.cumsum([len(x) for x in members])[:-1]])
        both = np.add.reduceat(shared, starts, dtype=np.int64)
        out[at] = both / (sizes[others[at]] + sizes[i] - both) >= similarity
    return out


def _searcher(similarity: float, words: int, step: int) -> Callable[..., list[tuple]]:
    """The links of a block's components, from its labels, fingerprints and shingles."""
    radius = radius_of(similarity, BITS * words, SLACK)

    def search(labels: list[int], prints: list[bytes], shingles: list[bytes]) -> list[tuple]:
        if len(set(labels)) < 2:
            return []
        bits = np.frombuffer(b"".join(prints), np.uint64).reshape(len(prints), words)
        sets = [np.frombuffer(x, np.uint64) for x in shingles]
        sizes = np.array([len(x) for x in sets], np.int64)

        def near(i: int, others: np.ndarray) -> np.ndarray:
            parts = (others[k : k + step] for k in range(0, len(others), step))
            return np.concatenate([similar_to(i, part, sets, sizes, bits, similarity, radius) for part in parts])

        return merged(labels, near)

    return search


def _by_shard(batches: Iterator[pa.RecordBatch], search: Callable[..., list[tuple]], block_rows: int | None = None) -> Iterator[pa.RecordBatch]:
    """search(the other columns' values) of each run of equal first columns; with block_rows a run ends
    at so many rows or BLOCK_BYTES of the last column."""
    key, values, held = None, [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        shards, columns, found = batch.column(0).to_numpy(), [c.to_pylist() for c in batch.columns[1:]], []
        for k, shard in enumerate(shards.tolist()):
            if shard != key or block_rows and (len(values[0]) >= block_rows or held >= BLOCK_BYTES):
                found += search(*values) if values and len(values[0]) > 1 else []
                key, values, held = shard, [[] for _ in columns], 0
            for kept, column in zip(values, columns, strict=True):
                kept.append(column[k])
            held += len(columns[-1][k]) if block_rows else 0
        yield _pairs(found, pa.int64())
    yield _pairs(search(*values) if values and len(values[0]) > 1 else [], pa.int64())


#: So many links are finished by one task, which holds all their nodes: some 50 MB.
ONE_TASK_LINKS = 200_000


def stars(edges: DataFrame, label: str = "stars", one_task: int = ONE_TASK_LINKS) -> DataFrame:
    """Connected components: node, root (their smallest node) for every node of edges (a, b: longs) but
    the roots. Large-star and small-star by turns, every step a join and a map-side-combined minimum;
    where there are ``one_task`` links or fewer, which a step never makes more, one task finds the roots."""
    both = F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
    edges = materialise(edges.where("a <> b").select(*both).distinct(), label)
    seen, n = None, edges.count()
    while True:
        if n <= one_task:
            return materialise(_one_task_roots(edges), label)
        around = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        # the minima are written, so that the joins have plain exchanges on both sides, which Spark can
        # split where a star's centre has very many neighbours
        least = materialise(around.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), label)
        large = around.where("b > a").join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large = materialise(large, label)
        least = materialise(large.groupBy("a").agg(F.min("b").alias("m")), label)
        small = large.join(least, "a").where("b <> m").select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b")).unionByName(least.select("a", F.col("m").alias("b"))).distinct()
        edges = materialise(small, label)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == seen:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        seen, n = now, now[0]


def _one_task_roots(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parent: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := parent.setdefault(x, x)) != x:
                parent[x] = x = parent.setdefault(y, y)
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                x, y = sorted((find(a), find(b)))
                parent[y] = x
        roots = [(x, r) for x in list(parent) if (r := find(x)) != x]
        yield pa.RecordBatch.from_arrays([pa.array([x for x, _ in roots], pa.int64()), pa.array([r for _, r in roots], pa.int64())], ["node", "root"])

    return arrow_map(edges.select("a", "b").coalesce(1), run, "node long, root long")


def near_groups(docs: DataFrame, shingle: int = 3, radius: int = 2, shard_rows: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, fp (signed long), component_id (smallest identifier that
    links reach). Exact: bands find every pair within the radius, which must be small."""
    prints = materialise(fingerprints(docs.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")), shingle, "i", "t"), "simhash-prints")
    classes = materialise(prints.groupBy("fp").agg(F.min("i").alias("least")), "simhash-classes")
    roots = stars(links(classes.select("fp"), radius, shard_rows), "simhash-stars")
    named = materialise(classes.join(roots, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("class"), "least", F.coalesce("root", "fp").alias("root")), "simhash-named")
    first = materialise(named.groupBy("root").agg(F.min("least").alias("component_id")), "simhash-least")
    components = named.join(first, "root").select("class", "component_id")
    return prints.join(components, F.col("fp") == F.col("class"), "left").select(F.col("i").alias(id_col), "fp", "component_id")


def radius_of(similarity: float, bits: int, slack: float = 0.5) -> int:
    """Bits in which fingerprints of two equally long texts with this Jaccard similarity differ on
    average, and ``slack`` standard deviations more."""
    p = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return round(bits * p + slack * float(np.sqrt(bits * p * (1 - p))))


def _text_keys(text) -> list:
    """Two hashes by which a text is known."""
    return [F.xxhash64(F.lit(k), text).alias(f"t{k}") for k in range(2)]


def _similar_classes(docs: DataFrame, similarity: float, shingle: int, words: int, bands: int, shard_rows: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Rows (i: identifier, t0, t1: two hashes of the text, fp, same) and, for each same, its component's
    least (struct of whether the identifier is null, identifier, hashes)."""
    text = filled(text_col)
    rows = docs.select(F.col(id_col).alias("i"), text.alias("t"), *_text_keys(text))
    prints = materialise(sketches(rows, shingle, words, FIRST_KEYS * bands).withColumn("row", F.monotonically_increasing_id()), "simhash-sketches")
    classes = prints.groupBy("same").agg(F.min(F.struct(F.col("i").isNull().alias("n"), "i", "t0", "t1")).alias("least"), F.min("row").alias("id"))
    classes = materialise(classes, "simhash-classes")
    chosen = prints.join(classes.select("id"), F.col("row") == F.col("id"), "left_semi").select(F.col("row").alias("id"), "fp", "keys")

    def shingled(some: DataFrame) -> DataFrame:
        """Reads the texts of these again: they are few beside all."""
        of = classes.select("id", "least.i", "least.t0", "least.t1").join(some, "id")
        texts = rows.join(of, rows["i"].eqNullSafe(of["i"]) & (rows["t0"] == of["t0"]) & (rows["t1"] == of["t1"])).select("id", "fp", "keys", "t")
        return with_shingles(texts, shingle).dropDuplicates(["id"])  # rows may agree in identifier and text

    nodes, found = similar_links(chosen, shingled, similarity, words, shard_rows, bands)
    roots = stars(found, "simhash-last").withColumnRenamed("root", "last")
    nodes = nodes.join(roots, F.col("label") == F.col("node"), "left").select(F.col("id").alias("of"), F.coalesce("last", "label").alias("root"))
    named = materialise(classes.join(nodes, F.col("id") == F.col("of"), "left").select("same", "least", F.coalesce("root", "id").alias("root")), "simhash-named")
    first = materialise(named.groupBy("root").agg(F.min("least").alias("first")), "simhash-least")
    return prints.select("i", "t0", "t1", "fp", "same"), named.join(first, "root").select(F.col("same").alias("class"), "first")


def similar_groups(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, words: int = 16, bands: int = 8, shard_rows: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: id_col, fp (binary), component_id, for links of texts of the given
    Jaccard similarity of shingles or more, computed for each candidate pair."""
    prints, classes = _similar_classes(docs, similarity, shingle, words, bands, shard_rows, id_col, text_col)
    return prints.join(classes, F.col("same") == F.col("class"), "left").select(F.col("i").alias(id_col), "fp", F.col("first.i").alias("component_id"))


def near_distinct(docs: DataFrame, similarity: float = 0.8, shingle: int = 5, words: int = 16, bands: int = 8, shard_rows: int = 1000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one document of each group of similar ones: that of the smallest identifier, one without
    an identifier only where none has one; of rows that agree in identifier those of one text, and of
    rows that agree in both one. A row is known by identifier and text, so rows of other groups stay
    whatever identifiers they share. All columns are carried along, whatever their names."""
    prints, classes = _similar_classes(docs, similarity, shingle, words, bands, shard_rows, id_col, text_col)
    key = ["i", "t0", "t1"]
    rows = prints.join(classes, F.col("same") == F.col("class"), "left").select(*key, "first")
    gone = materialise(rows.where(~F.struct(F.col("i").isNull().alias("n"), *key).eqNullSafe(F.col("first"))).select(*key).distinct(), "simhash-gone")
    twice = materialise(prints.groupBy(*key).count().where("count > 1").select(*key), "simhash-twice")
    text = filled(text_col)
    keyed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), F.col(id_col).alias("i"), *_text_keys(text))

    def equal(a: DataFrame, b: DataFrame):
        return a["i"].eqNullSafe(b["i"]) & (a["t0"] == b["t0"]) & (a["t1"] == b["t1"])

    kept = keyed.join(gone, equal(keyed, gone), "left_anti")
    if not twice.isEmpty():
        first = Window.partitionBy(*key).orderBy(F.to_json("doc"))
        again = kept.join(twice, equal(kept, twice), "left_semi").withColumn("n", F.row_number().over(first)).where("n = 1").select("doc")
        return kept.join(twice, equal(kept, twice), "left_anti").select("doc").unionByName(again).select("doc.*")
    return kept.select("doc.*")


def hexadecimal(column: str):
    """Sixteen lower-case hex digits of a fingerprint."""
    return F.lower(F.lpad(F.hex(F.col(column)), 16, "0"))
