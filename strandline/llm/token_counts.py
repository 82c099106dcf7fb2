"""Token counts from flat, unindexed token files.

A token file is nothing but identifiers (little-endian unsigned 16- or 32-bit), documents ended by an
end-of-document identifier. ``count_tokens`` cuts the files in blocks that tasks read independently;
in a block one vectorised comparison finds the separators, and a block's result is only their
offsets. A prefix scan over the blocks of a file (count of separators and last separator so far)
stitches the documents that cross block boundaries and numbers them. ``write_tokens`` makes such files
from a text column, with a manifest of the documents in file order.

A block holds ``block_tokens`` identifiers, so a task's memory does not depend on a file's or a
document's length. Files live in the shared folder; each attempt of a task writes files of its own
and the manifest, itself a written table, names those that count.

Defined results: null text counts as empty and has 0 tokens; tokens after the last separator of a
file are reported by ``count_tokens`` as an unterminated document; empty files have no documents;
repeated rows are counted each; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import Sink, arrow_map, filled, fresh_path, materialise, open_uri, partitions, strings

#: A file is closed after so many bytes.
FILE_BYTES = 256 << 20


@lru_cache(maxsize=2)
def ranks_encoding(rank_file: str, pattern: str):
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def write_tokens(docs: DataFrame, rank_file: str, pattern: str, eod: int, id_col: str = "doc_id", text_col: str = "text", dtype: str = "<u2") -> DataFrame:
    """Writes the texts' tokens as flat files; returns the manifest: path, ordinal (from 0), id_col."""
    folder, kind = fresh_path(docs.sparkSession, "tokens"), docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding, end = ranks_encoding(rank_file, pattern), np.array([eod], dtype).tobytes()
        sink, ordinal = None, 0
        for batch in batches:
            paths, ordinals = [], []
            for text in strings(batch.column(1)):
                if sink is None or sink.size >= FILE_BYTES:
                    if sink:
                        sink.close()
                    sink, ordinal = Sink(folder, ".bin"), 0
                ids = encoding.encode_to_numpy(text)
                sink.write(ids.astype(dtype).tobytes() + end)
                paths.append(sink.uri)
                ordinals.append(ordinal)
                ordinal += 1
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(ordinals, pa.int64()), batch.column(0)], ["path", "ordinal", "__id"])
        if sink:
            sink.close()

    manifest = arrow_map(docs.select(docs[id_col], filled(text_col).alias("t")), run, f"path string, ordinal long, __id {kind}")
    return materialise(manifest.withColumnRenamed("__id", id_col), "token-manifest")


def count_tokens(files: DataFrame, eod: int, dtype: str = "<u2", block_tokens: int = 1 << 20) -> DataFrame:
    """files: a column path of flat token files. Returns path, ordinal, begin (token offset in the
    file), n_tokens (without the separator), terminated (false for what follows the last separator)."""
    width = np.dtype(dtype).itemsize

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            paths = batch.column(0).to_pylist()
            found = []
            for p in paths:
                fs, path = open_uri(p)
                size = fs.get_file_info(path).size
                if size % width:
                    raise ValueError(f"{p} is not a whole number of {width}-byte tokens")
                found.append(size // width)
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(found, pa.int64())], ["path", "total"])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for p, total, block in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                fs, path = open_uri(p)
                first = block * block_tokens
                with fs.open_input_file(path) as f:
                    f.seek(first * width)
                    ids = np.frombuffer(f.read(min(block_tokens, total - first) * width), dtype)
                ends = np.flatnonzero(ids == eod) + first
                yield pa.RecordBatch.from_arrays(
                    [pa.array([p]), pa.array([total], pa.int64()), pa.array([block], pa.int64()), pa.array([len(ends)], pa.int64()), pa.array([int(ends[-1]) if len(ends) else None], pa.int64()), pa.array([ends], pa.list_(pa.int64()))],
                    ["path", "total", "block", "n", "last", "ends"],
                )

    sized = arrow_map(files.select("path").distinct(), sizes, "path string, total long")
    wanted = (
        sized.where("total > 0")
        .withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("total") - 1) / block_tokens))))
        .select("path", "total", "block")
        .repartition(partitions(files.sparkSession), "path", "block")
    )
    blocks = arrow_map(wanted, scan, "path string, total long, block long, n long, last long, ends array<long>")
    blocks = materialise(blocks, "token-blocks")
    before = Window.partitionBy("path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("path", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"), F.coalesce(F.last("last", ignorenulls=True).over(before), F.lit(-1).cast("long")).alias("carry"))
    ended = (
        blocks.where("n > 0").join(carried, ["path", "block"])
        .select("path", "base", "carry", "ends", F.posexplode("ends").alias("k", "end"))
        .select("path", (F.col("base") + F.col("k")).cast("long").alias("ordinal"), (F.when(F.col("k") == 0, F.col("carry")).otherwise(F.get("ends", F.col("k") - 1)) + 1).alias("begin"), "end", F.lit(True).alias("terminated"))
    )
    rest = blocks.groupBy("path").agg(F.sum("n").alias("ordinal"), (F.coalesce(F.max("last"), F.lit(-1).cast("long")) + 1).alias("begin"), F.max("total").alias("end")).where("begin < end").withColumn("terminated", F.lit(False))
    both = ended.unionByName(rest)
    return both.select("path", "ordinal", "begin", (F.col("end") - F.col("begin")).alias("n_tokens"), "terminated")


def token_counts(docs: DataFrame, rank_file: str, pattern: str, eod: int, id_col: str = "doc_id", text_col: str = "text", dtype: str = "<u2", block_tokens: int = 1 << 20) -> DataFrame:
    """id_col and n_tokens, counted in the flat files that the texts were written to."""
    manifest = write_tokens(docs, rank_file, pattern, eod, id_col, text_col, dtype)
    counts = count_tokens(manifest.select("path"), eod, dtype, block_tokens)
    return manifest.join(counts, ["path", "ordinal"]).select(id_col, "n_tokens")
