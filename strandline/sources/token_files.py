"""A data source of packed token files: flat little-endian identifiers (.bin) with 64-bit offsets
(.idx), as training code reads them by memory map. ``spark.read.format("packed_tokens")`` gives
row_id and ids; its partitions are stretches of rows, so no task reads more than it returns."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


class Stretch(InputPartition):
    def __init__(self, first: int, last: int):
        self.first, self.last = first, last


class PackedReader(DataSourceReader):
    def __init__(self, options: dict):
        self.prefix = options["path"].removeprefix("file://")
        self.rows = int(options.get("rowsPerPartition", 100_000))
        with open(f"{self.prefix}.json") as f:
            self.meta = json.load(f)
        if self.meta["dtype"] not in ("uint16", "uint32"):
            raise ValueError(f"{self.prefix} has tokens of type {self.meta['dtype']}")

    def partitions(self) -> list[InputPartition]:
        n = self.meta["n_sequences"]
        return [Stretch(a, min(n, a + self.rows)) for a in range(0, n, self.rows)] or [Stretch(0, 0)]

    def read(self, partition: Stretch):
        offsets = np.fromfile(f"{self.prefix}.idx", "<u8", partition.last - partition.first + 1, offset=8 * partition.first).astype(np.int64)
        width = 2 if self.meta["dtype"] == "uint16" else 4
        ids = np.fromfile(f"{self.prefix}.bin", f"<u{width}", int(offsets[-1] - offsets[0]) if len(offsets) else 0, offset=width * int(offsets[0]) if len(offsets) else 0)
        for k in range(len(offsets) - 1):
            a, b = int(offsets[k] - offsets[0]), int(offsets[k + 1] - offsets[0])
            yield partition.first + k, ids[a:b].tolist()


class PackedTokens(DataSource):
    @classmethod
    def name(cls) -> str:
        return "packed_tokens"

    def schema(self) -> str:
        return "row_id bigint, ids array<bigint>"

    def reader(self, schema) -> DataSourceReader:
        return PackedReader(self.options)


def write_packed(rows: list[list[int]], prefix: str, dtype: str = "uint16") -> None:
    """Packs small corpora (tests, hand-over to training code on one machine)."""
    width = 2 if dtype == "uint16" else 4
    lengths = np.array([len(r) for r in rows], np.int64)
    flat = np.array([x for r in rows for x in r], np.int64)
    if (lengths == 0).any() or (len(flat) and (flat.min() < 0 or flat.max() >= 1 << (8 * width))):
        raise ValueError("an empty row or an identifier out of range")
    flat.astype(f"<u{width}").tofile(f"{prefix}.bin")
    np.concatenate([[0], np.cumsum(lengths)]).astype("<u8").tofile(f"{prefix}.idx")
    with open(f"{prefix}.json", "w") as f:
        json.dump({"n_sequences": len(rows), "n_tokens": int(lengths.sum()), "dtype": dtype}, f)
