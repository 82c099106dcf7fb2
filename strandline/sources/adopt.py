"""Files of a source: adopted where they are there, refused where they are large and unconfirmed.
There is no transfer here: a ``fetch`` function is given by the caller."""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class ConfirmationNeeded(RuntimeError):
    """A large source was asked for without confirmation."""


def digest(path: str, chunk: int = 1 << 20) -> str:
    h = hashlib.sha256()
    with open(path, "rb") as f:
        while block := f.read(chunk):
            h.update(block)
    return h.hexdigest()


def adopt(path: str, name: str, large: bool = False, confirmed: bool = False, fetch: Callable[[str], None] | None = None) -> dict:
    """The record of a source's file. A file that is there is adopted; its digest is taken anew only
    where the side file's byte count differs. Else it is fetched to a part file and renamed."""
    side = f"{path}.record.json"
    if not os.path.exists(path):
        if large and not confirmed:
            raise ConfirmationNeeded(f"{name} is large; confirm the transfer")
        if fetch is None:
            raise FileNotFoundError(path)
        fetch(f"{path}.part")
        os.replace(f"{path}.part", path)
    size = os.path.getsize(path)
    if os.path.exists(side):
        with open(side) as f:
            record = json.load(f)
        if record.get("bytes") == size:
            return record
    record = {"name": name, "bytes": size, "sha256": digest(path), "taken_utc": datetime.now(UTC).isoformat()}
    with open(f"{side}.part", "w") as f:
        json.dump(record, f)
    os.replace(f"{side}.part", side)
    return record


def archive(path: str, stamp: str) -> str | None:
    """Renames a log to a stamped name that is not taken; returns it, or None without a log."""
    if not os.path.exists(path):
        return None
    stem, ext = os.path.splitext(path)
    k = 0
    while os.path.exists(to := f"{stem}.{stamp}{f'.{k}' if k else ''}{ext}"):
        k += 1
    os.rename(path, to)
    return to


def manifest(spark: SparkSession, argv: list[str], extra: dict | None = None) -> dict:
    """What a run was: arguments, versions, time."""
    return {"argv": list(argv), "spark": spark.version, "started_utc": datetime.now(UTC).isoformat(), **(extra or {})}


def file_digests(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, bytes, sha256 of files that fit a row (under 2 GB), read by the executors."""
    df = spark.read.format("binaryFile").load(paths)
    return df.select(F.element_at(F.split("path", "/"), -1).alias("path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))
