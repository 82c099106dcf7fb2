"""Written tables in the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession


@lru_cache(maxsize=1)
def _local() -> str:
    folder = tempfile.mkdtemp(prefix="strandline-")
    atexit.register(shutil.rmtree, folder, True)
    return f"file://{folder}"


def scratch(spark: SparkSession, label: str) -> str:
    """A fresh path under ``spark.checkpoint.dir``; where that is unset (tests), under a folder of our
    own."""
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    return f"{(named or _local()).rstrip('/')}/strandline/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """df written to the shared folder and read back: for what several branches of a plan read and is
    much smaller than its source. Lineage ends here."""
    path = scratch(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
