"""Sends this package to the executors, so that Python functions find it without an installation."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import threading
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()
_sending = threading.Lock()


def ship(spark: SparkSession) -> None:
    """Adds a zip of the package to the application's Python files, once an application; threads that
    come meanwhile wait for it."""
    context = spark.sparkContext
    with _sending:
        if context.applicationId not in _sent:
            context.addPyFile(_package())
            _sent.add(context.applicationId)


def _package() -> str:
    root = os.path.dirname(os.path.abspath(__file__))
    folder = tempfile.mkdtemp(prefix="strandline-")  # executors fetch the file from here, when they need it
    atexit.register(shutil.rmtree, folder, True)
    path = os.path.join(folder, "strandline.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for where, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(where, name)
                    z.write(full, os.path.join("strandline", os.path.relpath(full, root)))
    return path
