"""The package's own code on the executors: Python workers import it, wherever the driver has it from."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends the package as a zip file, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = os.path.dirname(os.path.abspath(__file__))
    if not os.path.isdir(root):  # the package is read from a zip file that was sent already
        return
    folder = os.path.realpath(tempfile.mkdtemp(prefix="vectide-code-"))
    path = os.path.join(folder, "vectide.zip")
    with zipfile.ZipFile(path, "w") as out:
        for top, _, names in os.walk(root):
            for name in sorted(names):
                if name.endswith(".py"):
                    full = os.path.join(top, name)
                    out.write(full, os.path.join("vectide", os.path.relpath(full, root)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)
