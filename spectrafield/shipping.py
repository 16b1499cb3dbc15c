"""Make this package importable in Python workers on every executor."""

from __future__ import annotations

import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Send the package's source to the executors, once a session."""
    context = spark.sparkContext
    if getattr(context, "_spectrafield_shipped", False):
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="package-")
    archive = shutil.make_archive(f"{folder}/spectrafield", "zip", package.parent, package.name)
    context.addPyFile(archive)
    context._spectrafield_shipped = True
