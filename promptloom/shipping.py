"""Python workers need this package: ship it once per Spark context."""

from __future__ import annotations

import atexit
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package's sources to all executors, present and future."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent
    folder = tempfile.mkdtemp(prefix="promptloom-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    stage = Path(folder, "stage")
    shutil.copytree(package, stage / package.name, ignore=shutil.ignore_patterns("__pycache__"))
    context.addPyFile(shutil.make_archive(str(Path(folder, package.name)), "zip", stage))
    _shipped.add(context.applicationId)
