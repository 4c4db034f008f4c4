"""The package for Python workers that can't import it themselves."""

from __future__ import annotations

import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent.parent
_shipped: set[str] = set()


def importable() -> bool:
    """Whether workers started from here find the package by their path or working folder."""
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p] + [os.getcwd()]
    return any(os.path.realpath(p) == str(ROOT) for p in paths)


def ship_package(spark: SparkSession) -> None:
    """Send the package to the executors, once for each application."""
    app = spark.sparkContext.applicationId
    if app in _shipped or importable() or not (ROOT / "vellumflow").is_dir():
        return
    _shipped.add(app)
    made = shutil.make_archive(os.path.join(tempfile.mkdtemp(), "vellumflow"), "zip", ROOT, "vellumflow")
    spark.sparkContext.addPyFile(made)
