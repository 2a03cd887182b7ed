"""Make the package importable in Spark's Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to the executors, once per Spark context, unless ``PYTHONPATH`` already has it."""
    if str(ROOT.parent) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return spark
    sc = spark.sparkContext
    if not any(str(f).endswith("tidebook.zip") for f in sc.listFiles):
        path = Path(tempfile.mkdtemp(prefix="tidebook-")) / "tidebook.zip"
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(ROOT.rglob("*.py")):
                z.write(p, p.relative_to(ROOT.parent))
        sc.addPyFile(str(path))
    return spark
