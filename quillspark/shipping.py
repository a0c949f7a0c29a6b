"""Getting this package to executors that don't have it on their path."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parents[1]


def ship(spark: SparkSession) -> None:
    """Once a session; functions that run in tasks and need modules of this package call it first."""
    sc = spark.sparkContext
    if str(ROOT) in os.environ.get("PYTHONPATH", "").split(os.pathsep) or getattr(sc, "_quillspark_shipped", False):
        return
    target = Path(tempfile.mkdtemp()) / "quillspark_pkg.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in (ROOT / "quillspark").rglob("*.py"):
            z.write(p, p.relative_to(ROOT))
    sc.addPyFile(str(target))
    sc._quillspark_shipped = True
