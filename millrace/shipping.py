"""Puts this package where the executors' Python workers can import it."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: dict[str, str] = {}


def ship(spark: SparkSession) -> None:
    """Once an application: a zip of the package's modules, carried by Spark's own file server."""
    sc = spark.sparkContext
    if sc.applicationId not in _shipped:
        top = Path(__file__).resolve().parent
        path = _shipped[sc.applicationId] = f"{tempfile.mkdtemp(prefix='millrace-code-')}/{top.name}.zip"
        with zipfile.ZipFile(path, "w") as z:
            for f in sorted(top.rglob("*.py")):
                z.write(f, f.relative_to(top.parent))
        sc.addPyFile(path)
