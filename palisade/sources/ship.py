"""Sends this package to the executors, as ``--py-files`` would."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application; Spark's own file server hands the archive out."""
    app = spark.sparkContext.applicationId
    if app in _SENT:
        return
    root = Path(__file__).resolve().parents[1]
    to = Path(tempfile.mkdtemp(prefix="palisade-ship-")) / "palisade.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, Path(root.name) / p.relative_to(root))
    spark.sparkContext.addPyFile(str(to))
    _SENT.add(app)
