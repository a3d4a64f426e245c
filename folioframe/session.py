"""Making the package importable by a session's Python workers."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

ROOT = Path(__file__).resolve().parent.parent
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package's source to the executors, once per application, unless their PYTHONPATH already has it."""
    app = spark.sparkContext.applicationId
    if app in _shipped or str(ROOT) in [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]:
        return
    _shipped.add(app)
    archive = os.path.join(tempfile.mkdtemp(), f"{__package__}.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((ROOT / __package__).rglob("*.py")):
            z.write(p, p.relative_to(ROOT))
    spark.sparkContext.addPyFile(archive)
