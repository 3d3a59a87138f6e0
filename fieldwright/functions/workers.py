"""Python workers on the executors need this package."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send the package to the executors' Python workers, once for an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[2]
    archive = Path(tempfile.mkdtemp(prefix="fieldwright-code-")) / "fieldwright_code.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for f in sorted((root / "fieldwright").rglob("*.py")):
            out.write(f, f.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    _shipped.add(app)
