"""This package for the executors, wherever it was imported from."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once per context: give Python workers the package as a zip, since their path need not be the driver's."""
    context = spark.sparkContext
    if getattr(context, "_hornspark_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="hornspark-code-")) / "hornspark-code.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f.relative_to(root.parent))
    context.addPyFile(str(path))
    context._hornspark_shipped = True
