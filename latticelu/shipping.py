"""Make this package importable in the Python workers of a session's executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_ROOT = Path(__file__).resolve().parent


def ship(spark: SparkSession) -> None:
    """Send the package's sources to the executors, once for each application."""
    context = spark.sparkContext
    if getattr(context, "_latticelu_shipped", False):
        return
    target = Path(tempfile.mkdtemp(prefix="ship-")) / "latticelu.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(_ROOT.rglob("*.py")):
            z.write(p, p.relative_to(_ROOT.parent))
    context.addPyFile(str(target))
    context._latticelu_shipped = True
