"""Getting this package to the executors, which don't share the driver's sys.path."""

from __future__ import annotations

import zipfile
from pathlib import Path
from tempfile import mkdtemp

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """The package as a zip file for the session's Python workers, once for each application."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(mkdtemp(prefix="gazelark-")) / "gazelark.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, f"gazelark/{file.relative_to(root)}")
    context.addPyFile(str(target))
    _shipped.add(context.applicationId)
