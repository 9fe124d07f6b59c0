"""Hands the library to Python workers that cannot import it by themselves."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Adds the library's source to the session's files once."""
    context = spark.sparkContext
    if context.applicationId not in _SENT:
        root = Path(__file__).resolve().parents[1]
        path = Path(tempfile.mkdtemp(prefix="rolescope-source-"), f"{root.name}.zip")
        with zipfile.ZipFile(path, "w") as archive:
            for file in sorted(root.rglob("*.py")):
                archive.write(file, file.relative_to(root.parent))
        context.addPyFile(str(path))
        _SENT.add(context.applicationId)
    return spark
