"""Sends the package to the Python workers of a cluster."""

from __future__ import annotations

import io
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

from tunefold import shared

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once per application: a zip of the package in the shared folder, added to the workers' path.

    The zip stays until the session ends, since executors ask for it whenever they start, lost and replaced ones too.
    """
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    held = io.BytesIO()
    with zipfile.ZipFile(held, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    path = shared.new_path(spark, "package") + ".zip"
    shared.write_bytes(spark, path, held.getvalue())
    sc.addPyFile(path)
    _shipped.add(sc.applicationId)
