"""This package on the executors."""

from __future__ import annotations

import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the package to the executors' Python, once for each application, whatever their search path.

    Modules are then imported there once for each worker, with their caches, instead of being sent with every task.
    """
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = Path(__file__).resolve().parent
        where = Path(tempfile.mkdtemp(prefix="popspark-")) / "popspark.zip"
        with zipfile.ZipFile(where, "w") as z:
            for f in sorted(root.rglob("*.py")):
                z.write(f, f.relative_to(root.parent))
        context.addPyFile(str(where))
        _SHIPPED.add(context.applicationId)
