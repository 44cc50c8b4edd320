"""Gives executors this package, which Python functions in plans are looked up in."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_done: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Once for each application; executors need not have the package installed."""
    app = spark.sparkContext.applicationId
    if app in _done:
        return
    _done.add(app)
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    name = os.path.basename(package)
    path = os.path.join(tempfile.mkdtemp(prefix=f"{name}-"), f"{name}.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, files in os.walk(package):
            for f in sorted(files):
                if f.endswith(".py"):
                    at = os.path.join(folder, f)
                    z.write(at, os.path.join(name, os.path.relpath(at, package)))
    spark.sparkContext.addPyFile(path)
