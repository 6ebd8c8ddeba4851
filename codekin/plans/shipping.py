"""Sending this package to the Python workers where they could not import it otherwise."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make the package importable in Python workers, once per application.

    Nothing is to do where the package's folder is on PYTHONPATH or is the working folder, as workers
    inherit both. Else a zip of it goes to Spark's own file distribution, which hands it to every
    executor; the zip itself is only read by the driver."""
    application = spark.sparkContext.applicationId
    root = Path(__file__).resolve().parents[2]
    inherited = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if application in _sent or any(p and Path(p).resolve() == root for p in inherited):
        return
    archive = Path(tempfile.mkdtemp(prefix="codekin-")) / "codekin.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for p in sorted((root / "codekin").rglob("*.py")):
            z.write(p, p.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    _sent.add(application)
