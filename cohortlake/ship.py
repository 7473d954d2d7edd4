"""Sends the package to the executors, which need not have it installed."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession

_sent: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Adds the package to the Python path of the session's executors, once for each application."""
    sc = spark.sparkContext
    if sc.applicationId in _sent:
        return
    top = os.path.dirname(os.path.abspath(__file__))
    target = os.path.join(tempfile.mkdtemp(prefix="ship-"), "cohortlake.zip")
    with zipfile.ZipFile(target, "w") as z:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.join("cohortlake", os.path.relpath(path, top)))
    sc.addPyFile(target)
    _sent.add(sc.applicationId)
