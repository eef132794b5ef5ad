"""Getting this package to the Python workers."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> SparkSession:
    """Send the package to executors that don't have it installed: once an application, through Spark's own file server."""
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
        with tempfile.TemporaryDirectory() as staging:
            shutil.copytree(os.path.join(root, "tessera"), os.path.join(staging, "package", "tessera"), ignore=shutil.ignore_patterns("__pycache__"))
            kept = tempfile.mkdtemp()  # the driver serves the archive from here to its end
            atexit.register(shutil.rmtree, kept, True)
            archive = shutil.make_archive(os.path.join(kept, "tessera"), "zip", os.path.join(staging, "package"))
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)
    return spark
