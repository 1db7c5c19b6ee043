"""The package on Python workers that don't have it installed."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

_SENT: set[str] = set()


def ready(spark: SparkSession) -> None:
    """Sends the package to the workers of this application, once. Spark serves the archive from
    the driver, so the folder it is made in need not be shared."""
    context = spark.sparkContext
    if context.applicationId in _SENT:
        return
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.realpath(__file__))))
    folder = os.path.realpath(tempfile.mkdtemp(prefix="daybook-package-"))
    context.addPyFile(shutil.make_archive(f"{folder}/daybook", "zip", root, "daybook"))
    _SENT.add(context.applicationId)
