"""Make the package importable on executors that don't have the repository on their path."""

from __future__ import annotations

import os
import zipfile

from pyspark.sql import SparkSession

from docspark.plans.storage import shared_dir


def ship(spark: SparkSession) -> None:
    """Give the session's Python workers this package, once a session."""
    if getattr(spark.sparkContext, "_docspark_shipped", False):
        return
    root = os.path.dirname(os.path.abspath(__file__))
    shared_dir(spark)
    import tempfile

    path = os.path.join(tempfile.mkdtemp(), "docspark.zip")
    with zipfile.ZipFile(path, "w") as out:
        for folder, _, names in os.walk(root):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    out.write(full, os.path.relpath(full, os.path.dirname(root)))
    spark.sparkContext.addPyFile(path)
    spark.sparkContext._docspark_shipped = True
