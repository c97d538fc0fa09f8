"""Where intermediate results go: the shared folder the session names, never an executor's own disk."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder all executors share: ``spark.checkpoint.dir``; only where it is unset (tests), a folder of our own."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        named = getattr(spark, "_docspark_dir", None)
        if not named:
            named = spark._docspark_dir = tempfile.mkdtemp(prefix="docspark-")
            spark.sparkContext.setCheckpointDir(named)
    return named.rstrip("/")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back: lineage is cut, columns stay prunable."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives lost executors, for loops."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, limit: int) -> bool:
    """True if ``df`` has at most ``limit`` rows (reads no more than ``limit + 1``)."""
    return df.limit(limit + 1).count() <= limit
