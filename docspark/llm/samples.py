"""Bounded samples of labelled rows, for fitting classifiers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from docspark.plans.storage import written


def held_out(doc_id: str | Column = "doc_id") -> Column:
    """True for the rows that no classifier learns from: crc32 of the doc_id as text, mod 4, is 2."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % 4 == 2, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, rows: int, characters: int) -> DataFrame:
    """(doc_id, text, label) of rows of each label that may be learned from, in order of a hash of doc_id.

    ``labels`` has doc_id and label; ``docs`` has doc_id and text. Each label gives at most ``rows`` rows and, after its
    first row, ``characters`` code points in all; texts stay whole. These two bound what a fit sees. Of repeated
    doc_ids one row counts; null ids, labels and texts don't.
    """
    fit = labels.where(F.col("doc_id").isNotNull() & F.col("label").isNotNull() & ~held_out()).select("doc_id", "label").distinct()
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    some = fit.withColumn("nth", F.row_number().over(Window.partitionBy("label").orderBy(*order))).where(F.col("nth") <= rows)
    # written, its size tells Spark whether to broadcast it
    ids = written(some.groupBy("doc_id").agg(F.min("label").alias("label")), "sample-ids")
    found = docs.select("doc_id", "text").where("text is not null").join(ids, "doc_id")
    found = found.groupBy("doc_id").agg(F.min("label").alias("label"), F.min("text").alias("text"))
    before = F.sum(F.length("text")).over(Window.partitionBy("label").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    size = F.length("text") + F.coalesce(before, F.lit(0))
    return found.withColumn("room", before.isNull() | (size <= characters)).where("room").select("doc_id", "text", "label")
