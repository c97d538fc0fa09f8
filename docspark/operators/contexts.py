"""Contexts: entities that recur in the same documents, and the units that belong to them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def document_sets(mentions: DataFrame, least: int = 2) -> DataFrame:
    """Entities in at least ``least`` documents with a fingerprint of their set of documents: count, sum and xor of
    hashes merge in partial aggregates, so a hot entity never gathers its set in one place."""
    one = mentions.select("entity", "kind", "document").distinct()
    h = F.xxhash64("document")
    agg = one.groupBy("entity", "kind").agg(F.count(F.lit(1)).alias("n"), F.sum(h.cast("decimal(38,0)")).alias("s"), F.bit_xor(h).alias("x"))
    return agg.where(F.col("n") >= least)


def context_groups(sets: DataFrame) -> DataFrame:
    """In each set of documents the first organization takes all addresses and places; all others stand alone."""
    w = Window.partitionBy("n", "s", "x").orderBy(F.when(F.col("kind") == "organization", 0).otherwise(1), F.lower("entity"), "kind")
    df = sets.withColumn("nth", F.row_number().over(w)).withColumns({"head": F.first("entity").over(w), "head_kind": F.first("kind").over(w)})
    tied = (F.col("head_kind") == "organization") & F.col("kind").isin("address", "place")
    return df.select("entity", "kind", "n", F.when(tied, F.col("head")).otherwise(F.col("entity")).alias("context"))


def memberships(units: DataFrame, matches: DataFrame) -> DataFrame:
    """Every unit of a document joins each context that one of its units matched: directly, or by the document with at
    most 0.8 of confidence. Evidence is aggregated before the join."""
    by_doc = matches.groupBy("document", "context").agg(F.max("confidence").alias("most"))
    direct = matches.groupBy("unit", "context").agg(F.max("confidence").alias("own"))
    df = units.select("unit", "document").join(by_doc, "document").join(direct, ["unit", "context"], "left")
    return df.select("unit", "context", F.when(F.col("own").isNotNull(), "direct").otherwise("document_scope").alias("role"), F.coalesce("own", F.least(F.col("most"), F.lit(0.8))).alias("confidence"))
