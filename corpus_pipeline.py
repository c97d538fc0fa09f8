"""A training corpus from ``documents``: each stage works on all that the one before kept.

Stages are functions of (spark, docs, sf_dir); each one's rows are written as Parquet and read again as the next one's
``docs``. The last returns packed pieces, all others the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docspark.llm.language import languages
from docspark.llm.ngram_join import ngram_jaccard_join
from docspark.llm.packing import concatenate_and_cut
from docspark.llm.pii import personal_data, redacted
from docspark.llm.quality import quality_scores
from docspark.plans.storage import cut, small, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
_REST = ("text", "lang", "source", "n_chars")
#: Texts below these probabilities are rejected.
QUALITY, LANGUAGE = 0.7, 0.3
#: Ids are broadcast up to this many, joined by a shuffle beyond.
BROADCAST_IDS = 250_000


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that the quality classifier, fitted on ``labels``, scores below QUALITY."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_scores(docs, labels, threshold=QUALITY, keep=_REST).where("predicted = 1").select(COLUMNS)


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents without a language: no letter, or less than LANGUAGE for the likeliest one."""
    found = languages(docs, docs, keep=_REST)
    return found.where((F.col("lang_pred") != "und") & (F.col("score") >= LANGUAGE)).select(COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by 0.8 of their five-word shingles, directly or through others, the smallest doc_id stays.

    Rows that share a doc_id are one document; rows without one stay.
    """
    found = written(ngram_jaccard_join(docs, k=5, num=80, den=100), "pipeline-links")
    gone = cut(found.where("doc_id <> component_id").select("doc_id").distinct())
    again = cut(found.where("doc_id is not null").groupBy("doc_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc_id"))
    side = lambda ids: F.broadcast(ids) if small(ids, BROADCAST_IDS) else ids
    stay = docs.join(side(gone), "doc_id", "left_anti")
    once = stay.join(side(again), "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return stay.join(side(again), "doc_id", "left_anti").unionByName(once).select(COLUMNS)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replace every span of personal data by its kind in angle brackets."""
    found = personal_data(docs, [c for c in COLUMNS if c != "n_chars"])
    return found.withColumn("text", redacted()).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents in windows of 4096."""
    import public_tokenizers

    pieces = concatenate_and_cut(docs, str(public_tokenizers.path("word_bpe_49k.json")))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("pii", pii), ("packing", packing)]

#: Trained classifiers and a tokenizer's ids can't be said in SQL; tests/llm hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
