"""One row per key: latest, best, versions, upserts and replacements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def latest_per_key(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The row with the greatest ``order`` of each key, by a partial aggregate instead of a sort of whole histories."""
    rest = [c for c in df.columns if c not in keys]
    best = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r"))
    return best.select(*keys, *(F.col(f"r.{c}").alias(c) for c in rest))


def best_per_key(df: DataFrame, keys: list[str], order: list[Column], k: int = 1) -> DataFrame:
    """The first ``k`` rows of each key, with their rank as ``nth``."""
    return df.withColumn("nth", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("nth") <= k)


def document_versions(uploads: DataFrame) -> DataFrame:
    """Versions of uploads (upload, external_id, sha): a changed hash of an external_id is its next version, an
    unchanged one is deduplicated; uploads without an external_id (null or blank) are versions of the first upload with their hash.
    The two kinds go separate ways, so null isn't one large key."""
    uploads = uploads.withColumn("external_id", F.nullif(F.trim("external_id"), F.lit("")))
    named = uploads.where("external_id is not null")
    w = Window.partitionBy("external_id").orderBy("upload")
    named = named.withColumn("changed", ~F.col("sha").eqNullSafe(F.lag("sha").over(w)))
    named = named.withColumn("version", F.sum(F.col("changed").cast("int")).over(w)).withColumn("document", F.concat(F.lit("ext:"), "external_id"))
    bare = uploads.where("external_id is null")
    first = bare.groupBy("sha").agg(F.min("upload").alias("first"))
    bare = bare.join(first, "sha").select("upload", "external_id", "sha", (F.col("upload") == F.col("first")).alias("changed"), F.lit(1).cast("long").alias("version"), F.concat(F.lit("sha:"), "sha").alias("document"))
    cols = ["upload", "document", "version", (~F.col("changed")).alias("deduplicated")]
    return named.select(*cols).unionByName(bare.select(*cols))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of both by key; of each other column the newest value that isn't null."""
    rest = [c for c in old.columns if c not in (*keys, order)]
    both = old.unionByName(new)
    newest = (F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(c) for c in rest)
    return both.groupBy(*keys).agg(*newest, F.max(order).alias(order))


def replaced(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``old`` with all rows of the keys in ``new`` replaced by ``new``'s."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new)


def change_feed(stored: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """(key, change, the columns of ``new``, hash): what must happen to ``stored`` so that it becomes ``new``: insert, update, delete
    or unchanged, one row a key. Both have one row a key and the same columns beside it.

    Rows are compared by a hash of all columns in which null differs from everything but null, so that only keys and hashes
    of ``stored`` are shuffled. A deleted key's columns are null."""
    rest = [c for c in new.columns if c != key]
    digest = F.sha2(F.to_json(F.struct(*rest), {"ignoreNullFields": "false"}), 256)
    old = stored.select(F.col(key).alias("_key"), digest.alias("_was"))
    both = new.withColumn("hash", digest).withColumn("_new", F.lit(True)).join(old, F.col(key) == F.col("_key"), "full")
    change = F.when(F.col("_key").isNull(), "insert").when(F.col("_new").isNull(), "delete").when(F.col("hash") == F.col("_was"), "unchanged").otherwise("update")
    return both.select(F.coalesce(key, "_key").alias(key), change.alias("change"), *rest, "hash")


def applied(stored: DataFrame, feed: DataFrame, key: str) -> DataFrame:
    """``stored`` after a change feed: rows of deleted and updated keys go, inserted and updated ones come."""
    gone = feed.where("change in ('update', 'delete')").select(key)
    return stored.join(gone, key, "left_anti").unionByName(feed.where("change in ('insert', 'update')").select(*stored.columns))


def pending_work(wanted: DataFrame, jobs: DataFrame, results: DataFrame) -> DataFrame:
    """(unit, specialist, input_version) of the work that must be queued.

    ``wanted`` has unit, specialist, input_version; ``jobs`` unit, specialist, created, job, status; ``results`` unit, specialist,
    created, result, input_version. Work waits or is done if the latest job of its unit and specialist is queued, pending, processing or
    succeeded, or the latest result was made from the same input; a failed job over a new input is queued again."""
    keys = ["unit", "specialist"]
    job = latest_per_key(jobs.select(*keys, "created", "job", "status"), keys, ["created", "job"]).select(*keys, "status")
    made = latest_per_key(results.select(*keys, "created", "result", F.col("input_version").alias("made_from")), keys, ["created", "result"]).select(*keys, "made_from")
    df = wanted.join(job, keys, "left").join(made, keys, "left")
    busy = F.coalesce(F.col("status").isin("queued", "pending", "processing", "succeeded"), F.lit(False))
    done = F.coalesce(F.col("made_from") == F.col("input_version"), F.lit(False))
    return df.where(~busy & ~done).select(*keys, "input_version")


def document_overview(documents: DataFrame, units: DataFrame, rotations: DataFrame, jobs: DataFrame) -> DataFrame:
    """One row a document: scans, units, newest, latest_kind, needs_review, rotation, reversed_order, job_status, job_error.

    ``documents`` has document; ``units`` document, scan, unit, kind, created, unsure; ``rotations`` document, created, result, rotation,
    reversed_order (of the OCR results); ``jobs`` document, created, job, status, error. Of results and jobs the latest counts. Documents
    without any of them stay, with zeros, false and nulls."""
    count = units.groupBy("document").agg(
        F.count_distinct("scan").alias("scans"),
        F.count(F.lit(1)).alias("units"),
        F.max("created").alias("newest"),
        F.max_by("kind", F.struct("created", "unit")).alias("latest_kind"),
        F.bool_or("unsure").alias("needs_review"),
    )
    turned = latest_per_key(rotations.select("document", "created", "result", "rotation", "reversed_order"), ["document"], ["created", "result"]).select("document", "rotation", "reversed_order")
    last = latest_per_key(jobs.select("document", "created", "job", "status", "error"), ["document"], ["created", "job"]).select("document", F.col("status").alias("job_status"), F.col("error").alias("job_error"))
    df = documents.select("document").distinct()
    for side in (count, turned, last):
        df = df.join(side, "document", "left")
    return df.na.fill(0, ["scans", "units"]).na.fill(0, ["rotation"]).na.fill(False, ["needs_review", "reversed_order"])
