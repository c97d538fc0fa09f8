"""Jobs and uploads as they arrive: Structured Streaming, with batch forms of the same rules."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.operators.latest import latest_per_key
from docspark.plans.storage import shared_dir
from docspark.sources.archive import replace_units
from docspark.sources.versioned import merge_into


#: Seconds that a job may keep a status, by its kind, and what is said of jobs that keep it longer.
LIMITS = {
    ("ingest", "queued"): 86_400,
    ("ingest", "running"): 21_600,
    ("specialist", "queued"): 86_400,
    ("specialist", "pending"): 86_400,
    ("specialist", "processing"): 10_800,
}
REASONS = {"queued": "queued too long", "pending": "queued too long", "running": "running too long", "processing": "running too long"}


def _map(pairs: dict) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def stale(jobs: DataFrame, as_of: Column) -> DataFrame:
    """Jobs (kind, job, event, ts, status) whose latest status has lasted longer than their kind allows, with the reason."""
    newest = latest_per_key(jobs.select("kind", "job", "event", "ts", "status"), ["kind", "job"], ["ts", "event"])
    limit = _map({f"{kind} {status}": n for (kind, status), n in LIMITS.items()})[F.concat_ws(" ", "kind", "status")]
    old = F.col("ts") + F.make_interval(secs=limit) < as_of
    return newest.where(limit.isNotNull() & old).select("kind", "job", "event", "ts", "status", _map(REASONS)[F.col("status")].alias("reason"))


def drained(stream: DataFrame, name: str) -> DataFrame:
    """What a stream gives for all that its sources hold now, by way of a table in the shared folder."""
    spark = stream.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    query = stream.writeStream.format("parquet").option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start(path)
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def deduplicated(uploads: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream of uploads (sha, arrived): each hash once within the watermark; later repeats of old hashes pass again."""
    return uploads.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(["sha"])


def status_counts(jobs: DataFrame, window: str = "1 hour", delay: str = "1 hour") -> DataFrame:
    """A stream of jobs (ts, status): how many events of each status in each window, late ones up to the watermark."""
    return jobs.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "status").agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "status", "n")


def merged_status(current: DataFrame | None, jobs: DataFrame) -> DataFrame:
    """The latest status of each job after some more rows (job, event, ts, status): job, status, ts, event, failures,
    last_failure. One partial aggregate of the new rows is merged with what was known; the order of batches doesn't count."""
    order = F.struct("ts", "event")
    failed = F.col("status") == "failed"
    new = jobs.groupBy("job").agg(F.max(F.struct("ts", "event", "status")).alias("last"), F.count_if(failed).alias("failures"), F.max(F.when(failed, order)).alias("failure"))
    if current is not None:
        old = current.select("job", F.struct("ts", "event", "status").alias("last"), "failures", F.when(F.col("last_failure").isNotNull(), F.struct(F.col("failed_at").alias("ts"), F.col("last_failure").alias("event"))).alias("failure"))
        new = old.unionByName(new).groupBy("job").agg(F.max("last").alias("last"), F.sum("failures").alias("failures"), F.max("failure").alias("failure"))
    return new.select("job", "last.status", "last.ts", "last.event", "failures", F.col("failure.event").alias("last_failure"), F.col("failure.ts").alias("failed_at"))


def keep_latest_status(jobs: DataFrame, path: str, checkpoint: str, buckets: int = 64):
    """A stream of jobs kept as a versioned table of latest statuses below ``path`` (see ``latest_status``). Returns the query.

    A batch is merged into the buckets that its jobs fall into; the others aren't touched. A batch that is run again finds itself
    in the manifest and is left out. Rows are kept for each stream (a checkpoint) and job, so that a stream which begins
    anew over the same events neither loses what the one before it knew nor counts failures twice."""

    def step(batch: DataFrame, number: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")

        def merge(old: DataFrame | None, new: DataFrame) -> DataFrame:
            if old is None:
                return merged_status(None, new).withColumn("stream", F.lit(stream))
            mine = merged_status(old.where(F.col("stream") == stream).drop("stream"), new).withColumn("stream", F.lit(stream))
            return old.where(F.col("stream") != stream).unionByName(mine)

        merge_into(batch, path, "job", merge, buckets, applied=(stream, number))

    return jobs.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def latest_status(table: DataFrame) -> DataFrame:
    """(job, status, ts, event, failures, last_failure, failed_at) of a table that ``keep_latest_status`` keeps: of several streams the
    latest event and the most failures count."""
    last, failure = F.max(F.struct("ts", "event", "status")).alias("last"), F.max(F.when(F.col("last_failure").isNotNull(), F.struct("failed_at", "last_failure"))).alias("failure")
    df = table.groupBy("job").agg(last, F.max("failures").alias("failures"), failure)
    return df.select("job", "last.status", "last.ts", "last.event", "failures", "failure.last_failure", "failure.failed_at")


def incremental_projection(results: DataFrame, project, path: str, checkpoint: str, key: str = "unit"):
    """A stream of results: each batch's units are projected by ``project`` and replace those units' rows in the versioned table
    below ``path``; of several results of a unit in a batch the latest (created, then result_id) counts. Returns the query."""

    def step(batch: DataFrame, number: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        replace_units(project(latest_per_key(batch, [key], ["created", "result_id"])), path, key, batch.select(key).distinct(), applied=(stream, number))

    return results.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
