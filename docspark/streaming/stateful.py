"""Streams with a state and timers for each key: jobs that go stale without a further event, versions in order of arrival."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from docspark.streaming.jobs import LIMITS, REASONS

_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
STALE = "kind string, job long, event long, at long, status string, reason string"
VERSIONS = "document string, upload long, version long, deduplicated boolean"


def use_timers(spark: SparkSession) -> None:
    """Streams with timers keep their state in RocksDB."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=[c.split()[0] for c in schema.split(", ")])


class _Stale(StatefulProcessor):
    """A job's newest event, and a timer for the moment its status has lasted too long."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long, event long, status string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        last = before = self.last.get() if self.last.exists() else None
        for frame in rows:
            for r in frame.itertuples():
                new = (int(r.at), int(r.event), r.status)
                if last is None or new[:2] > tuple(last[:2]):
                    last = new
        if last is not None and last != before:
            self.last.update(last)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            limit = LIMITS.get((key[0], last[2]))
            if limit is not None:
                self.handle.registerTimer((last[0] + limit * 1_000_000) // 1000 + 1)
        yield _frame([], STALE)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        at, event, status = self.last.get()
        if (key[0], status) in LIMITS:
            self.last.update((at, event, "failed"))
            yield _frame([(key[0], int(key[1]), event, at, status, REASONS[status])], STALE)
        else:
            yield _frame([], STALE)

    def close(self) -> None:
        pass


def stale_jobs(jobs: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream of job events (kind, job, event, ts, status): each job whose status lasts longer than its kind allows, once,
    as soon as the watermark passes that moment, whether or not the job is heard of again.

    The newest event of a job counts, by ts, then event; later events of a stale job count as those of any other. Limits are
    ``jobs.LIMITS``. Needs ``use_timers``."""
    ts = F.col("ts").cast("timestamp")
    marked = jobs.select("kind", "job", "event", ts.alias("ts"), F.unix_micros(ts).alias("at"), "status").withWatermark("ts", delay)
    found = marked.groupBy("kind", "job").transformWithStateInPandas(_Stale(), STALE, "append", "eventTime")
    return found.select("kind", "job", "event", F.timestamp_micros("at").cast(jobs.schema["ts"].dataType).alias("ts"), "status", "reason")


class _Versions(StatefulProcessor):
    """Uploads of a document that wait for the watermark, and the last version."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, upload long, sha string")
        self.last = handle.getValueState("last", "sha string, version long")

    @staticmethod
    def _due(at: int) -> int:
        return -(-at // 1000)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = None
        for frame in rows:
            some = [(int(r.at), int(r.upload), r.sha) for r in frame.itertuples()]
            if some:
                self.waiting.appendList(some)
                latest = max([self._due(r[0]) for r in some] + ([] if latest is None else [latest]))
        if latest is not None:
            self.handle.registerTimer(latest)
        yield _frame([], VERSIONS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        mark = timerValues.getCurrentWatermarkInMs()
        rows = [tuple(r) for r in self.waiting.get()]
        ready = sorted((r for r in rows if self._due(r[0]) <= mark), key=lambda r: r[:2])
        rest = [r for r in rows if self._due(r[0]) > mark]
        if rest:
            self.waiting.put(rest)
        else:
            self.waiting.clear()
        last, version = self.last.get() if self.last.exists() else (None, 0)
        out = []
        for _, upload, sha in ready:
            same = version > 0 and sha == last
            version += not same
            last = sha
            out.append((key[0], upload, version, same))
        if ready:
            self.last.update((last, version))
        yield _frame(out, VERSIONS)

    def close(self) -> None:
        pass


def upload_versions(uploads: DataFrame, delay: str = "1 hour") -> DataFrame:
    """A stream of uploads (upload, external_id, sha, arrived): the document and version of each, as ``latest.document_versions``
    gives them, in order of arrival, then upload.

    Uploads wait in the state of their document (its trimmed external_id, or their hash without one) until the watermark
    passes their arrival, so it doesn't matter how batches or Arrow cut and mix them. Uploads later than ``delay`` are
    dropped, as Spark drops late rows. A null hash is a hash. Needs ``use_timers``."""
    named = F.nullif(F.trim("external_id"), F.lit(""))
    document = F.coalesce(F.concat(F.lit("ext:"), named), F.concat(F.lit("sha:"), F.coalesce("sha", F.lit(""))))
    arrived = F.col("arrived").cast("timestamp")
    marked = uploads.select(document.alias("document"), arrived.alias("arrived"), F.unix_micros(arrived).alias("at"), "upload", "sha").withWatermark("arrived", delay)
    return marked.groupBy("document").transformWithStateInPandas(_Versions(), VERSIONS, "append", "eventTime")
