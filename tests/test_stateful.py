"""Streams with timers against their batch forms; versioned tables under replays, restarts, conflicts and crashes."""

import datetime
import os
import random

import pytest
from pyspark.sql import functions as F

from docspark.operators import latest
from docspark.sources import versioned
from docspark.streaming import jobs, stateful

JOB = "kind string, job long, event long, ts timestamp, status string"
UPLOAD = "upload long, external_id string, sha string, arrived timestamp"


def at(hours: float) -> datetime.datetime:
    return datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=hours)


class Feed:
    """A folder that a stream reads, one file a batch."""

    def __init__(self, spark, schema: str, path: str):
        self.spark, self.schema, self.path = spark, schema, path
        stateful.use_timers(spark)

    def add(self, rows, parts: int = 1):
        self.spark.createDataFrame(rows, self.schema).coalesce(parts).write.mode("append").parquet(f"{self.path}/in")

    def run(self, job) -> list:
        stream = self.spark.readStream.schema(self.schema).parquet(f"{self.path}/in")
        job(stream).writeStream.format("parquet").option("checkpointLocation", f"{self.path}/check").trigger(availableNow=True).start(f"{self.path}/out").awaitTermination()
        return self.spark.read.schema(job(stream).schema).parquet(f"{self.path}/out").collect()


def test_a_job_goes_stale_without_a_further_event(spark, tmp_path):
    feed = Feed(spark, JOB, str(tmp_path))
    feed.add([("ingest", 1, 1, at(1), "running"), ("specialist", 1, 2, at(1), "processing"), ("ingest", 2, 3, at(1), "queued"), ("ingest", 3, 4, at(1), "running")])
    assert feed.run(stateful.stale_jobs) == []
    feed.add([("ingest", 3, 5, at(3), "succeeded"), ("ingest", 9, 6, at(5.5), "succeeded")])  # the watermark comes to 4:30
    assert [(r.kind, r.job, r.event, r.reason) for r in feed.run(stateful.stale_jobs)] == [("specialist", 1, 2, "running too long")]
    feed.add([("ingest", 9, 7, at(8.5), "succeeded")])  # 7:30
    assert {(r.kind, r.job) for r in feed.run(stateful.stale_jobs)} == {("specialist", 1), ("ingest", 1)}
    feed.add([("ingest", 9, 8, at(40), "succeeded"), ("ingest", 1, 9, at(39), "running")])
    found = feed.run(stateful.stale_jobs)
    assert sorted((r.kind, r.job, r.event) for r in found) == [("ingest", 1, 1), ("ingest", 2, 3), ("specialist", 1, 2)]
    assert {r.ts for r in found} == {at(1)}


def test_stale_jobs_equal_the_batch_form(spark, tmp_path):
    dice = random.Random(3)
    statuses = {"ingest": ["queued", "running", "failed", "succeeded", "odd"], "specialist": ["pending", "processing", "queued", "succeeded"]}
    rows = []
    for event in range(400):
        kind = dice.choice([*statuses])
        rows.append((kind, dice.randint(0, 60), event, at(10 + dice.choice([dice.random() * 40, dice.randint(0, 40)])), dice.choice(statuses[kind])))
    feed = Feed(spark, JOB, str(tmp_path))
    feed.add(rows, 3)
    got = feed.run(stateful.stale_jobs)
    mark = max(r[3] for r in rows) - datetime.timedelta(hours=1)
    want = jobs.stale(spark.createDataFrame(rows, JOB), F.date_trunc("millisecond", F.lit(mark))).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(want) > 10
    assert {r.kind for r in want} == {"ingest", "specialist"}


def test_versions_equal_the_batch_form_however_batches_are_mixed(spark, tmp_path):
    """One document of 12,000 uploads (more than one Arrow batch), others, null and blank external_ids; all shuffled."""
    dice = random.Random(4)
    rows = [(i, "big", f"h{dice.randint(0, 2)}", at(1 + i / 10_000)) for i in range(12_000)]
    rows += [(20_000 + i, dice.choice([None, "", " a ", "a", "b", "c"]), f"h{dice.randint(0, 3)}", at(1 + i / 1000)) for i in range(800)]
    feed = Feed(spark, UPLOAD, str(tmp_path))
    for part in range(2):
        some = [r for r in rows if (r[3] < at(1.6)) == (part == 0)]
        dice.shuffle(some)
        feed.add(some, 2)
        if part == 0:
            early = feed.run(stateful.upload_versions)
    feed.add([(99_999, "end", "x", at(50))])
    got = feed.run(stateful.upload_versions)
    want = latest.document_versions(spark.createDataFrame(rows, UPLOAD)).collect()
    assert {tuple(r) for r in got} == {(r.document, r.upload, r.version, r.deduplicated) for r in want} and len(got) == len(want)
    assert len(early) < len(rows)


def _status(spark, schema, folder, table, check):
    jobs.keep_latest_status(spark.readStream.schema(schema).parquet(folder), table, check, buckets=16).awaitTermination()
    return {r.job: (r.status, r.failures, r.last_failure) for r in jobs.latest_status(versioned.read_table(spark, table)).collect()}


def _bytes(folder: str) -> dict:
    return {os.path.join(d, n): os.path.getsize(os.path.join(d, n)) for d, _, names in os.walk(folder) for n in names if n.endswith(".parquet")}


def test_latest_status_writes_what_a_batch_touches_and_survives_restarts(spark, tmp_path):
    dice = random.Random(5)
    rows = [(j, e, at(e / 60), dice.choice(["queued", "failed", "running", "succeeded"])) for e, j in enumerate(dice.choices(range(600), k=3000))]
    schema = "job long, event long, ts timestamp, status string"
    frame = spark.createDataFrame(rows, schema)
    folder, table, check = (str(tmp_path / n) for n in ("in", "table", "check"))
    frame.where("event < 2900").coalesce(1).write.parquet(folder)
    _status(spark, frame.schema, folder, table, check)
    before = _bytes(table)
    frame.where("event >= 2900 and job = 7 or event = 2999").coalesce(1).write.mode("append").parquet(folder)
    _status(spark, frame.schema, folder, table, check)
    new = {k: v for k, v in _bytes(table).items() if k not in before}
    assert sum(new.values()) < 0.4 * sum(before.values())  # two buckets of sixteen
    frame.where("event >= 2900 and not (job = 7 or event = 2999)").coalesce(1).write.mode("append").parquet(folder)
    got = _status(spark, frame.schema, folder, table, check)
    want = {r.job: (r.status, r.failures, r.last_failure) for r in jobs.merged_status(None, frame).collect()}
    assert got == want
    assert _status(spark, frame.schema, folder, table, check) == want  # nothing new
    assert _status(spark, frame.schema, folder, table, str(tmp_path / "other")) == want  # all again, from a new checkpoint
    spark.createDataFrame([(7, 5000, at(100), "failed")], schema).coalesce(1).write.mode("append").parquet(folder)
    got = _status(spark, frame.schema, folder, table, str(tmp_path / "other"))
    assert got[7] == ("failed", want[7][1] + 1, 5000) and {k: v for k, v in got.items() if k != 7} == {k: v for k, v in want.items() if k != 7}


def _table(spark, path, **more):
    rows = lambda r: spark.createDataFrame(r, "k long, v string")
    put = lambda r, **m: versioned.merge_into(rows(r), path, "k", lambda old, new: new if old is None else old.join(new.select("k"), "k", "left_anti").unionByName(new), 8, **m)
    read = lambda v=None: sorted((r.k, r.v) for r in versioned.read_table(spark, path, v).collect())
    return put, read


def test_a_batch_counts_once_and_versions_stay_readable(spark, tmp_path):
    path = str(tmp_path / "t")
    put, read = _table(spark, path)
    assert versioned.read_table(spark, path) is None
    assert put([(i, "a") for i in range(50)], applied=("s", 0)) == 1
    assert put([(3, "again")], applied=("s", 0)) == 1 and (3, "a") in read()
    assert put([(3, "b")], applied=("s", 1)) == 2 and put([], applied=("s", 2)) == 3
    assert (3, "b") in read() and (3, "a") in read(1) and len(read()) == 50
    assert versioned.manifest(spark, path)["applied"] == {"s": 2}
    versioned.rebucket(spark, path, 3)
    now = read()
    assert versioned.manifest(spark, path)["buckets"] == 3 and len(now) == 50
    assert put([(3, "c")]) == 5 and (3, "c") in read()
    assert versioned.vacuum(spark, path, keep=1) > 0 and len(read()) == 50 and versioned.read_table(spark, path, 1) is None


def test_a_crash_or_a_second_writer_leaves_the_version_before(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    put, read = _table(spark, path)
    put([(i, "a") for i in range(20)])
    commit = versioned._commit

    def crash(*_):
        raise OSError("gone")

    monkeypatch.setattr(versioned, "_commit", crash)
    with pytest.raises(OSError):
        put([(1, "lost")])
    assert read() == [(i, "a") for i in range(20)]  # written, but in no manifest

    def second(spark, path, made):
        monkeypatch.setattr(versioned, "_commit", commit)
        put([(2, "first")])
        commit(spark, path, made)

    monkeypatch.setattr(versioned, "_commit", second)
    with pytest.raises(versioned.Conflict):
        put([(2, "second")])
    assert (2, "first") in read() and len(read()) == 20
    versioned.vacuum(spark, path, keep=1)
    assert len(read()) == 20
