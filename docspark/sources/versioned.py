"""Tables of hash buckets with a manifest for each version: a commit rewrites the buckets it touches and is seen whole or not at all.

Below a table's path lie ``data/<commit>/bucket=<n>`` and ``manifests/<version>.json``. A manifest says for every
bucket which commit holds it, and which batches of which streams the version contains. A commit writes its buckets beside
the old ones and then renames its manifest into place; until then readers see the version before.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Conflict(RuntimeError):
    """Another commit made the next version first."""


def _files(spark: SparkSession, path: str):
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def manifest(spark: SparkSession, path: str, version: int | None = None) -> dict | None:
    """The newest manifest, or that of a version; None if there is none."""
    fs, at = _files(spark, path)
    folder = at(f"{path}/manifests")
    if not fs.exists(folder):
        return None
    names = [s.getPath().getName() for s in fs.listStatus(folder)]
    found = sorted((int(n[:-5]) for n in names if n.endswith(".json") and n[:-5].isdigit()), reverse=True)
    if version is not None:
        found = [v for v in found if v == version]
    if not found:
        return None
    text = spark.read.text(f"{path}/manifests/{found[0]:020d}.json", wholetext=True).first()[0]
    return json.loads(text)


def _commit(spark: SparkSession, path: str, made: dict) -> None:
    fs, at = _files(spark, path)
    fs.mkdirs(at(f"{path}/manifests"))
    draft = at(f"{path}/manifests/.{uuid.uuid4().hex}.draft")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps(made).encode()))
    out.close()
    target = at(f"{path}/manifests/{made['version']:020d}.json")
    if fs.exists(target) or not fs.rename(draft, target):
        fs.delete(draft, False)
        raise Conflict(f"version {made['version']} of {path} is there already")


def _rows(spark: SparkSession, path: str, found: dict, buckets: list[int] | None = None) -> DataFrame:
    schema = StructType.fromJson(found["schema"])
    folders = [f"{path}/data/{commit}/bucket={b}" for b, commit in found["held"].items() if buckets is None or int(b) in buckets]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame | None:
    """The newest version of a table (or an earlier one that wasn't removed); None if there is none."""
    found = manifest(spark, path, version)
    return None if found is None else _rows(spark, path, found)


def bucketed(df: DataFrame, key: str, buckets: int) -> DataFrame:
    return df.withColumn("_bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))


def merge_into(
    changes: DataFrame,
    path: str,
    key: str,
    merge: Callable[[DataFrame | None, DataFrame], DataFrame],
    buckets: int = 64,
    keys: DataFrame | None = None,
    applied: tuple[str, int] | None = None,
) -> int:
    """Commit ``merge(old rows, changes)`` for the buckets that ``changes`` (or ``keys``, rows with ``key``) fall into; returns the version.

    ``merge`` gets the rows of those buckets alone, or None if there is no table yet, and returns all rows that they hold from then on.
    ``applied`` names a stream and its batch: a batch that a version contains isn't applied again. ``buckets`` counts for a
    new table only (see ``rebucket``). No more than a number a bucket reaches the driver.
    """
    spark = changes.sparkSession
    found = manifest(spark, path)
    done = {} if found is None else found["applied"]
    if applied and done.get(applied[0], -1) >= applied[1]:
        return found["version"]
    count = buckets if found is None else found["buckets"]
    touched = sorted(r[0] for r in bucketed((changes if keys is None else keys).select(key), key, count).select("_bucket").distinct().collect())
    version, held = (0, {}) if found is None else (found["version"], dict(found["held"]))
    schema = None if found is None else found["schema"]
    if touched:
        rows = merge(None if found is None else _rows(spark, path, found, touched), changes)
        commit = uuid.uuid4().hex
        out = bucketed(rows, key, count).withColumnRenamed("_bucket", "bucket")
        out.repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/data/{commit}")
        fs, at = _files(spark, path)
        written = {int(s.getPath().getName()[7:]) for s in fs.listStatus(at(f"{path}/data/{commit}")) if s.getPath().getName().startswith("bucket=")}
        if not written <= set(touched):
            raise ValueError("merge returned rows of other buckets")
        held = {b: c for b, c in held.items() if int(b) not in touched} | {str(b): commit for b in sorted(written)}
        schema = rows.schema.jsonValue()
    elif found is None:
        schema = changes.schema.jsonValue()
    if applied:
        done = {**done, applied[0]: applied[1]}
    _commit(spark, path, {"version": version + 1, "buckets": count, "key": key, "held": held, "applied": done, "schema": schema})
    return version + 1


def rebucket(spark: SparkSession, path: str, buckets: int) -> int:
    """The same rows in another number of buckets, as a new version."""
    found = manifest(spark, path)
    commit, key = uuid.uuid4().hex, found["key"]
    bucketed(_rows(spark, path, found), key, buckets).withColumnRenamed("_bucket", "bucket").repartition("bucket").write.partitionBy("bucket").parquet(f"{path}/data/{commit}")
    fs, at = _files(spark, path)
    written = [s.getPath().getName()[7:] for s in fs.listStatus(at(f"{path}/data/{commit}")) if s.getPath().getName().startswith("bucket=")]
    _commit(spark, path, {**found, "version": found["version"] + 1, "buckets": buckets, "held": {b: commit for b in written}})
    return found["version"] + 1


def vacuum(spark: SparkSession, path: str, keep: int = 2) -> int:
    """Remove what only versions before the newest ``keep`` hold, and commits that never came about; returns how many folders went.
    Not to be run beside a commit."""
    fs, at = _files(spark, path)
    newest = manifest(spark, path)["version"]
    kept = [m for v in range(newest, newest - keep, -1) if v > 0 and (m := manifest(spark, path, v)) is not None]
    used = {(b, c) for m in kept for b, c in m["held"].items()}
    gone = 0
    for commit in fs.listStatus(at(f"{path}/data")) if fs.exists(at(f"{path}/data")) else []:
        name, left = commit.getPath().getName(), False
        for folder in fs.listStatus(commit.getPath()):
            part = folder.getPath().getName()
            if part.startswith("bucket=") and (part[7:], name) in used:
                left = True
            elif part.startswith("bucket="):
                fs.delete(folder.getPath(), True)
                gone += 1
        if not left:
            fs.delete(commit.getPath(), True)
    for s in fs.listStatus(at(f"{path}/manifests")):
        name = s.getPath().getName()
        if name.endswith(".draft") or name.endswith(".json") and int(name[:-5]) <= newest - keep:
            fs.delete(s.getPath(), False)
    return gone
