"""Every registered query with SQL against DuckDB on the same tables."""

import datetime
import glob
import os

import duckdb
import pytest

from docspark import queries


def _plain(value):
    if isinstance(value, float):
        return None if value != value else round(value, 6)
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return float(value) if hasattr(value, "is_integer") else value


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str(tuple(_plain(r[i]) for i in order)) for r in rows)


@pytest.fixture(scope="module")
def con(sf):
    made = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        made.execute(f"create view {os.path.basename(path)[:-8]} as select * from '{path}'")
    return made


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_matches_sql(spark, sf, con, name):
    got = queries.QUERIES[name](spark, sf)
    cursor = con.execute(queries.ORACLE[name])
    names = [c[0] for c in cursor.description]
    assert sorted(names) == sorted(got.columns)
    assert _rows(got.columns, [tuple(r) for r in got.collect()]) == _rows(names, cursor.fetchall())


def test_normalize_key_reads_whole_texts(spark, sf):
    texts = {r.text for r in spark.read.parquet(f"{sf}/documents.parquet").select("text").collect()}
    got = {r.value for r in queries.QUERIES["fn_normalize_key"](spark, sf).select("value").collect()}
    assert max(len(t or "") for t in texts) > 60 and texts <= got


def test_others_run(spark, sf):
    for name in set(queries.QUERIES) - set(queries.ORACLE):
        assert queries.QUERIES[name](spark, sf).count() > 0
