"""Change feeds and what they do to stored rows; identities of units, case by case."""

import random

from pyspark.sql import functions as F

from docspark.operators import latest, rules


def test_feed_turns_stored_rows_into_new_ones(spark):
    dice = random.Random(1)
    row = lambda i: (i, dice.choice([None, "", "a", "null"]), dice.choice([None, 0, 1]))
    stored, new = [row(i) for i in range(0, 60)], [row(i) for i in range(30, 90)]
    new += stored[:10]
    frame = lambda rows: spark.createDataFrame(rows, "k long, a string, b int")
    feed = latest.change_feed(frame(stored), frame(new), "k")
    old, now = {r[0]: r for r in stored}, {r[0]: r for r in new}
    want = {k: "insert" if k not in old else "delete" if k not in now else "unchanged" if old[k] == now[k] else "update" for k in old.keys() | now.keys()}
    got = feed.collect()
    assert {r.k: r.change for r in got} == want and len(got) == len(want) and set(want.values()) == {"insert", "delete", "unchanged", "update"}
    assert sorted(map(tuple, latest.applied(frame(stored), feed, "k").collect()), key=str) == sorted(new, key=str)
    assert latest.change_feed(frame([]), frame([]), "k").count() == 0
    # null isn't an empty text, and columns don't run into each other
    assert latest.change_feed(frame([(1, None, 1), (2, "a", None)]), frame([(1, "", 1), (2, None, None)]), "k").where("change = 'update'").count() == 2


def test_identities(spark):
    units = [(1, "letter"), (2, None), (3, "letter"), (4, None), (5, "letter"), (6, None)]
    axes = [(1, "c", "p", "s"), (3, "c", None, None), (5, "c", "p", None)]
    results = [
        (1, "utility_bill", "2024-01-03", "2024-01-30", None, None),
        (2, "accounting_statement", "2023-07-01", "2024-06-30", None, None),
        (3, None, None, None, None, None),
        (5, "utility_bill", None, None, None, "2024-05-06"),
        (6, "utility_bill", None, "2022-02-01", "2021-01-01", None),
    ]
    got = rules.identities(
        spark.createDataFrame(units, "unit long, family string"),
        spark.createDataFrame(axes, "unit long, context string, party string, subject string"),
        spark.createDataFrame(results, "unit long, specialist string, period_from string, period_to string, due_date string, issue_date string").withColumn("confidence", F.lit("clash")),
    )
    assert {r.unit: (r.family, r.period, r.confidence) for r in got.collect()} == {
        1: ("utility_bill", "2024-01", 85),
        2: ("accounting_statement", "2023-07/2024-06", 50),
        3: ("letter", None, 50),
        4: (None, None, 15),
        5: ("utility_bill", "2024-05", 85),
        6: ("utility_bill", "2022-02", 50),
    }


def test_pending_work(spark):
    wanted = [(1, "bill", "o:1-2"), (2, "bill", "o:1-2"), (3, "bill", "o:1-2"), (4, "bill", "o:1-2"), (5, "bill", "o:1-2"), (5, "statement", "o:1-2"), (6, "bill", "o:1-2")]
    jobs = [(1, "bill", 1, 1, "failed"), (2, "bill", 1, 1, "failed"), (2, "bill", 2, 2, "queued"), (3, "bill", 2, 4, "failed"), (3, "bill", 2, 3, "succeeded"), (5, "statement", 1, 5, "processing"), (6, "bill", 1, 6, "failed")]
    results = [(4, "bill", 1, 1, "o:1-2"), (3, "bill", 1, 2, "o:1-1"), (6, "bill", 1, 3, "o:1-1"), (6, "bill", 2, 4, "o:1-2")]
    got = latest.pending_work(
        spark.createDataFrame(wanted, "unit long, specialist string, input_version string"),
        spark.createDataFrame(jobs, "unit long, specialist string, created long, job long, status string"),
        spark.createDataFrame(results, "unit long, specialist string, created long, result long, input_version string"),
    )
    # 2 waits, 4 and 6 are done from this input; of 3's jobs the later one failed and its result is of another input
    assert {(r.unit, r.specialist) for r in got.collect()} == {(1, "bill"), (3, "bill"), (5, "bill")}


def test_document_overview(spark):
    frame = spark.createDataFrame
    got = latest.document_overview(
        frame([(1,), (2,), (1,)], "document long"),
        frame([(1, 10, 100, "letter", 1, False), (1, 10, 101, "bill", 1, True), (1, 11, 102, "note", 0, False)], "document long, scan long, unit long, kind string, created long, unsure boolean"),
        frame([(1, 1, 1, 90, True), (1, 1, 2, 0, False)], "document long, created long, result long, rotation int, reversed_order boolean"),
        frame([(1, 5, 1, "failed", "why"), (1, 4, 2, "succeeded", None), (3, 1, 1, "queued", None)], "document long, created long, job long, status string, error string"),
    )
    cols = ["document", "scans", "units", "newest", "latest_kind", "needs_review", "rotation", "reversed_order", "job_status", "job_error"]
    assert sorted(map(tuple, got.select(cols).collect())) == [(1, 2, 3, 1, "bill", True, 0, False, "failed", "why"), (2, 0, 0, None, None, False, 0, False, None, None)]
