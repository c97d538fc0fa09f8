"""Points in intervals, unit texts and tables of units against loops; a very long scan."""

import random

from pyspark.sql import functions as F

from docspark.operators import pages, scans
from docspark.operators.intervals import points_within


def test_every_pair_once(spark):
    dice = random.Random(1)
    points = [(dice.choice("ab"), i, dice.choice([None, *range(-20, 300)])) for i in range(300)] + [(None, 999, 5)]
    spans = [(dice.choice("ab"), i, a := dice.randint(-20, 290), a + dice.choice([-1, 0, 0, 1, 2, 3, 7, 8, 9, 64, 250])) for i in range(120)] + [(None, 998, 0, 9), ("a", 997, None, 3), ("a", 996, 4, 4), ("a", 996, 4, 4)]
    got = points_within(spark.createDataFrame(points, "k string, p long, at long"), spark.createDataFrame(spans, "k string, s long, a long, b long"), "k", "at", "a", "b")
    got = sorted((r.p, r.s) for r in got.collect())
    want = sorted((p, s) for k, p, at in points for x, s, a, b in spans if k is not None and k == x and at is not None and a is not None and a <= at <= b)
    assert got == want and len(want) > 1000
    assert points_within(spark.createDataFrame(points, "k string, p long, at long"), spark.createDataFrame([], "k string, s long, a long, b long"), "k", "at", "a", "b").count() == 0


def test_a_scan_of_100_000_pages_meets_few_candidates(spark):
    """Candidates before the exact filter, counted by joining on bins alone, stay below four times the pairs."""
    points = spark.range(1, 100_001).select(F.lit(1).alias("scan"), F.col("id").alias("page"))
    spans = spark.range(0, 50_000).select(F.lit(1).alias("scan"), F.col("id").alias("unit"), (F.col("id") * 2 + 1).alias("a"), (F.col("id") * 2 + 2 + F.col("id") % 3).alias("b"))
    spans = spans.unionByName(spark.createDataFrame([(1, 60_000, 1, 100_000)], "scan int, unit long, a long, b long"))
    met = points_within(points, spans, "scan", "page", "a", "b")
    pairs = met.count()
    assert pairs == sum(min(100_000, i * 2 + 2 + i % 3) - i * 2 for i in range(50_000)) + 100_000
    # each span meets the places of one or two bins, which are less than four times as many as its own
    width = lambda n: 1 << (n - 1).bit_length()
    lengths = [(i * 2 + 1, i * 2 + 2 + i % 3) for i in range(50_000)] + [(1, 100_000)]
    candidates = sum((b // width(b - a + 1) - a // width(b - a + 1) + 1) * width(b - a + 1) for a, b in lengths)
    assert candidates < 4 * sum(b - a + 1 for a, b in lengths)


def plain_text(unit, shown, result):
    found = sorted((p, (m or t or "").strip()) for s, p, m, t in shown if s == unit[0] and unit[2] <= p <= unit[3] and (m or t or "").strip())
    if {p for p, _ in found} == set(range(unit[2], unit[3] + 1)):
        return "\n".join(t for _, t in found).strip()
    markdown, count = result.get(unit[0], (None, 0))
    if not markdown or count <= 0:
        return ""
    lines = markdown.split("\n")
    each = max(1, len(lines) // count)
    return "\n".join(lines[(unit[2] - 1) * each : unit[3] * each]).strip()


def test_unit_texts(spark):
    dice = random.Random(2)
    shown = [(s, p, dice.choice([None, "", f" md {s} {p}\n"]), dice.choice([None, "  ", f"text {s} {p}", f"\ttext {s} {p} "])) for s in range(6) for p in range(1, 9)]
    shown += [(1, 3, None, "twice"), (1, 3, None, "twice")]
    units = [(s, s * 100 + i, a := dice.randint(1, 8), a + dice.randint(0, 4)) for s in range(8) for i in range(12)]
    result = {0: ("\n".join(f"line {i}" for i in range(37)), 8), 1: ("short", 8), 2: (None, 8), 3: ("x\ny", 0), 4: ("", 3), 5: ("\n".join(f"l{i}" for i in range(16)), 8), 6: ("only\nlines\n\n", 2)}
    got = pages.unit_text(
        spark.createDataFrame(units, "scan long, unit long, start_page int, end_page int").withColumn("text", F.lit("clash")).withColumn("n", F.lit(1)),
        spark.createDataFrame(shown, "scan long, page int, markdown string, text string"),
        spark.createDataFrame([(s, m, n) for s, (m, n) in result.items()], "scan long, markdown string, page_count int"),
    )
    assert {r.unit: r.text for r in got.collect()} == {u[1]: plain_text(u, shown, result) for u in units}
    assert got.count() == len(units)


def test_tables_of_units(spark):
    dice = random.Random(3)
    units = [(s, s * 100 + i, a := dice.randint(1, 9), a + dice.randint(0, 3)) for s in range(4) for i in range(8)]
    tables = [(dice.randint(0, 4), t, dice.choice([None, None, *range(1, 12)]), dice.choice([None, [], [None], [3, 3, 4], [9, None, 1]])) for t in range(60)]
    got = scans.tables_of_units(spark.createDataFrame(tables, "scan long, table long, page int, places array<int>"), spark.createDataFrame(units, "scan long, unit long, start_page int, end_page int"))

    def belongs(page, places, a, b):
        if page is not None:
            return a <= page <= b
        places = [p for p in places or [] if p is not None]
        return not places or any(a <= p <= b for p in places)

    assert sorted((r.unit, r.table) for r in got.collect()) == sorted((u, t) for s, t, page, places in tables for scan, u, a, b in units if s == scan and belongs(page, places, a, b))
