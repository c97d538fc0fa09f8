"""Jobs on small tables with expected rows."""

import datetime

from pyspark.sql import functions as F

from docspark.functions import text as fn
from docspark.operators import accounting, contexts, latest, pages, topics
from docspark.plans.components import components
from docspark.streaming import jobs


def _fact(period, category, cents, total=False, account="unit_1"):
    return ("ctx", account, "subject", period, category, cents, total, 1)


FACT = "context string, account string, role string, period int, category string, cents long, is_total boolean, unit long"


def test_periods_compare(spark):
    rows = [_fact(2022, "general", 6000), _fact(2022, "water", 4000), _fact(2022, "total", 10000, True), _fact(2023, "general", 9000), _fact(2023, "water", 4000), _fact(2023, "total", 13000, True)]
    got = accounting.period_over_period(accounting.period_breakdown(spark.createDataFrame(rows, FACT))).first()
    assert (got.delta, got.percent, got.direction, got.comparison) == (3000, 30.0, "up", "comparable")
    changed = accounting.category_changes(spark.createDataFrame(rows, FACT), 2022, 2023).collect()
    assert [(r.category, r.delta, r.percent) for r in changed] == [("general", 3000, 50.0)]


def test_breakdown_statuses(spark):
    rows = [_fact(1, "a", 100), _fact(1, "total", 99900, True), _fact(2, "total", 100, True), _fact(3, "a", 100), _fact(3, "total", 100, True), _fact(3, "total", 100, True), _fact(4, "a", 100), _fact(4, "total", 102, True)]
    got = {r.period: r.status for r in accounting.period_breakdown(spark.createDataFrame(rows, FACT)).collect()}
    assert got == {1: "inconsistent_total", 2: "missing_components", 3: "ambiguous_total", 4: "validated"}


def test_versions(spark):
    rows = [(1, "x", "A"), (2, "x", "A"), (3, "x", "B"), (4, "x", "A"), (5, None, "A"), (6, None, "A"), (7, None, "C")]
    got = {r.upload: (r.version, r.deduplicated) for r in latest.document_versions(spark.createDataFrame(rows, "upload long, external_id string, sha string")).collect()}
    assert got == {1: (1, False), 2: (1, True), 3: (2, False), 4: (3, False), 5: (1, False), 6: (1, True), 7: (1, False)}


def test_leaders_follow_the_best_earlier_leader(spark):
    pairs = [(1, 2, 0.6), (2, 3, 0.9), (1, 4, 0.5), (3, 4, 0.7), (5, 6, 0.5)]
    got = topics.leaders(spark.createDataFrame(pairs, "a long, b long, score double"), spark.createDataFrame([(i,) for i in range(1, 8)], "topic long"))
    assert {r.topic: r.leader for r in got.collect()} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5, 6: 5, 7: 7}


def test_components(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (103, 101), (7, 7), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 1 for i in range(1, 41)} | {100: 100, 101: 100, 103: 100}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_context_groups(spark):
    rows = [("Acqua", "organization", d) for d in (1, 2)] + [("Via Roma", "address", d) for d in (1, 2)] + [("Torino", "place", d) for d in (1, 3)] + [("once", "place", 9)]
    sets = contexts.document_sets(spark.createDataFrame(rows, "entity string, kind string, document long"))
    assert {r.entity: r.context for r in contexts.context_groups(sets).collect()} == {"Acqua": "Acqua", "Via Roma": "Acqua", "Torino": "Torino"}


def test_segments_cover_all_pages_once(spark, sf):
    from docspark.bridge import view

    df = view(spark, sf, "pages")
    got = pages.segments(pages.boundaries(df))
    covered = got.select("scan", F.explode(F.sequence("start_page", "end_page")).alias("page"))
    assert covered.count() == covered.distinct().count() == df.count()


def test_text_functions(spark):
    df = spark.createDataFrame([("Spese Generali 2022!", "1.234,56", "3/7/49", " il testo di che della città "), ("--", "12,3x", "x", "the cat is of and the dog ")], "t string, a string, d string, l string")
    got = df.select(fn.slug(F.col("t")), fn.amount_it(F.col("a")), fn.date_it(F.col("d")), fn.language(F.col("l"))).collect()
    assert tuple(got[0]) == ("spese-generali-2022", 1234.56, "2049-07-03", "it") and tuple(got[1]) == ("topic", None, None, "en")


def _drained(df, name, mode):
    query = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
    query.processAllAvailable()
    query.stop()
    return df.sparkSession.sql(f"select * from {name}")


def test_streams(spark, tmp_path):
    at = lambda m: datetime.datetime(2024, 1, 1, 0, m)
    rows = [(1, "x", "A", at(0)), (2, "x", "A", at(1)), (3, "x", "B", at(2)), (4, None, "A", at(3))]
    schema = "upload long, external_id string, sha string, arrived timestamp"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    once = _drained(jobs.deduplicated(stream), "once", "append")
    assert sorted(r.sha for r in once.collect()) == ["A", "B"]


def test_driver_contract(spark, sf):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and e.entry(spark).count() > 0
