"""Merges, families, reviews, assertions, search and scans on small tables with expected rows."""

from docspark.operators import knowledge, merging, scans

TOPIC = "topic long, slug string, title string, topic_class string, is_active boolean"


def _rows(df, *cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_heavier_topic_survives(spark):
    topics = spark.createDataFrame([(i, f"s{i}", f"T{i}", "meeting", True) for i in range(1, 6)], TOPIC)
    held = [(10, 1, "subject", 5, None), (10, 2, "subject", 7, "two"), (11, 2, "subject", 1, None), (12, 3, "subject", 9, None), (13, 4, "subject", 3, "x"), (13, 5, "subject", 3, "y")]
    held = spark.createDataFrame(held, "unit long, topic long, role string, confidence int, rationale string")
    weighted = merging.weights(topics, held)
    to = merging.merged_map(spark.createDataFrame([(1, 2), (2, 3), (5, 4), (None, 3)], "source long, target long"), weighted)
    assert _rows(to, "topic", "survivor") == [(1, 2), (2, 2), (3, 2), (4, 4), (5, 4)]  # equal weights: the smaller number
    got = _rows(merging.merged_assignments(held, to), "unit", "topic", "role", "confidence", "rationale")
    assert got == [(10, 2, "subject", 7, "two"), (11, 2, "subject", 1, None), (12, 2, "subject", 9, None), (13, 4, "subject", 3, "x")]
    names = [(1, "b", "A title"), (2, "keep", "Keep"), (3, "KEEP", "a TITLE")]
    got = merging.merged_aliases(spark.createDataFrame(names, "topic long, slug string, title string"), to.where("topic < 4"))
    assert _rows(got, "topic", "alias") == [(2, "A title"), (2, "b")]


def test_proposals_weigh(spark):
    topics = spark.createDataFrame([(1,), (2,), (3,)], "topic long")
    held = spark.createDataFrame([(1, 3), (2, 3)], "topic long, confidence int")
    proposed = spark.createDataFrame([(2, None), (None, 9)], "topic long, confidence int")
    got = {r.topic: tuple(r.weight) for r in merging.weights(topics, held, proposed).collect()}
    assert got == {1: (1, 0, 3), 2: (1, 1, 3), 3: (0, 0, 0)}


def test_cross_class_signatures(spark):
    topics = [(1, None, "Fattura", "vendor_relationship", True), (2, None, "Pratica privacy", "legal_matter", True), (3, None, "Lavori", "building_issue", True), (4, None, "Verbale", "meeting", True), (5, None, "Tax 2020", "other", True), (6, None, "niente", "other", True)]
    anchors = [(1, "via roma", "acme", None, None), (2, None, "acme", None, "acme"), (3, "via roma", "acme", None, None), (4, "via roma", None, None, None), (5, None, None, None, "torino")]
    got = merging.cross_class(spark.createDataFrame(topics, TOPIC), spark.createDataFrame(anchors, "topic long, address string, organization string, person string, place string"))
    assert {r.topic: r.signature for r in got.collect()} == {1: "admin_finance|acme|via roma", 2: "admin_finance|acme", 3: "matter|via roma", 4: None, 5: "admin_finance|torino|tax", 6: None}


def test_reviews(spark):
    proposals = [(1, 10, 1, "s1", "waiting"), (2, 20, 1, "s1", "proposed"), (3, 30, 2, "new", "proposed"), (4, 40, None, "s9", "proposed"), (5, 50, 2, "s2", "proposed"), (6, 60, 1, "s1", "proposed"), (7, 70, None, "s7", "proposed")]
    proposals = spark.createDataFrame([(p, u, t, s, s, 50, st) for p, u, t, s, st in proposals], "proposal long, unit long, topic long, slug string, title string, confidence int, status string")
    reviews = [(1, "reject", None, "subject"), (2, "merge_into_existing", 2, "subject"), (3, "approve_new_topic", None, "subject"), (4, None, None, "subject"), (5, "reject", None, "subject"), (7, "merge_into_existing", 99, "subject")]
    reviews = spark.createDataFrame(reviews, "proposal long, action string, target long, role string")
    topics = spark.createDataFrame([(1, "s1", True), (2, "s2", False), (3, "s9", True)], "topic long, slug string, is_active boolean")
    decided = merging.reviewed(proposals, reviews, topics)
    assert _rows(decided, "proposal", "status") == [(1, "waiting"), (2, "approved"), (3, "approved"), (4, "approved"), (5, "rejected"), (6, "merged_into_existing"), (7, "proposed")]
    held = [(10, 1, "subject", 1), (20, 1, "subject", 1), (20, 2, "primary", 1), (20, 3, "primary", 1), (50, 2, "subject", 1), (50, 1, "secondary", 1)]
    after = merging.assignments_after(decided, spark.createDataFrame(held, "unit long, topic long, role string, confidence int"), topics)
    got = {(r.unit, r.topic, r.slug, r.role, r.confidence) for r in after.collect()}
    assert got == {(10, 1, None, "subject", 1), (20, 2, None, "subject", 50), (20, 3, None, "primary", 1), (30, None, "new", "subject", 50), (40, 3, None, "subject", 50), (50, 1, None, "secondary", 1)}


def test_bills_without_a_usable_issuer_state_nothing(spark):
    cols = "unit long, issuer string, holder string, issue_date string, due_date string, total double, number string, contract string, supply string, reference string, period_from string, period_to string, payment_status string, service string"
    rest = ("Condominio X", None, None, 1.5, None, "", None, "VIA ROMA", "2020-01-01", None, "unknown", "water")
    bills = spark.createDataFrame([(1, "Enel", *rest), (2, "<table>", *rest), (3, "unknown", *rest), (4, "x" * 2000, *rest)], cols)
    units = spark.createDataFrame([(1, "bill"), (5, None)], "unit long, kind string")
    about = spark.createDataFrame([(1, "acme")], "unit long, node string")
    none = spark.createDataFrame([], "unit long, statement_type string, period_from string, period_to string, validation string")
    got = {(r.unit, r.predicate): r.object for r in knowledge.assertions(units, about, bills, none).where("source <> 'classification'").collect()}
    assert {u for u, _ in got} == {1, 3} and (3, "issued_by") not in got and (1, "payment_status") not in got and (1, "contract_code") not in got
    assert got[1, "issued_by"] == "organization:Enel" and got[1, "addressed_to"] == "organization:Condominio X" and got[1, "about"] == "acme" and got[3, "about"] == "address:VIA ROMA"
    assert got[1, "covers_period"] == "2020-01-01.." and got[1, "amount_total"] == "150"


def test_search(spark):
    df = spark.createDataFrame([(1, "Via Roma", None), (2, None, "a via roma%"), (3, "x", "y")], "topic long, title string, slug string")
    hits = knowledge.hits(df, "topic", {"title": "title", "slug": "slug"}, [" via ROMA ", "x", "%", "a_"])
    assert _rows(knowledge.found([hits, hits], "topic", ["title", "slug"]), "topic", "query", "fields") == [(1, "via ROMA", "title"), (2, "via ROMA", "slug")]
    assert knowledge.hits(df, "topic", {"title": "title"}, ["x"]).count() == 0


def test_preflight(spark):
    pages = [(1, p, (None, 90, 180, 180, 90, 360)[p - 1], "text" if p == 2 else " ") for p in range(1, 7)] + [(2, 1, 0, "abc ")]
    got = scans.preflight_flags(spark.createDataFrame(pages, "scan long, page int, rotation int, text string"), spark.createDataFrame([(1, 2_400_005)], "scan long, bytes long"))
    rows = {r.scan: r for r in got.collect()}
    # of six pages 1, 3, 4 and 6 are sampled; 90 and 180 are as common, 90 comes first
    assert (rows[1].rotations, rows[1].dominant, rows[1].bytes_per_page, rows[1].flags) == ("0:2,90:2,180:2", 90, 400_000, "declared_rotation,mixed_declared_rotation,heavy_scan,image_only_likely")
    assert (rows[2].sampled_chars, rows[2].dominant, rows[2].flags) == (3, None, "")


def test_regulations(spark):
    unit = "scan long, unit long, ordinal int, start_page int, end_page int, kind string, title string, summary string"
    units = [(1, 11, 1, 1, 2, "contratto", None, "Regolamento"), (1, 12, 2, 3, 4, None, None, "art. 1"), (2, 21, 1, 1, 1, "fattura", "a", "regolamento condominio art. art. art."), (2, 22, 2, 2, 2, "lettera", "b", None), (3, 31, 1, 1, 9, "lettera", "c", "regolamento condominio art. art. art.")]
    units = spark.createDataFrame(units, unit)
    pages = spark.createDataFrame([(1, "Articolo 2 del condominio, ART. 3"), (1, None)], "scan long, text string")
    found = scans.regulations(units, pages)
    assert _rows(found, "scan", "is_regulation") == [(1, True), (2, False), (3, False)]
    entities = spark.createDataFrame([(12, "indirizzo"), (12, "indirizzo")], "unit long, kind string")
    got = scans.regulation_collapsed(units, entities, spark.createDataFrame([], "unit long"), found)
    assert _rows(got, "scan", "unit", "ordinal", "start_page", "end_page") == [(1, 12, 1, 1, 4), (2, 21, 1, 1, 1), (2, 22, 2, 2, 2), (3, 31, 1, 1, 9)]


def test_aliases_are_new_in_any_case(spark):
    topics = spark.createDataFrame([("a", 1, "One", "x", "y", None, False)], "slug string, topic long, title string, topic_class string, topic_kind string, description string, is_active boolean")
    new = spark.createDataFrame([("a", "Uno", "c", "k", "d", 1), ("a", "Due", "c", "k", None, 2), ("b", "Tre", "c", "k", "d", 1)], "slug string, title string, topic_class string, topic_kind string, description string, nth int")
    up = knowledge.upserted_topics(topics, new)
    assert {(r.slug, r.topic, r.title, r.is_active) for r in up.collect()} == {("a", 1, "Due", True), ("b", None, "Tre", True)}
    given = spark.createDataFrame([("a", "DUE"), ("a", "held"), ("a", "x"), ("a", "X"), ("b", None), ("b", "tre")], "slug string, alias string")
    assert _rows(knowledge.added_aliases(up, spark.createDataFrame([("a", "Held")], "slug string, alias string"), given), "slug", "alias") == [("a", "X")]
