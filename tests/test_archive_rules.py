"""Archive jobs without SQL, or with cases that the tables lack, against plain loops."""

import difflib
import os
import random

from pyspark.sql import functions as F

from docspark.operators import bills, consolidation, fuzzy, pages, rules, statements
from docspark.sources import archive, versioned
from docspark.streaming import jobs


def test_replace_units_keeps_the_others(spark, tmp_path):
    path = str(tmp_path / "units")
    archive.replace_units(spark.createDataFrame([(i, "old") for i in range(1000)], "unit long, v string"), path)
    archive.replace_units(spark.createDataFrame([(7, "new"), (7, "more"), (2000, "new")], "unit long, v string"), path)
    got = sorted((r.unit, r.v) for r in versioned.read_table(spark, path).collect())
    assert got == sorted([(i, "old") for i in range(1000) if i != 7] + [(7, "new"), (7, "more"), (2000, "new")])
    gone = spark.createDataFrame([(i,) for i in range(1000)], "unit long")
    archive.replace_units(spark.createDataFrame([], "unit long, v string"), path, units=gone)
    assert [(r.unit, r.v) for r in versioned.read_table(spark, path).collect()] == [(2000, "new")]


def test_incremental_projection_and_latest_status(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "unit long, created long, result_id long, amount long"
    project = lambda df: df.select("unit", F.explode(F.sequence(F.lit(1), F.col("amount"))).alias("fact"))

    def arrive(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source)
        jobs.incremental_projection(stream, project, out, str(tmp_path / "check")).awaitTermination()
        return sorted((r.unit, r.fact) for r in versioned.read_table(spark, out).collect())

    assert arrive([(1, 1, 1, 2), (2, 1, 2, 1), (2, 2, 3, 3)]) == [(1, 1), (1, 2), (2, 1), (2, 2), (2, 3)]
    assert arrive([(2, 3, 4, 1), (3, 1, 5, 1)]) == [(1, 1), (1, 2), (2, 1), (3, 1)]

    rows = [(j, e, f"2024-01-{1 + e % 28:02} 00:00:00", s) for e, (j, s) in enumerate([(1, "queued"), (1, "failed"), (2, "queued"), (1, "succeeded"), (2, "failed"), (3, "running")])]
    events = spark.createDataFrame(rows, "job long, event long, ts string, status string").withColumn("ts", F.to_timestamp("ts"))
    folder = str(tmp_path / "jobs")
    for part in ("event < 3", "event >= 3"):
        events.where(part).coalesce(1).write.mode("append").parquet(folder)
        jobs.keep_latest_status(spark.readStream.schema(events.schema).parquet(folder), str(tmp_path / "status"), str(tmp_path / "status-check")).awaitTermination()
    got = {r.job: (r.status, r.failures, r.last_failure) for r in jobs.latest_status(versioned.read_table(spark, str(tmp_path / "status"))).collect()}
    assert got == {1: ("succeeded", 1, 1), 2: ("failed", 1, 4), 3: ("running", 0, None)}


def test_pdf_files_and_ocr(spark, tmp_path):
    (tmp_path / "in/deep").mkdir(parents=True)
    (tmp_path / "in/a.pdf").write_bytes(b"%PDF-1.4 text")
    (tmp_path / "in/deep/b.pdf").write_bytes(b"plain")
    (tmp_path / "in/c.txt").write_text("no")
    got = {r.path.rsplit("/", 1)[1]: r.status for r in archive.pdf_files(spark, str(tmp_path / "in"), 1000).collect()}
    assert got == {"a.pdf": "ok", "b.pdf": "not_pdf"}
    (tmp_path / "ocr").mkdir()
    (tmp_path / "ocr/r.json").write_text('{"document_id": "d", "page_count": 2, "pages": [{"page_number": 1, "text": "one"}, {"page_number": 2, "text": "two"}]}')
    assert [(r.page_number, r.text) for r in archive.ocr_json(spark, str(tmp_path / "ocr")).orderBy("page_number").collect()] == [(1, "one"), (2, "two")]


def test_statement_tables_of_all_kinds(spark):
    text = "Rate da versare\nPeriodo: 1/7/22 - 30/6/23\n| Nominativo | Importo | Data pag. |\n|---|---|---|\n| Rossi Mario (B2) | 1.000,50 | 01/02/2023 |\n| | | |\nfine\n| solo | una |\n"
    html = "<TABLE><tr><td>Voce</td><td>A</td><td>A</td><td>A</td></tr><tr><td>Saldo &amp; resto</td><td>1</td><td> 2,5 </td></tr></TABLE>"
    cell = lambda r, r2, c, c2, t, head=False: f'{{"start_row_offset_idx":{r},"end_row_offset_idx":{r2},"start_col_offset_idx":{c},"end_col_offset_idx":{c2},"text":"{t}","column_header":{str(head).lower()}}}'
    grid = '{"num_rows":3,"num_cols":3,"table_cells":[' + ",".join([cell(0, 2, 0, 1, "Scala", True), cell(0, 1, 1, 3, "Spese", True), cell(1, 2, 1, 2, "Luce", True), cell(1, 2, 2, 3, "Gas", True), cell(2, 3, 0, 1, "A1"), cell(2, 3, 1, 3, "-3,00")]) + "]}"
    units = spark.createDataFrame([(1, text, html, grid), (2, None, None, None), (3, "", "", "no json")], "unit long, text string, html string, grid string")
    got = {r.table_id: r for r in statements.tables(units).collect()}
    assert set(got) == {"table_1", "html_1", "grid_1"}
    assert got["table_1"].role == "actual_payments" and (got["table_1"].period_from, got["table_1"].period_to) == ("2022-07-01", "2023-06-30")
    assert [list(x.cells) for x in got["table_1"].lines] == [["Rossi Mario (B2)", "1.000,50", "01/02/2023"]] and got["table_1"].lines[0].amounts[1] == 1000.5
    assert got["html_1"].headers == ["Voce", "A", "A / categoria", "A / 3"] and got["html_1"].table_type == "balance"
    assert [list(x.cells) for x in got["html_1"].lines] == [["Saldo & resto", "1", "2,5", ""]]
    assert got["grid_1"].headers == ["Scala", "Spese / Luce", "Spese / Gas"] and got["grid_1"].lines[0].amounts == [None, -3.0, -3.0]
    facts = statements.facts(statements.tables(units)).collect()
    assert [(r.unit_code, r.subject, r.fact_type, r.amount) for r in facts] == [("B2", "Rossi Mario", "payment_received", 1000.5)]
    assert [r.check_type for r in statements.checks(statements.tables(units)).collect()] == ["no_numeric_validation_available"]


def test_identity_and_columns(spark):
    rows = [(["Nominativo", "x"], ["Rossi Mario (A 12)", ""]), (["x"], ["- B3 VERDI ANNA - scala"]), (["Interno", "Nome"], ["C7 (box)", "Neri Ugo"]), (["x"], ["Totale (A1)"]), (["x"], [""])]
    df = spark.createDataFrame(rows, "h array<string>, c array<string>").select(statements.account_identity(F.col("h"), F.col("c")).alias("w"))
    assert [tuple(r.w) if r.w else None for r in df.collect()] == [("A12", "Rossi Mario"), ("B3", "VERDI ANNA"), ("C7", "Neri Ugo"), None, None]
    cases = [("column_2", "1,00"), ("Quota mill.", "0,123"), ("Quota mill.", "12,00"), ("Rata n. 3", "1"), ("Saldo finale", "1"), ("Totale", "1"), ("Importo", "1"), ("Acqua", "1")]
    df = spark.createDataFrame(cases, "c string, raw string").select(statements.fact_column(F.col("c"), F.lit("expense_allocation"), F.lit(False), F.col("raw")).alias("f"))
    kinds = [r.f and r.f.fact_type for r in df.collect()]
    assert kinds == [None, None, "allocated_expense", "installment_due", "closing_balance", "allocated_expense", "personal_charge", "allocated_expense"]


def _like(a, b):
    return len(a & b) / len(a | b) if a and b else 0.0


def test_merge_suggestions_against_all_pairs(spark):
    rng = random.Random(5)
    rows = []
    for topic in range(120):
        axis = list(consolidation.AXES)[topic % 3]
        some = lambda p, n, most: sorted({f"{p}{rng.randrange(n)}" for _ in range(rng.randrange(most))})  # noqa: B023, E731
        rows.append((axis, topic, rng.randrange(5), rng.choice(["quote", "tax", None]), some("e", 9, 7), ["common", *some("t", 6, 4)], some("d", 8, 6)))
    df = spark.createDataFrame(rows, "axis string, topic long, weight long, family string, entities array<string>, tokens array<string>, documents array<string>")
    got = sorted((r.axis, r.source, r.target, r.score) for r in consolidation.merge_suggestions(df, 10_000).collect())
    want = []
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            if a[0] != b[0]:
                continue
            we, wt, wd, wf, least = consolidation.AXES[a[0]]
            e, t, d = (_like(set(a[k]), set(b[k])) for k in (4, 5, 6))
            score = we * e + wt * t + wd * d + wf * (a[3] is not None and a[3] == b[3])
            if (e or t) and round(score, 6) >= least and (a[0] != "subject" or e >= 0.08 or t >= 0.34):
                target, source = (a, b) if a[2] >= b[2] else (b, a)
                want.append((a[0], source[1], target[1], round(score, 6)))
    assert got == sorted(want) and len(want) > 50


def test_merge_suggestions_of_copies_stay_linear(spark, monkeypatch):
    sizes, write = {}, consolidation.written
    monkeypatch.setattr(consolidation, "written", lambda df, name: (lambda out: (sizes.__setitem__(name, out.count()), out)[1])(write(df, name)))
    rng = random.Random(3)
    one = [(list(consolidation.AXES)[i % 3], rng.choice(["quote", None]), sorted(rng.sample([f"e{j}" for j in range(40)], 4)), rng.sample(["t1", "t2", "t3", "t4"], 2)) for i in range(12)]
    rows = [(axis, c * 12 + i, (i + c) % 3, family, e, t, [f"d{c}-{i // 2}", f"d{c}-{i}", f"d{c % 20}"]) for c in range(40) for i, (axis, family, e, t) in enumerate(one)]
    df = spark.createDataFrame(rows, "axis string, topic long, weight long, family string, entities array<string>, tokens array<string>, documents array<string>")
    got = [(r.axis, r.nth, r.source, r.target, r.score) for r in consolidation.merge_suggestions(df, 5).collect()]
    want = []
    for axis, (we, wt, wd, wf, least) in consolidation.AXES.items():
        mine, found = [r for r in rows if r[0] == axis], []
        for i, a in enumerate(mine):
            for b in mine[i + 1 :]:
                e, t, d = (_like(set(a[k]), set(b[k])) for k in (4, 5, 6))
                score = round(we * e + wt * t + wd * d + wf * (a[3] is not None and a[3] == b[3]), 6)
                if (e or t) and score >= least and (axis != "subject" or e >= 0.08 or t >= 0.34):
                    target, source = (a, b) if a[2] >= b[2] else (b, a)
                    found.append((-score, target[1], source[1]))
        want += [(axis, n, source, target, -score) for n, (score, target, source) in enumerate(sorted(found)[:5], 1)]
    assert sorted(got) == sorted(want) and len(want) == 15
    assert sizes["topic-pairs"] < 40 * len(rows)  # all pairs of copies are some 19 for each topic of the 12


def test_merge_suggestions_drop_pairs_of_few_documents(spark, monkeypatch):
    """Topics that share some documents, but too few to reach the bar, are no pair; nor is each tie of classes."""
    sizes, write = {}, consolidation.written
    monkeypatch.setattr(consolidation, "written", lambda df, name: (lambda out: (sizes.__setitem__(name, out.count()), out)[1])(write(df, name)))
    rng = random.Random(9)
    rows = [("case_or_issue", i, i % 4, None, [f"e{i // 3}", f"f{i // 6}"], ["t", f"t{i // 3}"], sorted(rng.sample([f"d{j}" for j in range(60)], 15))) for i in range(120)]
    rows[41] = (*rows[41][:6], [*rows[40][6][:14], "d99"])  # one pair shares most
    df = spark.createDataFrame(rows, "axis string, topic long, weight long, family string, entities array<string>, tokens array<string>, documents array<string>")
    got = [(r.nth, r.source, r.target, r.score) for r in consolidation.merge_suggestions(df, 5).collect()]
    found = []
    for i, a in enumerate(rows):
        for b in rows[i + 1 :]:
            e, t, d = (_like(set(a[k]), set(b[k])) for k in (4, 5, 6))
            target, source = (a, b) if a[2] >= b[2] else (b, a)
            found.append((-round(35 * e + 25 * t + 40 * d, 6), target[1], source[1]))
    assert sorted(got) == [(n, source, target, -score) for n, (score, target, source) in enumerate(sorted(found)[:5], 1)]
    some = sum(bool(set(a[6]) & set(b[6])) for i, a in enumerate(rows) for b in rows[i + 1 :])
    assert sizes["topic-pairs"] < some / 5 and sizes["first-classes"] <= 6


def test_topic_values_take_tasks_by_assignments(spark, monkeypatch):
    from collections import Counter

    from docspark.operators import topics

    rng = random.Random(8)
    held = [(rng.randrange(20), rng.randrange(90)) for _ in range(300)]
    said = [(rng.randrange(90), rng.choice(["place", "address"]), rng.choice(["a", "bb", "cc", "d"])) for _ in range(250)]
    n = Counter((t, k, x) for t, u in set(held) for w, k, x in set(said) if u == w)
    a, m = spark.createDataFrame(held, "topic long, unit long"), spark.createDataFrame(said, "unit long, kind string, value string")
    monkeypatch.setattr(topics, "ASSIGNMENTS", 20)
    found = topics.topic_values(a, m)
    assert found.rdd.getNumPartitions() == 15
    assert {(r.topic, r.kind, r.value): r.n for r in found.collect()} == n
    want = {(t, k): min((-c, -len(x), x) for (t2, k2, x), c in n.items() if (t2, k2) == (t, k)) for t, k, _ in n}
    assert {(r.topic, r.kind): (-r.n, -len(r.value), r.value) for r in topics.anchors(found).collect()} == want


def test_entities_are_counted_as_numbers(spark, monkeypatch):
    from docspark.operators import topics

    rng = random.Random(9)
    held = [(rng.randrange(20), rng.randrange(90)) for _ in range(300)]
    said = [(u := rng.randrange(90), u % 7, rng.choice(["place", "address"]), rng.choice(["a", " A ", "bb", "Bb", None])) for _ in range(250)]
    key = lambda x: x and x.strip().lower()
    want = {}
    for kind, entity in {(k, key(x)) for *_, k, x in said}:
        own = [r for r in said if (r[2], key(r[3])) == (kind, entity)]
        of = {t for t, u in held if entity is not None and u in {r[0] for r in own}}
        want[kind, entity] = (max((r[3] for r in own), key=lambda x: x or ""), len(own), len({r[1] for r in own}), len(of))
    a, m = spark.createDataFrame(held, "topic long, unit long"), spark.createDataFrame(said, "unit long, document long, kind string, value string")
    sent, written = {}, topics.written
    monkeypatch.setattr(topics, "written", lambda df, name: sent.setdefault(name, written(df, name)))
    for bound in (200_000, 0):
        monkeypatch.setattr(topics, "BROADCAST", bound)
        sent.clear()
        got = topics.entity_index(a, m).collect()
        assert {(r.kind, r.entity): (r.display, r.mentions, r.documents, r.topics) for r in got} == want and len(got) == len(want)
        assert dict(sent["units-said"].dtypes) == {"unit": "bigint", "document": "bigint", "ids": "array<bigint>"}


def test_mentions_take_tasks_by_lines(spark, sf, monkeypatch):
    from docspark import bridge

    want = bridge.view(spark, sf, "mentions")
    monkeypatch.setattr(bridge, "LINES", 500)
    got = bridge.view(spark, sf, "mentions")
    assert want.rdd.getNumPartitions() < 12 <= got.rdd.getNumPartitions()
    assert got.exceptAll(want).count() == want.exceptAll(got).count() == 0


def test_meetings_gather_values_of_meetings_once(spark, sf, monkeypatch):
    from docspark import bridge, queries
    from docspark.operators import topics

    gathered, values = [], topics.topic_values
    monkeypatch.setattr(topics, "topic_values", lambda a, m: gathered.append(a.select("topic").distinct().count()) or values(a, m))
    queries.QUERIES["cl_meeting_family"](spark, sf).count()
    meetings = bridge.view(spark, sf, "topics").where("is_active and topic_class = 'meeting'").count()
    assert len(gathered) == 1 and gathered[0] <= meetings


def test_scan_proposals_against_a_loop(spark):
    rng = random.Random(2)
    rows = [(rng.randrange(6), i, "_".join(rng.choice(["via", "roma", "verdi", "box", "tetto", "luce"]) for _ in range(rng.randrange(5)))) for i in range(150)]
    got = {r.proposal: r.kept for r in consolidation.scan_proposals(spark.createDataFrame(rows, "scan long, proposal long, anchor string")).collect()}
    groups, want = {}, {}
    for scan, proposal, anchor in rows:
        words = set(anchor.split("_")) - {"", "condominio", "via", "di", "scandicci"}
        kept = next((p for p, w in groups.get(scan, []) if words and _like(words, w) >= 0.6), None)
        if words and kept is None:
            groups.setdefault(scan, []).append((proposal, words))
        want[proposal] = proposal if kept is None else kept
    assert got == want


def test_patterns_and_matching_against_loops(spark):
    rng = random.Random(9)
    texts = [(i, "".join(rng.choice("abc ") for _ in range(rng.randrange(30)))) for i in range(80)] + [(99, None)]
    patterns = list({"".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) for _ in range(30)})
    got = {(r.id, r.pattern) for r in consolidation.scan_patterns(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame([(p,) for p in patterns], "pattern string")).collect()}
    assert got == {(i, p) for i, t in texts for p in patterns if t and p in t}

    titles = [(i, "".join(rng.choice(["red ", "blue ", "ring ", "bolt ", "gear", "gears", "geer"]) for _ in range(3))) for i in range(60)]
    titles = list({t: (i, t) for i, t in reversed(titles)}.values())
    pairs = fuzzy.title_pairs(spark.createDataFrame(titles, "topic long, title string"), 0.7)
    ratio = lambda a, b: round(difflib.SequenceMatcher(None, a, b).ratio(), 6)
    want = {(i, j, ratio(a, b)) for i, a in titles for j, b in titles if i < j and ratio(a, b) >= 0.7}
    assert {(r.a, r.b, r.score) for r in pairs.collect()} == want and want
    short = [(100 + i, "".join(rng.choice("abcde ") for _ in range(rng.randrange(1, 14)))) for i in range(150)] + [(300, "aXbcd"), (301, "abYcZd"), (302, ""), (303, "é" * 90), (304, "é" * 80 + "x" * 9)]
    kinds = {i: i % 3 for i, _ in titles + short}
    df = spark.createDataFrame([(i, t, kinds[i]) for i, t in titles + short], "topic long, title string, kind int")
    for least in (0.5, 0.7, 0.9):
        all_pairs = {(i, j, ratio(a, b)) for i, a in titles + short for j, b in titles + short if i < j and ratio(a, b) >= least}
        assert {(r.a, r.b, r.score) for r in fuzzy.title_pairs(df, least).collect()} == all_pairs and all_pairs
        assert {(r.a, r.b, r.score) for r in fuzzy.title_pairs(df, least, apart="kind").collect()} == {x for x in all_pairs if kinds[x[0]] != kinds[x[1]]}
    used, best = set(), set()
    for i, j, s in sorted(want, key=lambda x: (-x[2], x[0], x[1])):
        if not {i, j} & used:
            used |= {i, j}
            best.add((i, j, s))
    assert {(r.a, r.b, r.score) for r in fuzzy.matched(pairs).collect()} == best


def test_retrieval_rules(spark):
    units = spark.createDataFrame([(1, "Verbale tetto", "perdita tetto", "verbale_assemblea"), (2, None, None, None)], "unit long, title string, summary string, document_type string")
    entities = spark.createDataFrame([(1, "address", "Via Roma 3", "via_roma_3")], "unit long, kind string, value string, normalized string")
    topics = [(1, "Tetto Via Roma", "tetto-via-roma", "perdita", "meeting", "issue", True), (2, "Tetto Via Verdi", "tetto-via-verdi", None, "meeting", "issue", True), (3, "Fattura 12 tetto", "fattura", None, "other", "entity", True), (4, "Tetto", "tetto", None, "other", "issue", False)]
    topics = spark.createDataFrame(topics, "topic long, title string, slug string, description string, topic_class string, topic_kind string, is_active boolean")
    got = {(r.unit, r.topic): (r.points, r.nth) for r in consolidation.retrieved(units, entities, topics, spark.createDataFrame([(1, 5)], "topic long, n long")).collect()}
    # 30 title, 25 slug, 10 summary in title, 5 in description, 10 class; the other street conflicts, the bill counts half
    assert got == {(1, 1): (80.0, 1), (1, 3): (20.0, 2)}


def test_bill_edges(spark):
    rows = [(1, "Publiacqua\nEntro il 3 mar 24\nScad. 01/02/2023\nQuanto devo pagare?\n-12,30\nnon pagata"), (2, None), (3, "Totale bolletta 1.234,00 data di emissione 7 giugno 1999")]
    got = {r.unit: r for r in bills.bill_fields(spark.createDataFrame(rows, "unit long, text string")).collect()}
    assert (got[1].issuer, got[1].due_date, got[1].total, got[1].payment_status) == ("Publiacqua", "2024-03-03", -12.3, "unpaid")
    assert got[2].issuer is None and got[2].total is None and got[2].payment_status == "unknown"
    assert (got[3].total, got[3].issue_date) == (1234.0, "1999-06-07")


def test_pages_edges(spark):
    rows = [(1, 1, "# Verbale\nassemblea"), (1, 2, None), (1, 3, "FATTURA LUCE\nfattura preventivo"), (2, 5, "x")]
    got = {(r.scan, r.page): (r.score, r.boundary) for r in pages.boundaries(spark.createDataFrame(rows, "scan long, page int, text string")).collect()}
    assert got == {(1, 1): (0, True), (1, 2): (0, False), (1, 3): (12, True), (2, 5): (0, True)}
    found = pages.segments(pages.boundaries(spark.createDataFrame(rows, "scan long, page int, text string"))).collect()
    assert {(r.scan, r.start_page, r.end_page, r.confidence) for r in found} == {(1, 1, 2, 10), (1, 3, 3, 8), (2, 5, 5, 9)}
    content = [(1, 1, '```json\n[{"category": "Page-Header", "text": " a "}, {"category": "table", "content": "t"}]\n```'), (1, 2, "nothing"), (1, 3, '{"category": "Title", "text": "x", "bbox": [1, 2, 3, 4]}'), (1, 4, None)]
    got = [(r.page, r.type, r.id, r.text, r.x1) for r in pages.layout_elements(spark.createDataFrame(content, "scan long, page int, content string")).orderBy("page", "nth").collect()]
    assert got == [(1, "paragraph", "page-1-block-1", "a", None), (1, "table", "page-1-table-1", "t", None), (3, "heading", "page-3-block-1", "x", 3.0)]
    texts = spark.createDataFrame([(1, "a\nb\nc\nd\ne", 2), (2, "one", 3)], "scan long, text string, page_count int")
    assert [(r.scan, r.page, r.text) for r in pages.markdown_pages(texts).orderBy("scan", "page").collect()] == [(1, 1, "a\nb"), (1, 2, "c\nd"), (2, 1, "one"), (2, 2, ""), (2, 3, "")]


def test_specialists(spark):
    rows = [("bolletta", ""), ("fattura", "gas acqua pod"), ("fattura", "gas"), (None, "rendiconto riparto importi totali"), ("lettera", "x")]
    df = spark.createDataFrame(rows, "k string, t string").select(rules.specialists(F.col("k"), F.col("t")).alias("s"))
    assert [list(r.s) for r in df.collect()] == [["utility_bill"], ["utility_bill"], [], ["accounting_statement"], []]


def test_statements_are_read_once(spark, sf):
    """Nothing is written on the way, and texts, cells and names are parsed in one place of the plan each."""
    from docspark.bridge import view
    from docspark.plans import storage

    before = set(os.listdir(storage.shared_dir(spark))) if os.path.isdir(storage.shared_dir(spark)) else set()
    found = statements.tables(view(spark, sf, "statements"))
    facts = statements.facts(found)
    assert not [x for x in set(os.listdir(storage.shared_dir(spark))) - before if x.startswith("statement-")]
    plan = facts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1
    assert facts.select("unit").distinct().count() == found.select("unit").distinct().count() > 0


def test_entity_detail_gathers_no_set_of_documents(spark, sf):
    """A place that every document names keeps five of them, not a set of all."""
    from docspark.queries import QUERIES

    plan = QUERIES["join_entity_detail"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "WindowGroupLimit" in plan


def test_equal_word_sets_are_compared_once(spark):
    """Sixty topics of two alike sets make two items of an axis, and all their pairs, against plain loops."""
    words = {i: ["alpha", "beta", "delta"] + (["gamma"] if i % 2 else []) for i in range(60)} | {60: [], 61: [], 62: ["solo"]}
    df = spark.createDataFrame([(i, "x" if i != 3 else "y", w) for i, w in words.items()], "topic long, axis string, tokens array<string>")
    asked = []
    compared, kept = consolidation.similar_pairs, lambda profiles, least: asked.append(profiles.count()) or compared(profiles, least)
    consolidation.similar_pairs = kept
    try:
        got = {(r.a, r.b): (round(r.score, 6), r.shared) for r in consolidation.alike_sets(df, 6).collect()}
    finally:
        consolidation.similar_pairs = compared
    alike = lambda a, b: len(set(a) & set(b)) / len(set(a) | set(b))
    want = {(a, b): (round(alike(words[a], words[b]), 6), sorted(set(words[a]) & set(words[b]))) for a in range(60) for b in range(a + 1, 60) if 3 not in (a, b)}
    assert got == want and asked == [4]


def test_tables_read_only_what_is_asked_for(spark, sf):
    from docspark import bridge
    from docspark.operators import statements

    units = bridge.view(spark, sf, "statements").limit(20)
    whole, bare = statements.tables(units), statements.tables(units, about=False, amounts=False)
    same = ["unit", "position", "source", "table_id", "table_type", "headers"]
    assert sorted(map(str, whole.select(*same).collect())) == sorted(map(str, bare.select(*same).collect()))
    assert bare.where("role is not null or period_from is not null or exists(lines, r -> r.amounts is not null)").count() == 0
    assert whole.schema.simpleString() == bare.schema.simpleString()


def test_bill_links_meet_by_kind(spark, monkeypatch):
    from docspark.operators import bills

    sizes, write = {}, bills.written
    monkeypatch.setattr(bills, "written", lambda df, name: (lambda out: (sizes.__setitem__(name, out.count()), out)[1])(write(df, name)))
    fields = spark.createDataFrame([(i, f"BL{i:08}", "Enel Servizio" if i % 7 else None, "1999-01-01", "1999-01-31") for i in range(60)], "unit long, number string, issuer string, period_from string, period_to string")
    hays = [(i, "fattura" if i % 2 else None, "enel dettaglio pagamento 1999-01-01" if i % 3 else f"protbl{i - 3:08}bis mav") for i in range(90)]
    got = {(r.unit, r.nth): (r.other, r.points, r.link_type) for r in bills.bill_links(fields, spark.createDataFrame(hays, "unit long, document_type string, haystack string")).collect()}
    want = {}
    for i in range(60):
        found = []
        for other, _, text in hays:
            points = 55 * (f"bl{i:08}" in text) + 25 * ("enel" in text and i % 7 > 0) + 10 * ("1999-01-01" in text) + 12 * ("dettaglio" in text) + 14 * ("pagamento" in text or "mav" in text)
            if other != i and points >= 45:
                found.append((-points, other))
        want |= {(i, n): (other, -points, "utility_bill_payment") for n, (points, other) in enumerate(sorted(found)[:5], 1)}
    assert got == want and sizes["links-of-kinds"] <= 12  # six for each of two kinds, not 60 for each bill


def test_equal_word_sets_are_spread_in_parts(spark, monkeypatch):
    """The pairs of 300 topics of one set are made by many tasks, none of which makes most of them."""
    from collections import Counter

    monkeypatch.setattr(consolidation, "MEMBERS", 20)
    monkeypatch.setattr(consolidation, "SPREAD", 2_000)
    df = spark.createDataFrame([(i, "x", ["alpha", "beta"] + (["gamma"] if i == 7 else [])) for i in range(300)], "topic long, axis string, tokens array<string>")
    got = consolidation.alike_sets(df, 6).select("a", "b", "score", F.size("shared").alias("shared"), F.spark_partition_id().alias("task")).collect()
    assert sorted((r.a, r.b) for r in got) == [(a, b) for a in range(300) for b in range(a + 1, 300)]
    assert all(r.shared == 2 and round(r.score, 6) == (0.666667 if 7 in (r.a, r.b) else 1.0) for r in got)
    made = Counter(r.task for r in got)
    assert len(made) > 8 and max(made.values()) < len(got) / 4


def test_bill_links_make_units_once(spark, monkeypatch):
    """Units are made and marked once, whether words and dates are asked for one by one or by an index, and numbers by either way of it."""
    from docspark.operators import bills

    fields = spark.createDataFrame([(i, f"BL{i:08}", "Enel Servizio" if i % 7 else None, "1999-01-01", "1999-01-31") for i in range(40)], "unit long, number string, issuer string, period_from string, period_to string")
    hays = [(i, "fattura" if i % 2 else None, "enel dettaglio pagamento 1999-01-01" if i % 3 else f"x protbl{i - 3:08}bis mav 00") for i in range(60)]
    made = spark.sparkContext.accumulator(0)

    def said(text):
        made.add(1)
        return text

    units = spark.createDataFrame(hays, "unit long, document_type string, haystack string").withColumn("haystack", F.udf(said, "string").asNondeterministic()("haystack"))
    got = []
    for signs, grams in ((500, 200_000), (0, 0)):
        monkeypatch.setattr(bills, "SIGNS", signs, raising=False)
        monkeypatch.setattr(consolidation, "BROADCAST_GRAMS", grams)
        before = made.value
        got.append(sorted((r.unit, r.nth, r.other, r.points, r.link_type) for r in bills.bill_links(fields, units).collect()))
        assert made.value - before == len(hays)
    assert got[0] == got[1] and any(points == 69 for *_, points, _ in got[0])


def test_canonical_merge_gathers_no_common_key(spark, monkeypatch):
    """Mentions aren't sorted, expanded or joined by their key; entities without a mention stay."""
    variants = spark.createDataFrame([(1, "place", "a"), (1, "place", "b"), (2, "place", "c"), (3, "place", "d"), (3, "place", None)], "canonical int, kind string, key string")
    decisions = spark.createDataFrame([(2, "place", "b", 1), (4, "place", "b", 2), (4, "place", "e", 1)], "canonical int, kind string, key string, nth int")
    said = [("place", "a", f"A{i % 3}", i) for i in range(300)] + [("place", "b", "B", 7), ("place", "b", "B", None), ("place", "e", "E", 7), ("place", "zz", "Z", 9), ("place", None, "N", 1)]
    mentions = spark.createDataFrame(said, "kind string, key string, value string, document long")
    want = {1: ("A2", 1, 300), 2: (None, 1, 0), 3: (None, 1, 0), 4: ("E", 2, 1)}
    for keys in (200_000, 0):
        monkeypatch.setattr(consolidation, "BROADCAST_KEYS", keys, raising=False)
        df = consolidation.canonical_merged(variants, decisions, mentions)
        assert {r.canonical: (r.display, r.variants, r.documents) for r in df.collect()} == want
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert "Expand" not in plan


def test_corrections_parse_statements_once(spark, sf, monkeypatch):
    """What corrections, single accounts and old facts are read from is written; nothing parses statements again."""
    from docspark import queries, queries_rules

    parsed, write = [], queries_rules.written
    spy = lambda df, name: parsed.append(df._jdf.queryExecution().optimizedPlan().toString().count("from_json")) or write(df, name)
    monkeypatch.setattr(queries_rules, "written", spy)
    plan = queries.QUERIES["join_corrections"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "from_json" not in plan and parsed == [1]


def test_cleanup_counts_dominant_values_once(spark, sf, monkeypatch):
    """Dominant values are counted where the topic is, without a shuffle of counts, and only once for all findings."""
    from docspark import queries, queries_knowledge

    kept, write = [], queries_knowledge.written
    monkeypatch.setattr(queries_knowledge, "written", lambda df, name: kept.append(df) or write(df, name))
    plan = queries.QUERIES["agg_cleanup_summary"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert len(kept) == 1 and "ordinal" not in plan
    values = spark.createDataFrame([(i % 5, "a" if i % 3 else "b", None) for i in range(60)], "topic long, x string, y string")
    df = rules.dominant(values, ["x", "y"], 3)
    assert sorted(tuple(r) for r in df.collect()) == [(i, "a", None) for i in range(5)]
    assert df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1].count("Exchange") == 1
