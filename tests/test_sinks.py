"""Artifacts, exports and reports read again as they were written; OCR results of several files; a relational archive; duplicate titles."""

import base64
import csv
import difflib
import io
import json
import random
import re

import pytest
from pyspark.sql import functions as F

from docspark.operators import clustering
from docspark.sources import archive


def test_artifacts_are_found_by_their_place(spark, tmp_path):
    dice = random.Random(1)
    rows = [(f"d{i}", f"v{j}", n, "".join(dice.choice("ab\n\té😀{}\"") for _ in range(dice.randint(0, 200)))) for i in range(40) for j in (1, 2) for n in ("result.md", "result.json")]
    df = spark.createDataFrame([*rows, ("d1", "v1", "null", None), (None, "v", "n", "x"), ("d0", "v1", "result.md", "")], "document string, version string, name string, content string")
    path = str(tmp_path / "out")
    archive.write_artifacts(df.withColumn("code", F.lit("clash")), path, buckets=4)
    assert sorted(map(tuple, archive.read_artifacts(spark, path).collect())) == sorted(rows)
    index = {(r.document, r.version, r.name): r for r in spark.read.parquet(f"{path}/index").collect()}
    assert len(index) == len(rows)
    files = {int(f.parent.name[7:]): f.read_bytes() for f in (tmp_path / "out/files").glob("bucket=*/part-*")}
    assert len(files) <= 4  # not a file a document
    for document, version, name, content in rows:
        at = index[document, version, name]
        assert base64.b64decode(files[at.bucket][at.offset : at.offset + at.length]).decode() == content
    assert archive.read_artifact(spark, path, *rows[5][:3]) == rows[5][3] and archive.read_artifact(spark, path, "no", "v1", "x") is None


def test_ocr_results_of_three_files(spark, tmp_path):
    def put(document, version, **files):
        folder = tmp_path / f"a/{document}/{version}/ocr"
        folder.mkdir(parents=True)
        for kind, text in files.items():
            (folder / f"result.{kind}").write_text(text)

    block = lambda i, order: {"id": f"b{i}", "type": "paragraph", "reading_order": order, "text": f"t{i}", "prov": [{"page_no": 1}]}
    pages = [{"page_number": 1, "text": "one", "confidence": 0.5, "blocks": [block(1, 2), block(2, 1)], "tables": [{"table_id": "t1", "html": "<table/>"}]}, {"page_no": 2, "markdown": "two"}]
    whole = {"page_count": 2, "full_text": "json text", "markdown_text": "json md", "confidence_summary": {"mean": 0.7}, "pages": pages, "tables": [{"table_id": "t2", "prov": [{"page_no": 2}, {"page_no": 3}]}]}
    put("d1", "v1", json=json.dumps(whole, indent=2), md="# md\nfile")
    put("d1", "v2", txt="only\ntext")
    put("d2", "v1", json="{broken")
    (tmp_path / "a/d2/v1/ocr/other.json").write_text("{}")
    found = archive.ocr_results(spark, str(tmp_path / "a"))
    got = {(r.document, r.version): r for r in found.collect()}
    one = got["d1", "v1"]
    assert (one.markdown, one.full_text, one.page_count, one.ok, one.confidence["mean"]) == ("# md\nfile", "json text", 2, True, "0.7")
    assert (got["d1", "v2"].full_text, got["d1", "v2"].pages, got["d1", "v2"].ok) == ("only\ntext", None, True)
    assert set(got) == {("d1", "v1"), ("d1", "v2"), ("d2", "v1")} and not got["d2", "v1"].ok
    assert [(r.page, r.text, r.markdown, r.confidence, r.blocks and [b.id for b in r.blocks]) for r in archive.result_pages(found).orderBy("page").collect()] == [(1, "one", None, 0.5, ["b2", "b1"]), (2, None, "two", None, None)]
    assert sorted((r.table, r.page, r.places) for r in archive.result_tables(found).collect()) == [("t1", 1, None), ("t2", None, [2, 3])]


def python_csv(kind, payload):
    out = io.StringIO()
    w = csv.writer(out)
    if kind != "accounting_statement":
        w.writerow(["field", "value"])
        for k, v in payload.items():
            w.writerow([k, json.dumps(v, separators=(",", ":")) if isinstance(v, (list, dict)) else v])
        return out.getvalue()
    for t in payload.get("tables", []):
        w.writerow([f"table_id={t.get('table_id', '')}", f"table_type={t.get('table_type', '')}"])
        heads = t.get("headers", [])
        if heads:
            w.writerow(heads)
        for r in t.get("rows", []):
            w.writerow([str(r["cells"].get(h, "")) for h in heads])
        w.writerow([])
    if payload.get("validation_checks"):
        w.writerow(["validation_checks"])
        w.writerow(["check_type", "status", "details"])
        for c in payload["validation_checks"]:
            w.writerow([c.get("check_type", ""), c.get("status", ""), c.get("details", "")])
    return out.getvalue()


def test_exports_round_trip(spark, tmp_path):
    cells = lambda **c: {"cells": c}
    tables = [{"table_id": "t1", "table_type": "riparto", "headers": ["Voce", "Importo, EUR"], "rows": [cells(**{"Voce": 'a "b"', "Importo, EUR": "1,5"}), cells(Voce="x\ny"), cells()]}, {"table_id": "t2", "headers": ["one"], "rows": [cells(), cells(one="z")]}, {"table_type": "bare"}]
    results = [
        (1, "accounting_statement", {"tables": tables, "validation_checks": [{"check_type": "sum", "status": "failed", "details": "off, by 1"}, {"status": "ok"}]}),
        (2, "accounting_statement", {"tables": []}),
        (3, "utility_bill", {"issuer": "Acque, S.p.A.", "total": 12.5, "none": None, "lines": [1, {"a": "b"}], "text": 'q"uote'}),
        (4, "utility_bill", {}),
    ]
    df = spark.createDataFrame([(i, k, json.dumps(p)) for i, k, p in results], "result long, specialist_type string, result_json string")
    archive.export_specialist(df, str(tmp_path / "csv"), buckets=2)
    got = {int(r.document): r for r in archive.read_artifacts(spark, str(tmp_path / "csv")).collect()}
    for i, kind, payload in results:
        assert got[i].content == python_csv(kind, payload), i
        assert got[i].name == f"{kind}-{i}.csv" and got[i].version == kind
    archive.export_specialist(df, str(tmp_path / "json"), "json")
    assert {int(r.document): json.loads(r.content) for r in archive.read_artifacts(spark, str(tmp_path / "json")).collect()} == {i: p for i, _, p in results}


def test_report_with_every_category_in_its_summary(spark, tmp_path):
    findings = spark.createDataFrame([("near_orphans", 1, "a"), ("near_orphans", 2, "b"), ("probable_typos", 3, "c")], "category string, topic long, note string")
    archive.write_report(findings, 10, 20, str(tmp_path))
    assert sorted((r.category, r.topic, r.note) for r in spark.read.json(str(tmp_path / "findings")).collect()) == [("near_orphans", 1, "a"), ("near_orphans", 2, "b"), ("probable_typos", 3, "c")]
    summary = json.loads(next((tmp_path / "summary").glob("part-*")).read_text())
    assert summary == {"total_active_topics": 10, "total_assignments": 20, "near_orphans_count": 2, "duplicate_title_groups": 0, "shared_axis_groups": 0, "probable_typo_pairs": 1, "kind_mismatches_count": 0}
    archive.write_report(findings.limit(0), 0, 0, str(tmp_path))
    assert json.loads(next((tmp_path / "summary").glob("part-*")).read_text())["near_orphans_count"] == 0


def test_jdbc_bounds_are_asked_of_the_archive(spark, monkeypatch):
    """Without a database at hand: what the reader is asked for."""
    asked = []

    class Reader:
        def __init__(self, low, high):
            self.bounds = (low, high)

        def options(self, **_):
            return self

        def jdbc(self, url, table, **more):
            asked.append((table, more))
            return self

        def first(self):
            return self.bounds

    class Session:
        def __init__(self, *bounds):
            self.read = Reader(*bounds)

    archive.jdbc_table(Session(3, 9), "jdbc:x", "units", "id")
    archive.jdbc_table(Session(None, None), "jdbc:x", "units", "id")
    archive.jdbc_table(Session(0, 0), "jdbc:x", "units", "id", 1, 5, 2)
    assert asked[1] == ("units", {"column": "id", "lowerBound": 3, "upperBound": 10, "numPartitions": 32}) and "min(id)" in asked[0][0]
    assert asked[3] == ("units", {}) and asked[4] == ("units", {"column": "id", "lowerBound": 1, "upperBound": 6, "numPartitions": 2})


@pytest.mark.parametrize("least", [0.9, 0.75])
def test_duplicate_titles_in_order_of_titles(spark, least):
    dice = random.Random(4)
    words = ["verbale", "verbali", "assemblea", "assemblee", "2021", "2022", "tetto", "Tetti"]
    rows = [(500 - i, " ".join(dice.choice(words) + dice.choice(["", "", ".", "!"]) for _ in range(dice.randint(1, 4)))) for i in range(120)] + [(900, ""), (901, "..."), (902, None)]
    norm = lambda t: re.sub(r"\s+", " ", re.sub(r"[^\w\s]", "", (t or "").lower())).strip()
    want, used = {}, set()
    ordered = sorted(rows, key=lambda r: (r[1] or "", r[0]))
    for i, a in ordered:
        if i not in used:
            for j, b in ordered:
                if j not in used and (i == j or round(difflib.SequenceMatcher(None, norm(a), norm(b)).ratio(), 6) >= least):
                    want[j] = i
                    used.add(j)
    got = clustering.duplicate_titles(spark.createDataFrame(rows, "topic long, title string").withColumn("node", F.lit("clash")), least)
    assert {r.topic: r.leader for r in got.collect()} == want and len(set(want.values())) < len(rows)
