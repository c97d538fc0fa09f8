"""Readers and writers of the archive: PDF folders, OCR results, tables, artifacts and exports."""

from __future__ import annotations

import base64

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from docspark.plans.storage import written
from docspark.sources.versioned import merge_into

#: Largest accepted upload.
MAX_BYTES = 50 * 1024 * 1024
OCR = "document_id string, page_count int, pages array<struct<page_number int, text string, blocks array<struct<id string, type string, reading_order int, text string>>>>"


def pdf_files(spark: SparkSession, path: str, max_bytes: int = MAX_BYTES) -> DataFrame:
    """Every ``*.pdf`` below a folder: path, size, sha256, and ok or the reason for rejection."""
    df = spark.read.format("binaryFile").option("pathGlobFilter", "*.pdf").option("recursiveFileLookup", "true").load(path)
    status = F.when(F.col("length") > max_bytes, "too_large").when(F.left(F.col("content").cast("string"), F.lit(5)) != "%PDF-", "not_pdf").otherwise("ok")
    return df.select("path", F.col("length").alias("size_bytes"), F.sha2("content", 256).alias("sha256"), status.alias("status"))


def ocr_json(spark: SparkSession, path: str) -> DataFrame:
    """OCR results, one JSON document a file, as one row a page."""
    df = spark.read.schema(OCR).option("multiLine", "true").json(path)
    return df.select("document_id", "page_count", F.explode("pages").alias("p")).select("document_id", "page_count", "p.page_number", "p.text", "p.blocks")


#: What a result holds besides: tables with their places, provenance of blocks, and confidence of the whole and of pages.
RESULT = (
    "page_count int, full_text string, markdown_text string, confidence_summary map<string,string>, "
    "pages array<struct<page_number int, page_no int, text string, markdown string, confidence double, blocks array<struct<id string, type string, reading_order int, text string, prov array<struct<page_no int>>>>, "
    "tables array<struct<table_id string, page_number int, page_no int, html string, prov array<struct<page_no int>>>>>>, "
    "tables array<struct<table_id string, page_number int, page_no int, html string, prov array<struct<page_no int>>>>"
)


def ocr_results(spark: SparkSession, path: str) -> DataFrame:
    """One row for every ``<document>/<version>/ocr`` below ``path``: document, version, markdown, full_text, page_count, pages,
    tables, confidence, ok.

    ``result.json``, ``result.md`` and ``result.txt`` of one result are read together; the files count before what the JSON
    holds. A result without JSON has no pages; one whose JSON can't be read isn't ok."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "result.{json,md,txt}").text(path, wholetext=True)
    place = F.split(F.col("_metadata.file_path"), "/")
    at = lambda n: F.element_at(place, -n)
    rows = files.select(at(4).alias("document"), at(3).alias("version"), at(2).alias("folder"), F.regexp_extract(at(1), "[.]([a-z]+)$", 1).alias("kind"), F.col("value").alias("text")).where("folder = 'ocr'")
    own = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("text"))).alias(kind)
    one = rows.groupBy("document", "version").agg(own("json"), own("md"), own("txt")).withColumn("r", F.from_json("json", RESULT))
    known = F.col("json").isNull() | F.coalesce(F.col("r.page_count").isNotNull() | F.col("r.pages").isNotNull() | F.col("r.full_text").isNotNull(), F.lit(False))
    return one.select("document", "version", F.coalesce("md", "r.markdown_text").alias("markdown"), F.coalesce("txt", "r.full_text").alias("full_text"), "r.page_count", "r.pages", "r.tables", F.col("r.confidence_summary").alias("confidence"), known.alias("ok"))


def result_pages(results: DataFrame) -> DataFrame:
    """(document, version, page, markdown, text, confidence, blocks) of every page of ``ocr_results``; blocks in reading order."""
    page = results.select("document", "version", F.explode("pages").alias("p"))
    blocks = F.array_sort("p.blocks", lambda a, b: F.coalesce(a["reading_order"], F.lit(0)) - F.coalesce(b["reading_order"], F.lit(0)))
    return page.select("document", "version", F.coalesce("p.page_number", "p.page_no").alias("page"), "p.markdown", "p.text", "p.confidence", blocks.alias("blocks"))


def result_tables(results: DataFrame) -> DataFrame:
    """(document, version, table, page, places, html) of the tables of whole results and of their pages; a page's tables lie on it
    unless they say otherwise, and places are the pages of their provenance."""
    whole = results.select("document", "version", F.lit(None).cast("int").alias("on"), F.explode("tables").alias("t"))
    paged = results.select("document", "version", F.explode("pages").alias("p")).select("document", "version", F.coalesce("p.page_number", "p.page_no").alias("on"), F.explode("p.tables").alias("t"))
    df = whole.unionByName(paged)
    places = F.filter(F.transform("t.prov", lambda x: x["page_no"]), lambda x: x.isNotNull())
    return df.select("document", "version", F.col("t.table_id").alias("table"), F.coalesce("t.page_number", "t.page_no", "on").alias("page"), places.alias("places"), "t.html")


def jdbc_table(spark: SparkSession, url: str, table: str, column: str, low: int | None = None, high: int | None = None, parts: int = 32, **options: str) -> DataFrame:
    """A table of the relational archive, read in ranges of a numeric column; bounds that aren't given are asked of the archive."""
    reader = spark.read.options(**options)
    if low is None or high is None:
        low, high = reader.jdbc(url, f"(select min({column}) as low, max({column}) as high from {table}) as bounds").first()
        if low is None:
            return reader.jdbc(url, table)
    return reader.jdbc(url, table, column=column, lowerBound=int(low), upperBound=int(high) + 1, numPartitions=parts)


def replace_units(df: DataFrame, path: str, key: str = "unit", units: DataFrame | None = None, buckets: int = 64, applied: tuple[str, int] | None = None) -> int:
    """Replace the rows of ``units`` (by default those in ``df``) in the versioned table below ``path`` by the rows of ``df``;
    returns the version. Only buckets that a unit falls into are rewritten. A unit without new rows loses its old ones.
    ``applied`` names a stream and its batch, which counts once."""
    keys = (df if units is None else units).select(key).distinct()
    return merge_into(df, path, key, lambda old, new: new if old is None else old.join(keys, key, "left_anti").select(*new.columns).unionByName(new), buckets, keys, applied)


def write_artifacts(df: DataFrame, path: str, buckets: int = 64) -> None:
    """Artifacts (document, version, name, content) in ``buckets`` large files, with an index of where each lies.

    An artifact is a line of its bucket's file: document, version, name and the base64 of its content, parted by tabs. The index below
    ``path`` has document, version, name, bucket, offset and length of the content in the file. A bucket is sorted by one
    task, whatever the number of documents. Null contents and documents are left out; of several artifacts of one name the greatest counts."""
    one = df.where("content is not null and document is not null").withColumns({c: F.coalesce(c, F.lit("")) for c in ("version", "name")}).groupBy("document", "version", "name").agg(F.max("content").alias("content"))
    one = one.withColumn("bucket", F.pmod(F.xxhash64("document"), F.lit(buckets)).cast("int"))
    clean = lambda c: F.regexp_replace(F.col(c).cast("string"), "[\\t\\r\\n]", " ")
    head = F.concat(F.concat_ws("\t", clean("document"), clean("version"), clean("name")), F.lit("\t"))
    lines = one.select("bucket", "document", "version", "name", head.alias("head"), F.regexp_replace(F.base64(F.col("content").cast("binary")), r"\s", "").alias("code"))
    lines = written(lines.repartition("bucket").sortWithinPartitions("bucket", "document", "version", "name"), "artifact-lines")
    order = Window.partitionBy("bucket").orderBy("document", "version", "name")
    size = F.octet_length("head") + F.octet_length("code") + 1
    before = F.coalesce(F.sum(size).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    index = lines.select("document", "version", "name", "bucket", (before + F.octet_length("head")).alias("offset"), F.octet_length("code").alias("length"))
    index.write.mode("overwrite").parquet(f"{path}/index")
    sorted_lines = lines.repartition("bucket").sortWithinPartitions("bucket", "document", "version", "name")
    sorted_lines.select("bucket", F.concat("head", "code").alias("line")).write.mode("overwrite").option("lineSep", "\n").partitionBy("bucket").text(f"{path}/files")


def read_artifact(spark: SparkSession, path: str, document: str, version: str, name: str) -> str | None:
    """One artifact's content: its place from the index, its bytes from the file."""
    at = spark.read.parquet(f"{path}/index").where((F.col("document") == document) & (F.col("version") == version) & (F.col("name") == name)).first()
    if at is None:
        return None
    fs_path = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/files/bucket={at.bucket}")
    fs = fs_path.getFileSystem(spark._jsc.hadoopConfiguration())
    file = next(s.getPath() for s in fs.listStatus(fs_path) if s.getPath().getName().startswith("part-"))
    stream = fs.open(file)
    try:
        stream.seek(at.offset)
        return base64.b64decode(bytes(stream.readNBytes(at.length))).decode()
    finally:
        stream.close()


def read_artifacts(spark: SparkSession, path: str) -> DataFrame:
    """All artifacts: document, version, name, content."""
    parts = F.split("value", "\t")
    return spark.read.text(f"{path}/files").select(*(parts[i].alias(c) for i, c in enumerate(("document", "version", "name"))), F.unbase64(parts[3]).cast("string").alias("content"))


def result_artifacts(results: DataFrame) -> DataFrame:
    """The artifacts of OCR results (document, version, markdown, full_text, result, preflight, refinement; the last three JSON texts):
    ``result.md``, ``result.txt``, ``result.json``, and ``preflight.json`` and ``ocr_refinement.json`` where there are any."""
    names = {"result.md": "markdown", "result.txt": "full_text", "result.json": "result", "preflight.json": "preflight", "ocr_refinement.json": "refinement"}
    each = F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.col(c).alias("content")) for n, c in names.items()))).alias("a")
    return results.select("document", "version", each).select("document", "version", "a.name", "a.content").where("content is not null")


#: Categories of a cleanup report, and what its summary calls their numbers.
CATEGORIES = {
    "near_orphans": "near_orphans_count",
    "duplicate_titles": "duplicate_title_groups",
    "shared_identity_axis": "shared_axis_groups",
    "probable_typos": "probable_typo_pairs",
    "kind_mismatches": "kind_mismatches_count",
}


def write_report(findings: DataFrame, topics: int, assignments: int, path: str) -> None:
    """Findings (category, and any other columns) as JSON by category below ``path/findings``, and a summary of one object in ``path/summary``
    with the number of each category, also of those without findings, and of ``topics`` and ``assignments``."""
    findings.write.mode("overwrite").partitionBy("category").json(f"{path}/findings")
    n = findings.groupBy().agg(*(F.count_if(F.col("category") == c).alias(name) for c, name in CATEGORIES.items()))
    n.select(F.lit(topics).cast("long").alias("total_active_topics"), F.lit(assignments).cast("long").alias("total_assignments"), *CATEGORIES.values()).coalesce(1).write.mode("overwrite").json(f"{path}/summary")


STATEMENT = "tables array<struct<table_id string, table_type string, headers array<string>, rows array<struct<cells map<string,string>>>>>, validation_checks array<struct<check_type string, status string, details string>>"


def _line(cells: Column) -> Column:
    """A CSV line of an array of texts: quotes where they are needed, and around a single empty text."""
    quoted = F.transform(cells, lambda x: F.when(F.coalesce(x, F.lit("")).rlike('[",\\r\\n]'), F.concat(F.lit('"'), F.replace(x, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(F.coalesce(x, F.lit(""))))
    alone = (F.size(cells) == 1) & (F.coalesce(cells[0], F.lit("")) == "")
    return F.concat(F.when(alone, '""').otherwise(F.array_join(quoted, ",")), F.lit("\r\n"))


def specialist_exports(results: DataFrame, kind: str = "csv") -> DataFrame:
    """(result, specialist_type, name, content) of specialists' results (result, specialist_type, result_json), to be written as artifacts.

    JSON is the result as it is. CSV of a statement is a block for each table (its id and type, its headers, its rows in
    the headers' order, an empty line) and then its checks; of any other result, fields and values, nested ones as JSON."""
    name = F.concat(F.col("specialist_type"), F.lit("-"), F.col("result").cast("string"), F.lit(f".{kind}"))
    df = results.select("result", "specialist_type", name.alias("name"), F.coalesce("result_json", F.lit("{}")).alias("json"))
    if kind == "json":
        return df.select("result", "specialist_type", "name", F.col("json").alias("content"))
    df = df.withColumn("s", F.from_json("json", STATEMENT)).withColumn("m", F.from_json("json", "map<string,string>"))
    text = lambda x: F.coalesce(x, F.lit(""))

    def block(t: Column) -> Column:
        first = _line(F.array(F.concat(F.lit("table_id="), text(t["table_id"])), F.concat(F.lit("table_type="), text(t["table_type"]))))
        heads = F.coalesce(t["headers"], F.array().cast("array<string>"))
        rows = F.transform(F.coalesce(t["rows"], F.array().cast("array<struct<cells:map<string,string>>>")), lambda r: F.when(F.size(heads) == 0, "\r\n").otherwise(_line(F.transform(heads, lambda h: F.try_element_at(r["cells"], h)))))
        return F.concat(first, F.when(F.size(heads) > 0, _line(heads)).otherwise(""), F.array_join(rows, ""), F.lit("\r\n"))

    checks = F.transform("s.validation_checks", lambda c: _line(F.array(c["check_type"], c["status"], c["details"])))
    checked = F.when(F.size("s.validation_checks") > 0, F.concat(F.lit("validation_checks\r\ncheck_type,status,details\r\n"), F.array_join(checks, ""))).otherwise("")
    statement = F.concat(text(F.array_join(F.transform("s.tables", block), "")), checked)
    fields = F.concat(F.lit("field,value\r\n"), text(F.array_join(F.transform(F.map_entries("m"), lambda e: _line(F.array(e["key"], e["value"]))), "")))
    return df.select("result", "specialist_type", "name", F.when(F.col("specialist_type") == "accounting_statement", statement).otherwise(fields).alias("content"))


def export_specialist(results: DataFrame, path: str, kind: str = "csv", buckets: int = 64) -> None:
    """Exports of specialists' results as artifacts below ``path``: document is the result, version its specialist."""
    rows = specialist_exports(results, kind)
    write_artifacts(rows.select(F.col("result").cast("string").alias("document"), F.col("specialist_type").alias("version"), "name", "content"), path, buckets)
