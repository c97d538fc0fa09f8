"""Scanned pages: boundaries, segments, unit text, noise, rotation and document text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from docspark.operators.intervals import points_within
from docspark.plans.storage import written

#: Patterns that a new document begins with, words that pages are compared by, and words in headings that
#: mark a new document.
PATTERNS = [r"\bverbale\b", r"\bassemblea\b", r"\brendiconto\b", r"\bfattura\b", r"\bpreventivo\b", r"\bbolletta\b", r"\bcontratto\b", r"\ballegato\b", r"\bdocumento\s*\d+"]
KEYWORDS = ["verbale", "assemblea", "rendiconto", "fattura", "preventivo", "bolletta", "contratto", "allegato", "deliberazione", "spese", "condominio", "amministratore", "fornitore"]
MARKERS = ["verbale", "rendiconto", "fattura", "preventivo"]
#: What the categories of layout models stand for; all others are paragraphs.
CATEGORIES = {"title": "heading", "section_header": "heading", "caption": "caption", "list_item": "list_item", "table": "table", "picture": "figure"}


def headings(text: Column) -> Column:
    """The first ten headings: lines after one to three #, then lines of two or more words in capitals."""
    marked = F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^#{1,3}\s+(.+)$"), F.lit(1)), F.trim)
    capitals = F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^([A-ZÀÉÌÒÙ]{3,}(?:\s+[A-ZÀÉÌÒÙ]+)+)$"), F.lit(1)), F.trim)
    fresh = F.filter(F.array_distinct(capitals), lambda h: (F.length(h) < 200) & ~F.array_contains(marked, h))
    return F.slice(F.concat(marked, fresh), 1, 10)


def keywords(text: Column) -> Column:
    """The first ten of the words that tell documents apart, in the list's order."""
    low = F.lower(text)
    return F.slice(F.array_compact(F.array(*(F.when(low.contains(w), F.lit(w)) for w in KEYWORDS))), 1, 10)


def boundaries(pages: DataFrame) -> DataFrame:
    """Tenths of evidence that a page begins a document: 3 for each pattern in its first 500 characters, 2 if it has
    headings and the page before none, 2 if both have keywords and share less than 0.3 of them, 4 for each heading with
    a marker. A boundary from 6 on, or on the first page. Null texts are empty pages."""
    w = Window.partitionBy("scan").orderBy("page")
    df = pages.select("scan", "page", F.coalesce("text", F.lit("")).alias("text"))
    df = df.select("scan", "page", F.left("text", F.lit(500)).alias("head"), headings(F.col("text")).alias("headings"), keywords(F.col("text")).alias("words"))
    df = df.withColumns({"before": F.lag("words").over(w), "above": F.lag(F.size("headings")).over(w), "nth": F.row_number().over(w)})
    found = sum((F.when(F.col("head").rlike("(?i)" + p), 3).otherwise(0) for p in PATTERNS), F.lit(0))
    reset = F.when((F.size("headings") > 0) & (F.col("above") == 0), 2).otherwise(0)
    known = (F.size("before") > 0) & (F.size("words") > 0)
    apart = F.when(known & (F.size(F.array_intersect("words", "before")) * 10 < F.size(F.array_union("words", "before")) * 3), 2).otherwise(0)
    marked = F.size(F.filter("headings", lambda h: F.greatest(*(F.lower(h).contains(m) for m in MARKERS)))) * 4
    df = df.withColumn("score", F.when(F.col("nth") == 1, 0).otherwise(found + reset + apart + marked))
    return df.select("scan", "page", "score", ((F.col("nth") == 1) | (F.col("score") >= 6)).alias("boundary"))


def segments(bounds: DataFrame) -> DataFrame:
    """Runs of pages from one boundary to the next: contiguous, without gap or overlap. A run is as sure as the boundary
    that ends it (tenths, at most 10), the last one 8, the only page of a scan 9."""
    w = Window.partitionBy("scan").orderBy("page")
    df = bounds.withColumn("ordinal", F.sum(F.col("boundary").cast("int")).over(w))
    df = df.groupBy("scan", "ordinal").agg(F.min("page").alias("start_page"), F.max("page").alias("end_page"), F.count(F.lit(1)).alias("n_pages"), F.min_by("score", "page").alias("score"))
    after = F.lead("score").over(Window.partitionBy("scan").orderBy("ordinal"))
    sure = F.coalesce(F.when(after.isNotNull(), F.least(after, F.lit(10))), F.when((F.col("ordinal") == 1) & (F.col("n_pages") == 1), 9).otherwise(8))
    return df.select("scan", "ordinal", "start_page", "end_page", "n_pages", sure.alias("confidence"))


def markdown_pages(documents: DataFrame) -> DataFrame:
    """(scan, page, text): lines of ``text`` dealt evenly to ``page_count`` pages, lines left over at the end dropped."""
    lines = F.split("text", "\n", -1)
    per = F.greatest(F.lit(1), F.floor(F.size(lines) / F.col("page_count"))).cast("int")
    cut_ = F.transform(F.sequence(F.lit(0), F.col("page_count") - 1), lambda i: F.array_join(F.slice(lines, i * per + 1, per), "\n"))
    df = documents.where("page_count > 0 and text is not null").select("scan", F.posexplode(cut_).alias("i", "text"))
    return df.select("scan", (F.col("i") + 1).alias("page"), "text")


def layout_elements(pages: DataFrame) -> DataFrame:
    """(scan, page, nth, type, ordinal, id, text, x0, y0, x1, y1) of the elements in ``content``, a model's JSON between
    other text or fences: a list, an object with layout_elements, or one element. Ordinals count within blocks, tables
    and figures of a page. Content that isn't such JSON gives no rows."""
    one = "struct<category:string,text:string,content:string,bbox:array<double>>"
    bare = F.trim(F.regexp_replace(F.regexp_replace(F.trim("content"), "^```(?:json)?", ""), "```$", ""))
    json = F.regexp_extract(bare, r"(?s)[\[{].*[\]}]", 0)
    inner = F.from_json(json, f"struct<layout_elements:array<{one}>>")["layout_elements"]
    single = F.from_json(json, one)
    some = F.when(json.startswith("["), F.from_json(json, f"array<{one}>")).otherwise(F.coalesce(inner, F.when(single["category"].isNotNull() & single["bbox"].isNotNull(), F.array(single))))
    df = pages.select("scan", "page", F.posexplode(F.filter(some, lambda x: x.isNotNull())).alias("nth", "e"))
    kind = F.create_map(*(F.lit(x) for pair in CATEGORIES.items() for x in pair))[F.replace(F.lower(F.trim("e.category")), F.lit("-"), F.lit("_"))]
    df = df.withColumn("type", F.coalesce(kind, F.lit("paragraph")))
    group = F.when(F.col("type").isin("table", "figure"), F.col("type")).otherwise("block")
    ordinal = F.row_number().over(Window.partitionBy("scan", "page", group).orderBy("nth"))
    made = F.concat(F.lit("page-"), F.col("page").cast("string"), F.lit("-"), group, F.lit("-"), ordinal.cast("string"))
    text = F.trim(F.coalesce(F.nullif("e.text", F.lit("")), "e.content", F.lit("")))
    box = F.when(F.size("e.bbox") == 4, F.col("e.bbox"))
    return df.select("scan", "page", (F.col("nth") + 1).alias("nth"), "type", ordinal.alias("ordinal"), made.alias("id"), text.alias("text"), *(F.get(box, F.lit(i)).alias(n) for i, n in enumerate(("x0", "y0", "x1", "y1"))))


def stripped(x: Column) -> Column:
    return F.regexp_replace(x, r"^\s+|\s+$", "")


def unit_text(units: DataFrame, pages: DataFrame, results: DataFrame) -> DataFrame:
    """(scan, unit, text): the unit's pages in order where each of them has text; else its share of the scan's lines.

    ``units`` has scan, unit, start_page, end_page (they may overlap); ``pages`` scan, page, markdown, text; ``results`` scan, markdown,
    page_count. A page's markdown counts before its text. Without all pages, a unit gets the lines that fall to its pages
    if all pages of the scan had equally many; without markdown or pages the empty text. Pages and lines meet units in bins."""
    said = stripped(F.coalesce(F.nullif("markdown", F.lit("")), F.coalesce("text", F.lit(""))))
    shown = pages.select("scan", "page", said.alias("said")).where("said <> ''")
    spans = units.select("scan", "unit", "start_page", "end_page")
    met = points_within(shown, spans, "scan", "page", "start_page", "end_page")
    full = met.groupBy("scan", "unit").agg(F.array_sort(F.collect_list(F.struct("page", "said"))).alias("own"), F.count_distinct("page").alias("n"))
    full = full.join(spans, ["scan", "unit"]).where("n = end_page - start_page + 1")
    full = written(full.select("scan", "unit", stripped(F.array_join(F.transform("own", lambda p: p["said"]), "\n")).alias("text")), "unit-texts")
    rest = spans.join(full, ["scan", "unit"], "left_anti")
    usable = results.where("markdown <> '' and page_count > 0").join(rest.select("scan").distinct(), "scan", "left_semi")
    lines = usable.select("scan", F.split("markdown", "\n").alias("lines"), "page_count").withColumn("each", F.greatest(F.lit(1), F.floor(F.size("lines") / F.col("page_count"))))
    each = lines.select("scan", "each")
    lines = lines.select("scan", F.posexplode("lines").alias("line", "said"))
    shares = rest.join(each, "scan").select("scan", "unit", ((F.col("start_page") - 1) * F.col("each")).alias("first"), (F.col("end_page") * F.col("each") - 1).alias("last"))
    cut_out = points_within(lines, shares, "scan", "line", "first", "last").groupBy("scan", "unit").agg(F.array_sort(F.collect_list(F.struct("line", "said"))).alias("own"))
    cut_out = cut_out.select("scan", "unit", stripped(F.array_join(F.transform("own", lambda p: p["said"]), "\n")).alias("text"))
    return full.unionByName(rest.select("scan", "unit").join(cut_out, ["scan", "unit"], "left").select("scan", "unit", F.coalesce("text", F.lit("")).alias("text")))


def noise(pages: DataFrame, k: int = 3, least: int = 35) -> DataFrame:
    """The ``k`` noisiest pages of each scan with ``least`` hundredths or more: flags of the scan, long tokens, runs of letters
    and digits, few spaces, long words, runs of punctuation. ``pages`` has scan, page, text, flags; blank pages don't count."""
    text = F.trim(F.regexp_replace("text", r"^\s+|\s+$", ""))
    df = pages.select("scan", "page", "flags", text.alias("text")).where("text <> ''")
    text = F.col("text")
    lines = F.filter(F.transform(F.split(text, "\n"), F.trim), lambda x: x != "")
    spaces = F.aggregate(lines, F.lit(0), lambda t, x: t + F.length(x) - F.length(F.replace(x, F.lit(" "), F.lit(""))))
    letters, words = F.length(F.regexp_replace(text, r"\s+", "")), F.regexp_count(text, F.lit(r"\S+"))
    runs = lambda p, each, most: F.least(F.regexp_count(text, F.lit(p)) * each, F.lit(most))
    flag = lambda name: F.when(F.coalesce(F.array_contains("flags", name), F.lit(False)), 15).otherwise(0)
    score = flag("image_only_likely") + flag("heavy_scan") + runs(r"\S{18,}", 4, 35) + runs("[A-Za-z0-9]{14,}", 2, 20) + runs("[,:;./-]{3,}", 2, 10)
    score = score + F.when((spaces < 2 * F.size(lines)) & (F.length(text) > 250), 15).otherwise(0) + F.when(letters > 10 * words, 15).otherwise(0)
    df = df.select("scan", "page", score.alias("noise")).where(F.col("noise") >= least)
    best = F.row_number().over(Window.partitionBy("scan").orderBy(F.desc("noise"), "page"))
    return df.withColumn("nth", best).where(F.col("nth") <= k)


def rotation_vote(detections: DataFrame, share: int = 75) -> DataFrame:
    """Rotation on which at least ``share`` percent of a document's sure detections (from 80, not 0) agree."""
    sure = detections.where("confidence >= 80 and rotation <> 0").groupBy("document", "rotation").agg(F.count(F.lit(1)).alias("votes"))
    w = Window.partitionBy("document")
    df = sure.withColumn("all", F.sum("votes").over(w)).where(F.col("votes") * 100 >= F.col("all") * share)
    return df.select("document", "rotation", "votes", F.col("all").alias("qualified"))
