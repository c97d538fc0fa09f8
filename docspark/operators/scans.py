"""Scans as wholes: preflight flags, regulations split into units, tables of units."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.functions.text import occurrences
from docspark.operators.intervals import points_within

HEAVY, SAMPLED = 400_000, 4
#: Types that the units of one regulation may have been given.
REGULATION_TYPES = ("regolamento_condominiale", "contratto", "verbale_assemblea", "lettera", "altro")


def preflight_flags(pages: DataFrame, sizes: DataFrame) -> DataFrame:
    """One row a scan: page_count, bytes_per_page, rotations (``0:2,90:1``), dominant, sampled_chars, flags.

    ``pages`` has scan, page, rotation (null is 0), text (or null); ``sizes`` scan, bytes. Four evenly spaced pages are sampled
    for text, all of a shorter scan. The dominant rotation is the commonest other than 0, of equal ones that which
    comes first. Pages are counted by rotation before anything is put together, so long scans need no row of their pages."""
    n = pages.groupBy("scan").agg(F.count(F.lit(1)).alias("page_count"))
    df = pages.join(n, "scan").withColumn("rotation", F.pmod(F.coalesce("rotation", F.lit(0)), F.lit(360)))
    step = (F.col("page_count") - 1) / (SAMPLED - 1)
    asked = F.array(*(F.bround(1 + i * step) for i in range(SAMPLED)))
    sampled = (F.col("page_count") <= SAMPLED) | F.array_contains(asked, F.col("page").cast("double"))
    chars = F.when(sampled, F.length(F.trim(F.coalesce("text", F.lit("")))))
    one = df.groupBy("scan", "page_count", "rotation").agg(F.count(F.lit(1)).alias("n"), F.min("page").alias("first"), F.sum(chars).alias("chars"))
    turned = F.col("rotation") != 0
    entry = F.struct("rotation", F.concat_ws(":", F.col("rotation").cast("string"), F.col("n").cast("string")).alias("x"))
    out = one.groupBy("scan", "page_count").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["x"]), ",").alias("rotations"),
        F.max_by("rotation", F.when(turned, F.struct("n", -F.col("first")))).alias("dominant"),
        F.count_if(turned).alias("turned"),
        F.coalesce(F.sum("chars"), F.lit(0)).alias("sampled_chars"),
    )
    out = out.join(sizes, "scan", "left").withColumn("bytes_per_page", F.floor(F.col("bytes") / F.col("page_count")))
    flags = [(F.col("turned") > 0, "declared_rotation"), (F.col("turned") > 1, "mixed_declared_rotation"), (F.col("bytes_per_page") >= HEAVY, "heavy_scan"), (F.col("sampled_chars") == 0, "image_only_likely")]
    return out.select("scan", "page_count", "bytes_per_page", "rotations", F.when(F.col("turned") > 0, F.col("dominant")).alias("dominant"), "sampled_chars", F.concat_ws(",", *(F.when(c, name) for c, name in flags)).alias("flags"))


def regulations(units: DataFrame, pages: DataFrame) -> DataFrame:
    """(scan, is_regulation): both words and three article markers in the pages and summaries, units of allowed types only
    (those without one don't count, but one must have one), two units or more.

    ``units`` has scan, kind, summary; ``pages`` scan, text. Whole texts are read, page by page."""
    low = F.lower(F.coalesce("text", F.lit("")))
    text = pages.select("scan", "text").unionByName(units.select("scan", F.col("summary").alias("text")))
    said = text.groupBy("scan").agg(F.bool_or(low.contains("regolamento")).alias("r"), F.bool_or(low.contains("condominio")).alias("c"), F.sum(occurrences(low, "art.") + occurrences(low, "articolo")).alias("marks"))
    kinds = units.groupBy("scan").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.bool_and(F.col("kind").isin(*REGULATION_TYPES)), F.lit(False)).alias("fit"))
    return kinds.join(said, "scan").select("scan", (F.col("r") & F.col("c") & (F.col("marks") >= 3) & F.col("fit") & (F.col("n") >= 2)).alias("is_regulation"))


def regulation_collapsed(units: DataFrame, entities: DataFrame, proposals: DataFrame, found: DataFrame) -> DataFrame:
    """Units after each regulation (``found``: scan, is_regulation) became one: scan, unit, ordinal, start_page, end_page, kind, title.

    The unit with the most points stays, of equal ones the first: address 4, organization 3, condominium 3, proposal 3, the
    summary's words 2 and 1. ``entities`` has unit, kind; ``proposals`` unit. Other scans stay as they are."""
    held = entities.groupBy("unit").agg(*(F.bool_or(F.col("kind") == k).cast("int").alias(k) for k in ("indirizzo", "organizzazione", "condominio")))
    df = units.join(found, "scan", "left").join(held, "unit", "left").join(proposals.select("unit", F.lit(1).alias("proposed")).distinct(), "unit", "left")
    said = lambda w: F.lower(F.coalesce("summary", F.lit(""))).contains(w).cast("int")
    n = lambda c: F.coalesce(c, F.lit(0))
    points = 4 * n("indirizzo") + 3 * (n("organizzazione") + n("condominio") + n("proposed")) + 2 * said("regolamento") + said("condominio")
    one = df.where("is_regulation").groupBy("scan").agg(F.max_by(F.struct("unit", "title"), F.struct(points, -F.col("ordinal"), -F.col("unit"))).alias("u"), F.min("start_page").alias("start_page"), F.max("end_page").alias("end_page"))
    one = one.select("scan", "u.unit", F.lit(1).alias("ordinal"), "start_page", "end_page", F.lit("regolamento_condominiale").alias("kind"), F.coalesce(F.nullif("u.title", F.lit("")), F.lit("Regolamento condominiale")).alias("title"))
    rest = df.where("not coalesce(is_regulation, false)").select("scan", "unit", "ordinal", "start_page", "end_page", "kind", "title")
    return rest.unionByName(one)


def tables_of_units(tables: DataFrame, units: DataFrame) -> DataFrame:
    """(unit, table), each pair once: a table belongs to the units of its scan that cover its page; without one, any of its
    known places; without those, all of them. ``tables`` has scan, table, page (or null), places (array of pages, or null)."""
    spans = units.select("scan", "unit", "start_page", "end_page")
    places = F.array_distinct(F.filter("places", lambda p: p.isNotNull()))
    known = F.when(F.col("page").isNotNull(), F.array("page")).otherwise(F.coalesce(places, F.array().cast("array<int>")))
    tables = tables.select("scan", "table", known.alias("known"))
    placed = tables.select("scan", "table", F.explode("known").alias("place"))
    there = points_within(placed, spans, "scan", "place", "start_page", "end_page").select("unit", "table").distinct()
    return there.unionByName(tables.where(F.size("known") == 0).join(spans, "scan").select("unit", "table"))
