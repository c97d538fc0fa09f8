"""Queries on pages: headings, boundaries, segments, noise, layouts; and titles that are probable typos."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.operators import fuzzy, pages
from docspark.queries import _register

_HEADINGS = r"""h0 as (select scan, page, coalesce(text, '') as text, list_transform(regexp_extract_all(coalesce(text, ''), '(?m)^#{1,3}\s+(.+)$', 1), lambda x: trim(x)) as marked, list_transform(regexp_extract_all(coalesce(text, ''), '(?m)^([A-ZÀÉÌÒÙ]{3,}(?:\s+[A-ZÀÉÌÒÙ]+)+)$', 1), lambda x: trim(x)) as capitals from v_pages),
  h as (select scan, page, text, list_concat(marked, list_filter(capitals, lambda x, i: length(x) < 200 and not list_contains(marked, x) and list_position(capitals, x) = i))[1:10] as headings, (list_filter([WORDS], lambda w: contains(lower(text), w)))[1:10] as words from h0)""".replace("WORDS", ", ".join(f"'{w}'" for w in pages.KEYWORDS))


@_register(f"with {_HEADINGS} select scan, page, array_to_string(headings, '|') as headings, array_to_string(words, '|') as keywords from h")
def fn_page_headings(v):
    """Headings and keywords of every page."""
    text = F.coalesce("text", F.lit(""))
    return v("pages").select("scan", "page", F.array_join(pages.headings(text), "|").alias("headings"), F.array_join(pages.keywords(text), "|").alias("keywords"))


_FOUND = " + ".join(f"(regexp_matches(text[1:500], '(?i){p}'))::int * 3" for p in pages.PATTERNS)
_MARKED = " or ".join(f"contains(lower(x), '{m}')" for m in pages.MARKERS)
_BOUNDS = f"""{_HEADINGS}, l as (select *, lag(words) over w as before, lag(len(headings)) over w as above, row_number() over w as nth from h window w as (partition by scan order by page)),
  b as (select scan, page, case when nth = 1 then 0 else {_FOUND} + case when len(headings) > 0 and above = 0 then 2 else 0 end + case when len(before) > 0 and len(words) > 0 and len(list_intersect(words, before)) * 10 < len(list_distinct(list_concat(words, before))) * 3 then 2 else 0 end + len(list_filter(headings, lambda x: {_MARKED})) * 4 end as score, nth from l)"""


@_register(f"with {_BOUNDS} select scan, page, score, nth = 1 or score >= 6 as boundary from b")
def win_page_boundaries(v):
    """Where documents begin in a scan, by four kinds of evidence against the page before."""
    return pages.boundaries(v("pages"))


@_register(f"""with {_BOUNDS}, o as (select *, sum((nth = 1 or score >= 6)::int) over (partition by scan order by page) as ordinal from b), g as (select scan, ordinal::bigint as ordinal, min(page) as start_page, max(page) as end_page, count(*) as n_pages, arg_min(score, page) as score from o group by 1, 2)
  select scan, ordinal, start_page, end_page, n_pages, coalesce(case when lead(score) over v is not null then least(lead(score) over v, 10) end, case when ordinal = 1 and n_pages = 1 then 9 else 8 end) as confidence from g window v as (partition by scan order by ordinal)""")
def win_segments(v):
    """Documents of a scan as runs of pages, with how sure each one's end is."""
    return pages.segments(pages.boundaries(v("pages")))


@_register(r"""with d as (select doc_id as scan, (doc_id % 4 + 1)::int as n, string_split(text, chr(10)) as lines from documents where text is not null), p as (select scan, unnest(range(1, n + 1))::int as page, n, lines, greatest(1, len(lines) // n) as per from d)
  select scan, page, coalesce(array_to_string(lines[(page - 1) * per + 1 : page * per], chr(10)), '') as text from p""")
def fn_pages_from_markdown(v):
    """Texts without page marks dealt evenly to their pages."""
    return pages.markdown_pages(v("documents").select(F.col("doc_id").alias("scan"), "text", (F.col("doc_id") % 4 + 1).cast("int").alias("page_count")))


@_register(r"""with t as (select scan, page, case when page % 3 = 0 then ['heavy_scan'] when page % 3 = 1 then ['image_only_likely', 'heavy_scan'] else [] end as flags, regexp_replace(text, '^\s+|\s+$', '', 'g') as text from v_pages), l as (select *, list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(x)), lambda x: x <> '') as lines from t where text <> ''),
  s as (select scan, page, (list_contains(flags, 'image_only_likely'))::int * 15 + (list_contains(flags, 'heavy_scan'))::int * 15 + least(len(regexp_extract_all(text, '[^ \t\n\r\f\v]{18,}')) * 4, 35) + least(len(regexp_extract_all(text, '[A-Za-z0-9]{14,}')) * 2, 20) + least(len(regexp_extract_all(text, '[,:;./-]{3,}')) * 2, 10)
    + case when list_sum(list_transform(lines, lambda x: length(x) - length(replace(x, ' ', '')))) < 2 * len(lines) and length(text) > 250 then 15 else 0 end + case when length(regexp_replace(text, '[ \t\n\r\f\v]+', '', 'g')) > 10 * len(regexp_extract_all(text, '[^ \t\n\r\f\v]+')) then 15 else 0 end as noise from l)
  select scan, page, noise::int as noise, nth from (select *, row_number() over (partition by scan order by noise desc, page) as nth from s where noise >= 35) where nth <= 3""")
def win_noisy_pages(v):
    """The noisiest pages of each scan, by six signals."""
    flags = F.when(F.col("page") % 3 == 0, F.array(F.lit("heavy_scan"))).when(F.col("page") % 3 == 1, F.array(F.lit("image_only_likely"), F.lit("heavy_scan"))).otherwise(F.array().cast("array<string>"))
    return pages.noise(v("pages").withColumn("flags", flags))


@_register(r"""with e as (select scan, page, row_number() over (partition by scan order by page) as nth, case page % 5 when 0 then 'heading' when 1 then 'paragraph' when 2 then 'table' when 3 then 'figure' else 'list_item' end as type, trim(text) as text from v_pages where scan % 10 <> 3)
  select scan, 1 as page, nth, type, row_number() over (partition by scan, grp order by nth) as ordinal, concat('page-1-', grp, '-', row_number() over (partition by scan, grp order by nth)) as id, text, 0.0::double as x0, page::double as y0, 100.0::double as x1, (page + 1)::double as y1
  from (select *, case when type in ('table', 'figure') then type else 'block' end as grp from e)""")
def fn_layout_elements(v):
    """Elements of layout models' answers: lists in fences, objects around lists; what isn't JSON gives nothing."""
    name = F.element_at(F.array(*map(F.lit, ("Title", "Text", "Table", "Picture", "List-item"))), (F.col("page") % 5 + 1).cast("int"))
    element = F.struct("page", name.alias("category"), "text", F.array(F.lit(0), F.col("page"), F.lit(100), F.col("page") + 1).alias("bbox"))
    rows = v("pages").groupBy("scan").agg(F.array_sort(F.collect_list(element)).alias("all"))
    plain = F.to_json("all")
    said = F.when(F.col("scan") % 10 == 3, F.lit("no layout found")).when(F.col("scan") % 2 == 0, F.concat(F.lit("```json\n"), plain, F.lit("\n```"))).otherwise(F.concat(F.lit('Here: {"layout_elements": '), plain, F.lit("}")))
    return pages.layout_elements(rows.select("scan", F.lit(1).alias("page"), said.alias("content")))


@_register()
def cl_probable_typos(v):
    """Titles from 0.7 to below 0.95 alike whose topics have different numbers of assignments: the best pairs first, each
    topic once; the one with fewer is the typo."""
    n = v("assignments").groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    t = v("topics").select("topic", F.lower("title").alias("title")).groupBy("title").agg(F.min("topic").alias("topic")).join(n, "topic", "left").na.fill(0, ["n"])
    side = lambda s: t.select(F.col("topic").alias(s), F.col("n").alias(f"n_{s}"))
    pairs = fuzzy.title_pairs(t, 0.7, apart="n").where("score < 0.95")
    best = fuzzy.matched(pairs).join(side("a"), "a").join(side("b"), "b")
    light = F.col("n_a") < F.col("n_b")
    return best.select(F.when(light, F.col("a")).otherwise(F.col("b")).alias("typo"), F.when(light, F.col("b")).otherwise(F.col("a")).alias("canonical"), "score")
