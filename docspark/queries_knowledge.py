"""Queries on assertions, search, scans as wholes, and topics by slug."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark import bridge
from docspark.operators import bills, knowledge, scans, statements
from docspark.plans.storage import written
from docspark.queries import _register
from docspark.queries_consolidation import _SERVICE
from docspark.queries_rules import _IDENTITY, _dominant, _mismatched, _shared, agg_near_orphans, win_about_node
from docspark.queries_statements import _SUMS, fn_statement_type

# --- what units say --------------------------------------------------------------------------------------------------


@_register(f"""with {_SUMS}, about as (select unit, arg_min(lower(value), (case when kind = 'organization' and contains(lower(value), '1') and lower(value) <> 'supplier#1' then 0 when kind = 'address' then 1 when kind = 'organization' then 2 else 3 end, ordinal, lower(value))) as node from v_mentions group by unit),
  b as (select * from v_bills where unit % 11 <> 0),
  y as (select unit, unnest(['document_type', 'issued_by', 'addressed_to', 'about', 'service_type', 'issue_date', 'due_date', 'payment_status', 'document_number', 'contract_code', 'supply_code', 'covers_period', 'amount_total']) as predicate,
    unnest(['utility_bill', concat('organization:', issuer), concat('person:', holder), case when unit not in (select unit from about) then 'address:VIA ROMA 12, SCANDICCI' end, {_SERVICE}, issue_date::varchar, due_date::varchar, nullif(payment_status, 'unknown'), concat('BL', code), concat('C', code), concat('IT', code), concat(period_from::varchar, '..', period_to::varchar), cents::varchar]) as object from b),
  z as (select unit, unnest(['document_type', 'statement_type', 'covers_period', 'validation_status']) as predicate, unnest(['accounting_statement',
    case when title = 'R' and (budget or split) then 'rendiconto_composito' when title = 'R' then 'rendiconto' when title = 'B' and not split then 'bilancio_preventivo' when split then 'riparto_spese' when title = 'E' then 'estratto_contabile' end,
    concat(year - 1, '-07-01..', year, '-06-30'), case when balance <> cents + water or due <> cents + water or due <> balance then 'fail' else 'pass' end]) as object from t)
  select unit, 'classification' as source, 'document_type' as predicate, kind as object from v_units union all select unit, 'entity', 'about', node from about
  union all select unit, 'utility_bill', predicate, object from y where object is not null union all select unit, 'accounting_statement', predicate, object from z where object is not null""")
def prj_graph_assertions(v):
    """Typed assertions of every unit from its kind, its entities, its bill (here: every eleventh has no usable issuer) and its statement."""
    said = written(v("statements"), "statement-texts")
    checks = statements.checks(written(statements.tables(said), "statement-tables")).where("status is not null")
    status = F.when(F.bool_or(F.col("status") == "fail"), "fail").when(F.bool_or(F.col("status") == "pass"), "pass").otherwise("unknown")
    period = statements.statement_period(F.col("text"))
    typed = said.select("unit", statements.statement_type(F.col("text")).alias("statement_type"), period[0].alias("period_from"), period[1].alias("period_to"))
    s = written(typed.join(checks.groupBy("unit").agg(status.alias("validation")), "unit", "left"), "statements-read")
    b = bills.bill_fields(bridge.bill_texts(v("bills"))).withColumn("issuer", F.when(F.col("unit") % 11 == 0, F.lit("<table><tr>")).otherwise(F.col("issuer")))
    b = written(b, "bills-read")
    return knowledge.assertions(v("units").select("unit", "kind"), win_about_node(v), b, s)


_UPSERTED = """pay as (select slug, title, 'other' as topic_class, 'issue' as topic_kind, concat('da ', title) as description, proposal as nth from v_proposals where proposal % 4 = 1),
  last as (select slug, arg_max(title, nth) as title, arg_max(description, nth) as description from pay group by 1),
  up as (select coalesce(t.slug, l.slug) as slug, t.topic, coalesce(l.title, t.title) as title, case when l.slug is null then t.topic_class else 'other' end as topic_class, case when l.slug is null then t.topic_kind else 'issue' end as topic_kind, coalesce(l.description, t.description) as description, l.slug is not null or coalesce(t.is_active, false) as is_active from v_topics t full join last l on t.slug = l.slug)"""


def _payloads(v):
    p = v("proposals").where("proposal % 4 = 1")
    return p.select("slug", "title", F.lit("other").alias("topic_class"), F.lit("issue").alias("topic_kind"), F.concat(F.lit("da "), "title").alias("description"), F.col("proposal").alias("nth"))


@_register(f"with {_UPSERTED} select * from up")
def upsert_topics(v):
    """Topics refreshed or made by slug."""
    return knowledge.upserted_topics(v("topics"), _payloads(v))


@_register(f"""with {_UPSERTED}, given as (select slug, concat('Alias ', title) as alias from pay union all select slug, upper(title) from pay union all select slug, concat('alias ', title) from pay), held as (select slug, concat('alias ', title) as alias from v_topics where topic % 2 = 0)
  select slug, min(alias) as alias from given g where not exists (select 1 from up where up.slug = g.slug and lower(g.alias) in (lower(up.slug), lower(up.title))) and not exists (select 1 from held h where h.slug = g.slug and lower(h.alias) = lower(g.alias)) group by slug, lower(alias)""")
def upsert_topic_aliases(v):
    """Aliases that come with topics, where they are new."""
    p = _payloads(v)
    given = p.select("slug", F.explode(F.array(F.concat(F.lit("Alias "), "title"), F.upper("title"), F.concat(F.lit("alias "), "title"))).alias("alias"))
    held = v("topics").where("topic % 2 = 0").select("slug", F.concat(F.lit("alias "), "title").alias("alias"))
    return knowledge.added_aliases(knowledge.upserted_topics(v("topics"), p), held, given)


_ASKED = ["green", " Ring", "x", "via roma", "enel", "verbale", "nation_1"]
_ASKED_SQL = "(values " + ", ".join(f"('{q.strip()}', '{q.strip().lower()}')" for q in _ASKED if len(q.strip()) > 1) + ") q(query, low)"


@_register(f"""with a as (select topic, concat('NATION_', (topic % 25)::varchar) as alias from v_topics), x as (select t.topic, q.query, concat_ws(',', case when contains(lower(title), low) then 'title' end, case when contains(slug, low) then 'slug' end, case when contains(lower(description), low) then 'description' end, case when contains(lower(alias), low) then 'alias' end) as fields
  from v_topics t join a on t.topic = a.topic cross join {_ASKED_SQL} where is_active) select * from x where fields <> ''""")
def join_search_topics(v):
    """Active topics that hold one of several queries, and in which fields; aliases are searched on their own."""
    t = v("topics").where("is_active")
    alias = t.select("topic", F.concat(F.lit("NATION_"), (F.col("topic") % 25).cast("string")).alias("alias"))
    own = knowledge.hits(t, "topic", {"title": "title", "slug": "slug", "description": "description"}, _ASKED)
    return knowledge.found([own, knowledge.hits(alias, "topic", {"alias": "alias"}, _ASKED)], "topic", ["title", "slug", "description", "alias"])


@_register(f"""with b as (select unit, lower(issuer) as text from v_bills), a as (select a.unit, bool_or(t.is_active) as active from (select distinct unit, topic from v_assignments) a join v_topics t on a.topic = t.topic group by 1),
  th as (select distinct a.unit, q.query from v_assignments a join (select topic, q.query from v_topics cross join {_ASKED_SQL} where contains(lower(title), low) or contains(slug, low)) q on a.topic = q.topic),
  x as (select u.unit, q.query, concat_ws(',', case when contains(concat('doc-', u.document::varchar), low) then 'filename' end, case when contains(lower(n.title), low) then 'title' end, case when contains(lower(n.summary), low) then 'summary' end, case when contains(b.text, low) or (b.unit is not null and low = 'via roma') then 'ocr_text' end, case when th.unit is not null then 'topic' end) as fields
    from v_units u cross join {_ASKED_SQL} left join v_notes n on u.unit = n.unit left join b on u.unit = b.unit left join th on th.unit = u.unit and th.query = q.query)
  select x.* from x left join a on x.unit = a.unit where fields <> '' and coalesce(a.active, true)""")
def join_search_units(v):
    """Units that hold one of several queries in their names, texts or topics; those with inactive topics only are left out."""
    u = v("units").select("unit", F.concat(F.lit("doc-"), F.col("document").cast("string")).alias("filename"))
    t = v("topics").select("topic", "title", "slug", "is_active")
    a = v("assignments").select("unit", "topic").distinct()
    named = knowledge.hits(t, "topic", {"topic": "title", "topic ": "slug"}, _ASKED).select("topic", "query").distinct()
    parts = [
        knowledge.hits(u, "unit", {"filename": "filename"}, _ASKED),
        knowledge.hits(v("notes"), "unit", {"title": "title", "summary": "summary"}, _ASKED),
        knowledge.hits(bridge.bill_texts(v("bills")), "unit", {"ocr_text": "text"}, _ASKED),
        a.join(named, "topic").select("unit", "query", F.lit("topic").alias("field")).distinct(),
    ]
    hidden = a.join(t, "topic").groupBy("unit").agg(F.bool_or("is_active").alias("active")).where("not active").select("unit")
    return knowledge.found(parts, "unit", ["filename", "title", "summary", "ocr_text", "topic"]).join(hidden, "unit", "left_anti")


@_register("""with m as (select unit, arg_min(lower(value), (ordinal, value)) filter (where kind = 'organization' and ordinal > 1) as party, arg_min(lower(value), (ordinal, value)) filter (where kind = 'place' and ordinal > 2) as context, arg_min(lower(value), (ordinal, value)) filter (where kind = 'address') as subject from v_mentions group by unit),
  c as (select unit, string_agg(topic::varchar, ',' order by nth) as candidates from (select *, row_number() over (partition by unit order by score desc, topic) as nth from (select unit, topic, max(confidence) as score from v_assignments group by 1, 2)) where nth <= 5 group by 1)
  select p.proposal, concat_ws(',', 'document_family', case when context is not null then 'context_key' end, case when party is not null then 'primary_party_key' end, case when subject is not null then 'subject_key' end, 'period_key') as matched,
    concat_ws(',', case when context is null then 'context_key' end, case when party is null then 'primary_party_key' end, case when subject is null then 'subject_key' end) as missing, coalesce(c.candidates, '') as candidates,
    case p.proposal % 3 when 0 then 'stesso fornitore,stesso periodo' when 1 then 'same address' else '' end as factors from v_proposals p join v_units u on p.unit = u.unit left join m on p.unit = m.unit left join c on p.unit = c.unit""")
def prj_proposal_axes(v):
    """What a reviewer sees of a proposal: axes known and missing, best candidates, reasons."""
    first = lambda kind, least, name: F.min_by(F.when((F.col("kind") == kind) & (F.col("ordinal") > least), F.lower("value")), F.when((F.col("kind") == kind) & (F.col("ordinal") > least), F.struct("ordinal", "value"))).alias(name)
    m = v("mentions").groupBy("unit").agg(first("organization", 1, "primary_party_key"), first("place", 2, "context_key"), first("address", 0, "subject_key"))
    u = v("units").select("unit", F.col("kind").alias("document_family"), F.year("created").cast("string").alias("period_key"))
    reason = F.when(F.col("proposal") % 3 == 0, "Stesso periodo, stesso fornitore").when(F.col("proposal") % 3 == 1, "Same address as before")
    p = v("proposals").select("proposal", "unit", reason.alias("rationale"))
    held = v("assignments").groupBy("unit", "topic").agg(F.max("confidence").alias("score"))
    candidates = p.select("proposal", "unit").join(held, "unit").select("proposal", "topic", "score")
    return knowledge.proposal_payloads(p.join(u, "unit").join(m, "unit", "left"), candidates)


# --- scans -----------------------------------------------------------------------------------------------------------


@_register("""with p as (select *, count(*) over (partition by scan) as k from v_scan_pages), z as (select scan, count(*) * (scan % 9) * 100000 + 7 as bytes from v_scan_pages group by 1),
  c as (select scan, coalesce(sum(length(trim(text))) filter (where k <= 4 or page in (1, k) or page = round_even(1 + (k - 1) / 3, 0) or page = round_even(1 + 2 * (k - 1) / 3, 0)), 0)::bigint as chars from p group by 1),
  r as (select scan, rotation, count(*) as n, min(page) as first from p group by 1, 2),
  s as (select scan, sum(n)::bigint as page_count, string_agg(concat(rotation::varchar, ':', n::varchar), ',' order by rotation) as rotations, arg_max(rotation, (n, -first)) filter (where rotation <> 0) as dominant, count(*) filter (where rotation <> 0) as turned from r group by 1)
  select s.scan, page_count, (bytes // page_count)::bigint as bytes_per_page, rotations, dominant, chars as sampled_chars, concat_ws(',', case when turned > 0 then 'declared_rotation' end, case when turned > 1 then 'mixed_declared_rotation' end, case when bytes // page_count >= 400000 then 'heavy_scan' end, case when chars = 0 then 'image_only_likely' end) as flags from s join z on s.scan = z.scan join c on s.scan = c.scan""")
def agg_preflight_flags(v):
    """Flags of each scan: declared rotations, weight of a page, no text in the sampled pages."""
    p = v("scan_pages")
    return scans.preflight_flags(p, p.groupBy("scan").agg((F.count(F.lit(1)) * (F.col("scan") % 9) * 100000 + 7).alias("bytes")))


_REGULATIONS = """txt as (select scan, lower(text) as t from v_scan_pages union all select scan, lower(summary) from v_scan_units), said as (select scan, bool_or(contains(t, 'regolamento')) and bool_or(contains(t, 'condominio')) and sum((length(t) - length(replace(t, 'art.', ''))) // 4 + (length(t) - length(replace(t, 'articolo', ''))) // 8) >= 3 as ok from txt group by 1),
  reg as (select u.scan, any_value(s.ok) and count(*) >= 2 and coalesce(bool_and(kind in ('regolamento_condominiale', 'contratto', 'verbale_assemblea', 'lettera', 'altro')), false) as is_regulation from v_scan_units u join said s on u.scan = s.scan group by 1)"""


def _regulations(v):
    return scans.regulations(v("scan_units"), v("scan_pages").select("scan", "text"))


@_register(f"with {_REGULATIONS} select * from reg")
def flt_regulation_scan(v):
    """Scans that are one regulation split into units."""
    return _regulations(v)


@_register(f"""with {_REGULATIONS}, pts as (select u.*, r.is_regulation, case when unit % 3 = 1 then 4 else 0 end + case when unit % 2 = 0 then 3 else 0 end + case when unit % 5 = 3 then 3 else 0 end + case when unit % 4 = 1 then 3 else 0 end + case when contains(lower(summary), 'regolamento') then 2 else 0 end + case when contains(lower(summary), 'condominio') then 1 else 0 end as points from v_scan_units u join reg r on u.scan = r.scan)
  select scan, arg_max(unit, (points, -ordinal, -unit)) as unit, 1::int as ordinal, min(start_page) as start_page, max(end_page) as end_page, 'regolamento_condominiale' as kind, coalesce(arg_max(coalesce(title, ''), (points, -ordinal, -unit)), '') as title from pts where is_regulation group by 1
  union all select scan, unit, ordinal, start_page, end_page, kind, title from pts where not is_regulation""".replace("coalesce(arg_max(coalesce(title, ''), (points, -ordinal, -unit)), '')", "coalesce(nullif(arg_max(coalesce(title, ''), (points, -ordinal, -unit)), ''), 'Regolamento condominiale')"))
def agg_regulation_pick(v):
    """Units after each regulation became the one with the best anchors."""
    u = v("scan_units")
    kinds = F.array_compact(F.array(F.when(F.col("unit") % 3 == 1, "indirizzo"), F.when(F.col("unit") % 2 == 0, "organizzazione"), F.when(F.col("unit") % 5 == 3, "condominio")))
    return scans.regulation_collapsed(u, u.select("unit", F.explode(kinds).alias("kind")), u.where("unit % 4 = 1").select("unit"), _regulations(v))


@_register("""with t as (select scan, scan * 1000 + page as "table", page, page % 4 as how from v_scan_pages)
  select u.unit, t."table" from t join v_scan_parts u on t.scan = u.scan where case how when 0 then t.page between u.start_page and u.end_page when 1 then u.start_page <= t.page + 2 and u.end_page >= t.page + 2 or t.page between u.start_page and u.end_page when 2 then true else t.page + 1 between u.start_page and u.end_page end""")
def join_tables_to_units(v):
    """Tables of the overlapping units whose pages they stand on; those of unknown page belong to all units of their scan."""
    p = F.col("page")
    places = F.when(p % 4 == 1, F.array(p, p + 2, F.lit(None).cast("int"))).when(p % 4 == 3, F.array(p + 1, p + 1)).when(p % 4 == 2, F.array().cast("array<int>"))
    tables = v("scan_pages").select("scan", (F.col("scan") * 1000 + p).alias("table"), F.when(p % 4 == 0, p).alias("page"), places.alias("places"))
    return scans.tables_of_units(tables, v("scan_parts"))


@_register(f"""with {_IDENTITY}, o as (select t.topic from v_topics t left join v_assignments a on t.topic = a.topic and a.confidence >= 10 and a.role = 'subject' where t.is_active group by 1 having count(a.topic) <= 1),
  sh as (select axis, value from (select topic, unnest(['context', 'party']) as axis, unnest([context, party]) as value from dom) where value is not null group by 1, 2 having count(*) >= 2),
  k as (select t.topic from v_topics t join dom d on t.topic = d.topic where t.topic_kind <> case d.family when 'utility_bill' then 'entity' when 'accounting_statement' then 'project' when 'meeting_minutes' then 'family' else 'issue' end)
  select 'total_active_topics' as name, count(*) as n from v_topics where is_active union all select 'total_assignments', count(*) from v_assignments union all select 'near_orphans', count(*) from o union all select 'shared_axis_groups', count(*) from sh union all select 'kind_mismatches', count(*) from k""")
def agg_cleanup_summary(v):
    """How many findings of each kind a cleanup report lists; alike titles and typos are counted by their own queries."""
    dominant = written(_dominant(v), "dominant")  # read by two of the counts
    parts = {"total_active_topics": v("topics").where("is_active"), "total_assignments": v("assignments"), "near_orphans": agg_near_orphans(v), "shared_axis_groups": _shared(dominant), "kind_mismatches": _mismatched(v, dominant)}
    rows = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n") for name, df in parts.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(rows[3]).unionByName(rows[4])
