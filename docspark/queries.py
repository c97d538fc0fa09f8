"""All registered queries of the archive jobs, and the SQL each is held against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from docspark.bridge import view, with_views
from docspark.functions import text as fn
from docspark.operators import accounting, contexts, latest, pages, rules, topics
from docspark.plans.components import components
from docspark.plans.storage import written
from docspark.streaming import jobs, stateful

QUERIES: dict = {}
ORACLE: dict = {}


def _register(sql: str | None = None):
    """Register a query of (views) under its name; views are looked up by attribute."""

    def add(f):
        def run(spark, sf_dir) -> DataFrame:
            def table(name: str, stream: bool = False) -> DataFrame:
                return view(spark, sf_dir, name, stream) if name not in _RAW else spark.read.parquet(f"{sf_dir}/{_RAW[name]}.parquet")

            return f(table)

        run.__doc__ = f.__doc__
        QUERIES[f.__name__] = run
        if sql:
            ORACLE[f.__name__] = with_views(sql)
        return f

    return add


_RAW = {"documents": "documents", "customer": "customer", "orders": "orders", "part": "part", "html": "pages", "nation": "nation", "events": "events", "supplier": "supplier"}
_BREAKDOWN = """breakdown as (select context, account, role, period, sum(case when not is_total then cents end)::bigint as components,
  count(*) filter (where is_total) as n_totals, case when count(*) filter (where is_total) = 1 then max(case when is_total then cents end) end as reported,
  count(distinct case when not is_total then category end) as n_categories,
  case when count(distinct case when not is_total then category end) = 0 and count(*) filter (where is_total) = 0 then 'missing'
       when count(distinct case when not is_total then category end) = 0 then 'missing_components'
       when count(*) filter (where is_total) > 1 then 'ambiguous_total'
       when count(*) filter (where is_total) = 1 and abs(max(case when is_total then cents end) - sum(case when not is_total then cents end)) > 2 then 'inconsistent_total'
       else 'validated' end as status from v_facts group by context, account, role, period)"""


# --- accounting -----------------------------------------------------------------------------------------------------


@_register(f"with {_BREAKDOWN} select * from breakdown")
def agg_period_breakdown(v):
    """Components, reported total and reconciliation status per account and period."""
    return accounting.period_breakdown(v("facts"))


_OVER = """steps as (select *, lag(period) over w as period_a, lag(components) over w as cents_a, lag(status) over w as status_a from breakdown window w as (partition by context, account, role order by period))"""
_COMPARE = f"""with {_BREAKDOWN}, {_OVER} select context, account, role, period_a, period as period_b, cents_a, components as cents_b, components - cents_a as delta,
  case when cents_a <> 0 then round_even((components - cents_a)::double * 100 / cents_a, 2) end as percent,
  case when components > cents_a then 'up' when components < cents_a then 'down' else 'same' end as direction,
  case when cents_a is null or components is null then 'insufficient_data' when status = 'validated' and status_a = 'validated' then 'comparable' else 'needs_review' end as comparison
  from steps where period_a is not null"""


@_register(_COMPARE)
def agg_period_compare(v):
    """Consecutive periods of every account compared."""
    return accounting.period_over_period(accounting.period_breakdown(v("facts")))


@_register(f"with {_BREAKDOWN}, {_OVER} select context, account, period_a, period as period_b, components - cents_a as delta from steps where period_a = period - 1")
def win_period_over_period(v):
    """Change from one year to the next, gaps left out."""
    df = accounting.period_over_period(accounting.period_breakdown(v("facts")))
    return df.where("period_a = period_b - 1").select("context", "account", "period_a", "period_b", "delta")


@_register("""with t as (select context, account, category, coalesce(sum(case when period = 1997 then cents end), 0)::bigint as cents_a, coalesce(sum(case when period = 1998 then cents end), 0)::bigint as cents_b
  from v_facts where not is_total and period in (1997, 1998) group by 1, 2, 3)
  select *, cents_b - cents_a as delta, case when cents_a <> 0 then round_even((cents_b - cents_a)::double * 100 / cents_a, 2) end as percent from t where cents_b <> cents_a""")
def join_category_changes(v):
    """Category totals of two periods, changed ones only."""
    return accounting.category_changes(v("facts"), 1997, 1998)


@_register("select context, account, count(*) as n_facts, count(distinct unit) as n_units, array_to_string(list_sort(list(distinct period)), ',') as periods from v_facts group by 1, 2")
def join_context_subjects(v):
    return accounting.subjects(v("facts"))


@_register("""with f as (select unit, arg_min(value, (ordinal, value)) as node from v_mentions where kind = 'organization' group by unit)
  select u.unit, coalesce(f.node, concat('document_unit:', u.unit::varchar)) as scope from v_units u left join f on u.unit = f.unit""")
def join_fact_scope(v):
    links = v("mentions").where("kind = 'organization'").select("unit", F.col("value").alias("node"), "ordinal")
    return accounting.first_scope(links, v("units"))


# --- one row per key ------------------------------------------------------------------------------------------------


@_register("select job, arg_max(status, (ts, event)) as status, max(ts) as ts, arg_max(event, (ts, event)) as event from v_jobs group by job")
def win_latest_per_key(v):
    return latest.latest_per_key(v("jobs"), ["job"], ["ts", "event"]).select("job", "status", "ts", "event")


@_register("""with n as (select *, lag(sha) over (partition by external_id order by upload) as before from v_uploads where external_id is not null),
  c as (select *, (before is null or sha <> before) as changed from n),
  b as (select upload, sha, min(upload) over (partition by sha) as first from v_uploads where external_id is null)
  select upload, concat('ext:', external_id) as document, sum(changed::int) over (partition by external_id order by upload)::bigint as version, not changed as deduplicated from c
  union all select upload, concat('sha:', sha), 1, upload <> first from b""")
def win_document_versions(v):
    return latest.document_versions(v("uploads"))


_BEST = "row_number() over (partition by unit, topic, role order by confidence desc, created desc, line) as nth"


@_register(f"with r as (select *, {_BEST} from v_assignments) select unit, topic, role, confidence, created, line from r where nth = 1")
def win_dedup_assignments(v):
    order = [F.desc_nulls_last("confidence"), F.desc("created"), F.col("line")]
    return latest.best_per_key(v("assignments"), ["unit", "topic", "role"], order).drop("nth")


@_register("""with a as (select unit, topic, role, max(confidence) as confidence from v_assignments group by 1, 2, 3),
  e as (select a.*, case t.class when 'PROMO' then 'document_family' else 'subject' end as expected from a join v_topics t on a.topic = t.topic),
  w as (select *, max((role = expected)::int) over (partition by unit, topic) as has from e)
  select distinct unit, topic, expected as role from w where role = expected or has = 0""")
def win_role_repair(v):
    """Roles that don't fit their topic's class: dropped if the fitting one is there, else set to it."""
    expected = v("topics").select("topic", F.when(F.col("class") == "PROMO", "document_family").otherwise("subject").alias("expected"))
    df = v("assignments").select("unit", "topic", "role").distinct().join(expected, "topic")
    df = df.withColumn("has", F.max(F.col("role") == F.col("expected")).over(Window.partitionBy("unit", "topic")))
    return df.where(~F.col("has") | (F.col("role") == F.col("expected"))).select("unit", "topic", F.col("expected").alias("role")).distinct()


@_register("""with a as (select unit, topic, role, max(confidence) as confidence from v_assignments where line <= 3 group by 1, 2, 3), b as (select unit, topic, role, max(confidence) as confidence from v_assignments where line > 3 group by 1, 2, 3)
  select coalesce(b.unit, a.unit) as unit, coalesce(b.topic, a.topic) as topic, coalesce(b.role, a.role) as role, coalesce(b.confidence, a.confidence) as confidence from a full join b on a.unit = b.unit and a.topic = b.topic and a.role = b.role""")
def upsert_assignments(v):
    part = lambda cond, step: v("assignments").where(cond).groupBy("unit", "topic", "role").agg(F.max("confidence").alias("confidence")).withColumn("step", F.lit(step))
    return latest.upsert(part("line <= 3", 1), part("line > 3", 2), ["unit", "topic", "role"], "step").select("unit", "topic", "role", "confidence")


@_register("select unit, document, kind from v_units where document not in (select distinct document from v_units where unit % 97 = 0)")
def apply_document_reset(v):
    """All rows but those of the documents that are reset."""
    units = v("units").select("unit", "document", "kind")
    gone = units.where("unit % 97 = 0").select("document").distinct()
    return units.join(gone, "document", "left_anti").select("unit", "document", "kind")


def _tracked(jobs: DataFrame) -> DataFrame:
    """Some jobs are specialists', whose statuses have other names."""
    special = F.col("job") % 4 == 0
    status = F.when(special, F.create_map(*map(F.lit, ("running", "processing", "queued", "pending")))[F.col("status")])
    return jobs.select(F.when(special, "specialist").otherwise("ingest").alias("kind"), "job", "event", "ts", F.coalesce(status, "status").alias("status"))


@_register("""with j as (select case when job % 4 = 0 then 'specialist' else 'ingest' end as kind, job, event, ts, case when job % 4 = 0 and status = 'running' then 'processing' when job % 4 = 0 and status = 'queued' then 'pending' else status end as status from v_jobs),
  l as (select kind, job, max(ts) as ts, arg_max(event, (ts, event)) as event, arg_max(status, (ts, event)) as status from j group by 1, 2),
  t as (select *, case when status in ('queued', 'pending') then 24 when status = 'running' then 6 when status = 'processing' then 3 end as hours, (select max(ts) from j) - interval 1 hour as mark from l)
  select kind, job, event, ts, status, case when hours = 24 then 'queued too long' else 'running too long' end as reason from t where hours is not null and date_trunc('millisecond', mark) > ts + to_hours(hours)""")
def st_stale_jobs(v):
    """Jobs whose status lasts too long: the events as a stream, up to their last watermark, which is an hour behind the last event."""
    spark = v("events").sparkSession
    stateful.use_timers(spark)
    return jobs.drained(stateful.stale_jobs(_tracked(v("jobs", stream=True))), "stale-jobs")


@_register("""with n as (select *, lag(sha) over (partition by external_id order by upload) as before from v_uploads where external_id is not null),
  c as (select *, (before is null or sha <> before) as changed from n),
  b as (select upload, sha, min(upload) over (partition by sha) as first from v_uploads where external_id is null)
  select concat('ext:', external_id) as document, upload, sum(changed::int) over (partition by external_id order by upload)::bigint as version, not changed as deduplicated from c
  union all select concat('sha:', sha), upload, 1, upload <> first from b""")
def st_upload_versions(v):
    """Versions of uploads, one a second, as a stream whose watermark comes to the last of them."""
    spark = v("documents").sparkSession
    stateful.use_timers(spark)
    stream = v("uploads", stream=True).select("upload", "external_id", "sha", F.timestamp_seconds(F.col("upload") + 1).alias("arrived"))
    return jobs.drained(stateful.upload_versions(stream, "0 seconds"), "upload-versions")




# --- entities, contexts, graph ---------------------------------------------------------------------------------------


@_register("""with m as (select kind, lower(trim(value)) as entity, value, unit, document from v_mentions), t as (select m.kind, m.entity, count(distinct a.topic) as topics from m join v_assignments a on m.unit = a.unit group by 1, 2),
  e as (select kind, entity, max(value) as display, count(*) as mentions, count(distinct document) as documents from m group by 1, 2)
  select e.*, coalesce(topics, 0)::bigint as topics, row_number() over (partition by e.kind order by documents desc, mentions desc, e.entity) as nth from e left join t on e.kind = t.kind and e.entity = t.entity""")
def agg_entity_index(v):
    """Every entity with its mentions, documents and topics, in order of documents within its kind."""
    index = topics.entity_index(v("assignments"), v("mentions"))
    order = Window.partitionBy("kind").orderBy(F.desc("documents"), F.desc("mentions"), "entity")
    return index.withColumn("nth", F.row_number().over(order))


@_register("""with c as (select n_name as value, concat('canon_', (n_nationkey % 5)::varchar) as canonical from nation) select m.kind, coalesce(c.canonical, lower(trim(m.value))) as entity, (c.canonical is null) as is_auto, count(*) as n
  from v_mentions m left join c on m.kind = 'place' and lower(trim(m.value)) = lower(c.value) group by 1, 2, 3""")
def join_canonical_identity(v):
    """Mentions under their canonical entity, else themselves."""
    canon = v("nation").select(F.lit("place").alias("kind"), F.lower("n_name").alias("key"), F.concat(F.lit("canon_"), (F.col("n_nationkey") % 5).cast("string")).alias("canonical"))
    df = v("mentions").withColumn("key", F.lower(F.trim("value"))).join(canon, ["kind", "key"], "left")
    return df.groupBy("kind", F.coalesce("canonical", "key").alias("entity"), F.col("canonical").isNull().alias("is_auto")).agg(F.count(F.lit(1)).alias("n"))


@_register("select kind, lower(value) as entity, count(distinct unit) as n_units, array_to_string(list_sort(list(distinct document))[1:5], ',') as first_documents from v_mentions where kind = 'place' group by 1, 2")
def join_entity_detail(v):
    """Units of each place and its first five documents; a place gathers five of them, however many name it."""
    m = v("mentions").where("kind = 'place'").select("kind", F.lower("value").alias("entity"), "unit", "document")
    nth = F.row_number().over(Window.partitionBy("kind", "entity").orderBy("document"))
    first = m.select("kind", "entity", "document").where("document is not null").distinct().withColumn("nth", nth).where("nth <= 5")
    first = first.groupBy("kind", "entity").agg(F.array_join(F.sort_array(F.collect_list("document")), ",").alias("first_documents"))
    units = m.groupBy("kind", "entity").agg(F.count_distinct("unit").alias("n_units"))
    return units.join(first, ["kind", "entity"], "left").na.fill("", ["first_documents"]).select("kind", "entity", "n_units", "first_documents")


@_register("""select kind, regexp_replace(lower(value), '[^a-z0-9]+', '_', 'g') as node, arg_min(value, (unit, ordinal, value)) as label, count(distinct value) as aliases from v_mentions group by 1, 2""")
def cl_nodes(v):
    node = F.regexp_replace(F.lower("value"), "[^a-z0-9]+", "_").alias("node")
    return v("mentions").groupBy("kind", node).agg(F.min_by("value", F.struct("unit", "ordinal", "value")).alias("label"), F.count_distinct("value").alias("aliases"))


@_register("""with e as (select distinct kind, lower(value) as entity, document from v_mentions), s as (select entity, kind, count(*) as n, array_to_string(list_sort(list(document)), ',') as docs from e group by 1, 2 having count(*) >= 2),
  r as (select *, first_value(entity) over w as head, first_value(kind) over w as head_kind from s window w as (partition by docs order by (kind <> 'organization')::int, entity, kind))
  select entity, kind, n, case when head_kind = 'organization' and kind in ('address', 'place') then head else entity end as context from r""")
def cl_context_groups(v):
    return contexts.context_groups(contexts.document_sets(v("mentions").select(F.lower("value").alias("entity"), "kind", "document")))



@_register("select kind, value, count(distinct unit) as units from (select kind, value, unit from v_mentions union select 'type', kind, unit from v_units) group by 1, 2")
def agg_node_summary(v):
    both = v("mentions").select("kind", "value", "unit").union(v("units").select(F.lit("type"), "kind", "unit"))
    return both.groupBy("kind", "value").agg(F.count_distinct("unit").alias("units"))


@_register("select unit from v_mentions where kind = 'place' and value = 'NATION_3' union select unit from v_units where kind = 'regulation'")
def set_union_units(v):
    a = v("mentions").where("kind = 'place' and value = 'NATION_3'").select("unit")
    return a.union(v("units").where("kind = 'regulation'").select("unit")).distinct()


@_register("select unit, kind, title from v_units where unit in (select unit from v_mentions where value = 'NATION_7')")
def join_assertions_for_node(v):
    return v("units").select("unit", "kind", "title").join(v("mentions").where("value = 'NATION_7'").select("unit"), "unit", "left_semi")


@_register("select context, count(distinct account) as accounts, count(distinct unit) as units, count(*) filter (where is_total) as totals from v_facts group by 1")
def agg_context_summary(v):
    return v("facts").groupBy("context").agg(F.count_distinct("account").alias("accounts"), F.count_distinct("unit").alias("units"), F.count_if("is_total").alias("totals"))


# --- topics ----------------------------------------------------------------------------------------------------------


_STOP = ", ".join(f"'{w}'" for w in fn.STOP)
_TOKENS = f"list_distinct(list_filter(string_split_regex(lower(title), '[^a-z0-9]+'), lambda x: length(x) >= 3 and not regexp_full_match(x, '[0-9]+') and x not in ({_STOP})))"


def _topic_tokens(df: DataFrame) -> DataFrame:
    return df.withColumn("tokens", fn.tokens(F.col("title")))


@_register(f"select topic, array_to_string(list_sort({_TOKENS}), ' ') as tokens from v_topics")
def fn_title_tokens(v):
    return _topic_tokens(v("topics")).select("topic", F.array_join(F.sort_array("tokens"), " ").alias("tokens"))


@_register("select topic, trim(regexp_replace(lower(title), '[^a-z0-9]+', '-', 'g'), '-') as slug from v_topics")
def fn_slugify(v):
    return v("topics").select("topic", fn.slug(F.col("title")).alias("slug"))


@_register("""with m as (select a.topic, m.kind, m.value from (select distinct unit, topic from v_assignments) a join (select distinct unit, kind, value from v_mentions) m on a.unit = m.unit), n as (select topic, kind, value, count(*) as n from m group by 1, 2, 3)
  select topic, kind, value, n from (select *, row_number() over (partition by topic, kind order by n desc, length(value) desc, value) as nth from n) where nth = 1""")
def agg_topic_anchors(v):
    return topics.anchors(topics.topic_values(v("assignments"), v("mentions")))


@_register("""with a as (select a.topic, count(distinct a.unit) as units, count(distinct u.document) as documents from v_assignments a left join v_units u on a.unit = u.unit group by 1), p as (select topic, count(*) as proposals, count(*) filter (where status = 'proposed') as open_proposals from v_proposals where topic is not null group by 1),
  n as (select topic, count(distinct lower(alias)) as aliases from (select topic, unnest([slug, title, description]) as alias from v_topics) group by 1)
  select t.topic, t.title, coalesce(units, 0)::bigint as units, coalesce(documents, 0)::bigint as documents, coalesce(proposals, 0)::bigint as proposals, coalesce(open_proposals, 0)::bigint as open_proposals, aliases from v_topics t left join a on t.topic = a.topic left join p on t.topic = p.topic join n on t.topic = n.topic""")
def agg_topic_summary(v):
    """Topics with their units, documents, proposals and different names."""
    a = v("assignments").join(v("units").select("unit", "document"), "unit", "left").groupBy("topic").agg(F.count_distinct("unit").alias("units"), F.count_distinct("document").alias("documents"))
    p = v("proposals").where("topic is not null").groupBy("topic").agg(F.count(F.lit(1)).alias("proposals"), F.count_if(F.col("status") == "proposed").alias("open_proposals"))
    names = F.size(F.array_distinct(F.transform(F.array_compact(F.array("slug", "title", "description")), F.lower))).cast("long")
    df = v("topics").select("topic", "title", names.alias("aliases")).join(a, "topic", "left").join(p, "topic", "left")
    return df.na.fill(0, ["units", "documents", "proposals", "open_proposals"])


@_register("select topic, class, weight, case class when 'PROMO' then 'family' when 'SMALL' then 'entity' when 'LARGE' then 'project' else 'issue' end as topic_kind from v_topics")
def prj_topic_kind(v):
    kind = F.when(F.col("class") == "PROMO", "family").when(F.col("class") == "SMALL", "entity").when(F.col("class") == "LARGE", "project").otherwise("issue")
    return v("topics").select("topic", "class", "weight", kind.alias("topic_kind"))


_PROFILES = f"profiles as (select class as axis, title, min(topic) as topic, sum(weight)::bigint as weight, {_TOKENS} as tokens from v_topics group by class, title)"


def _profiles(v) -> DataFrame:
    return _topic_tokens(v("topics").groupBy(F.col("class").alias("axis"), "title").agg(F.min("topic").alias("topic"), F.sum("weight").alias("weight")))


@_register("select axis, topic, weight, array_to_string(list_sort(tokens), ' ') as tokens from (with " + _PROFILES + " select * from profiles)")
def join_topic_profiles(v):
    return _profiles(v).select("axis", "topic", "weight", F.array_join(F.sort_array("tokens"), " ").alias("tokens"))


# --- pages and texts -------------------------------------------------------------------------------------------------


_STRIP = lambda x: rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


@_register(f"""with shown as (select scan, page, {_STRIP('text')} as said from v_scan_pages where {_STRIP('text')} <> ''),
  own as (select u.scan, u.unit, {_STRIP("string_agg(s.said, chr(10) order by s.page, s.said)")} as text, count(distinct s.page) as n from v_scan_parts u join shown s on s.scan = u.scan and s.page between u.start_page and u.end_page group by 1, 2),
  r as (select scan, string_split(markdown, chr(10)) as lines, greatest(1, len(string_split(markdown, chr(10))) // page_count) as each from v_scan_results where markdown <> '' and page_count > 0)
  select u.scan, u.unit, case when o.n = u.end_page - u.start_page + 1 then o.text else coalesce({_STRIP("array_to_string(r.lines[(u.start_page - 1) * r.each + 1 : u.end_page * r.each], chr(10))")}, '') end as text
  from v_scan_parts u left join own o on o.scan = u.scan and o.unit = u.unit left join r on r.scan = u.scan""")
def join_unit_text(v):
    """Texts of overlapping units: their pages', or their share of the scan's lines where a page has no text or isn't there."""
    shown = v("scan_pages").select("scan", "page", F.when(F.col("page") % 2 == 0, F.col("text")).alias("markdown"), "text")
    return pages.unit_text(v("scan_parts"), shown, v("scan_results"))


@_register("select scan, string_agg(text, chr(10) || chr(10) order by page) filter (where trim(text) <> '') as text, count(*) as page_count, sum(length(text))::bigint as n_chars from v_pages group by scan")
def agg_pages_to_document(v):
    kept = F.filter(F.array_sort(F.collect_list(F.struct("page", "text"))), lambda p: F.trim(p["text"]) != "")
    return v("pages").groupBy("scan").agg(F.array_join(F.transform(kept, lambda p: p["text"]), "\n\n").alias("text"), F.count(F.lit(1)).alias("page_count"), F.sum(F.length("text")).alias("n_chars"))


@_register("""with s as (select document, rotation, count(*) as votes from v_detections where confidence >= 80 and rotation <> 0 group by 1, 2), a as (select *, sum(votes) over (partition by document)::bigint as qualified from s) select document, rotation, votes, qualified from a where votes * 100 >= qualified * 50""")
def agg_rotation_vote(v):
    return pages.rotation_vote(v("detections"), 50)


@_register("select doc_id, case when (length(t) - length(replace(t, ' the ', ''))) / 5 + (length(t) - length(replace(t, ' of ', ''))) / 4 + (length(t) - length(replace(t, ' and ', ''))) / 5 + (length(t) - length(replace(t, ' is ', ''))) / 4 > (length(t) - length(replace(t, ' il ', ''))) / 4 + (length(t) - length(replace(t, ' di ', ''))) / 4 + (length(t) - length(replace(t, ' che ', ''))) / 5 + (length(t) - length(replace(t, ' della ', ''))) / 7 + case when regexp_matches(t, '[àèéìòù]') then 3 else 0 end then 'en' else 'it' end as language from (select doc_id, lower(text) as t from documents)")
def fn_detect_language(v):
    return v("documents").select("doc_id", fn.language(F.col("text")).alias("language"))


@_register("select doc_id, case when length(text) > 1000 then concat(text[1:500], chr(10), '...', chr(10), right(text, 500)) else text end as text from documents")
def fn_head_tail(v):
    return v("documents").select("doc_id", fn.head_tail(F.col("text"), 1000).alias("text"))


@_register(r"select doc_id, case when length(trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g'))) <= 1024 and not contains(text, '<table') then trim(regexp_replace(text, '[ \t\n\r]+', ' ', 'g')) end as text from documents")
def fn_bounded_text(v):
    return v("documents").select("doc_id", fn.bounded(F.col("text"), 1024).alias("text"))


@_register("select c_custkey as account, c_acctbal::double as amount from customer where c_acctbal >= 0")
def fn_amount_it(v):
    """Balances written the Italian way and read again."""
    text = F.translate(F.format_number(F.col("c_acctbal"), 2), ",.", ".,")
    return v("customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("account"), fn.amount_it(text).alias("amount"))


# --- overviews -------------------------------------------------------------------------------------------------------


@_register("select 'units' as name, count(*) as n from v_units union all select 'assignments', count(*) from v_assignments union all select 'mentions', count(*) from v_mentions union all select 'topics', count(*) from v_topics union all select 'facts', count(*) from v_facts")
def agg_archive_counts(v):
    out = None
    for name in ("units", "assignments", "mentions", "topics", "facts"):
        one = v(name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


@_register("""with c as (select document, count(distinct unit // 4) as scans, count(*) as units, max(created) as newest, arg_max(kind, (created, unit)) as latest_kind, bool_or(seg_conf < 70 or class_conf < 70) as needs_review from v_units group by 1),
  r as (select user_id as document, arg_max((event_id % 7 % 3) * 90, (ts, event_id))::int as rotation, arg_max(event_id % 4 = 0, (ts, event_id)) as reversed_order from events where event_id % 2 = 0 group by 1),
  j as (select job as document, arg_max(status, (ts, event)) as job_status, arg_max(case when status = 'failed' then concat('error ', event::varchar) else '' end, (ts, event)) as job_error from v_jobs group by 1)
  select d.c_custkey as document, coalesce(scans, 0)::bigint as scans, coalesce(units, 0)::bigint as units, strftime(newest, '%Y-%m-%d') as newest, latest_kind, coalesce(needs_review, false) as needs_review, coalesce(rotation, 0)::int as rotation, coalesce(reversed_order, false) as reversed_order, job_status, nullif(job_error, '') as job_error
  from customer d left join c on d.c_custkey = c.document left join r on d.c_custkey = r.document left join j on d.c_custkey = j.document""")
def agg_document_overview(v):
    """Every document that was read, with its scans, units, rotation and latest job."""
    unsure = (F.col("seg_conf") < 70) | (F.col("class_conf") < 70)
    units = v("units").select("document", F.floor(F.col("unit") / 4).alias("scan"), "unit", "kind", "created", unsure.alias("unsure"))
    e = F.col("event_id")
    rotations = v("events").where("event_id % 2 = 0").select(F.col("user_id").alias("document"), F.col("ts").alias("created"), e.alias("result"), ((e % 7 % 3) * 90).cast("int").alias("rotation"), (e % 4 == 0).alias("reversed_order"))
    error = F.when(F.col("status") == "failed", F.concat(F.lit("error "), F.col("event").cast("string")))
    found = latest.document_overview(v("customer").select(F.col("c_custkey").alias("document")), units, rotations, v("jobs").select(F.col("job").alias("document"), F.col("ts").alias("created"), F.col("event").alias("job"), "status", error.alias("error")))
    return found.withColumn("newest", F.date_format("newest", "yyyy-MM-dd"))


@_register("select document, round(avg(coalesce(nullif(seg_conf, 0), 0)), 6) as with_nulls, round(avg(nullif(class_conf, 0)), 6) as without_nulls from v_units group by 1")
def agg_scan_confidence(v):
    null0 = lambda c: F.nullif(F.col(c), F.lit(0))
    return v("units").groupBy("document").agg(F.round(F.avg(F.coalesce(null0("seg_conf"), F.lit(0))), 6).alias("with_nulls"), F.round(F.avg(null0("class_conf")), 6).alias("without_nulls"))


_AXES = """axes as (select unit, arg_min(lower(value), (ordinal, value)) filter (where kind = 'organization') as party, arg_min(lower(value), (ordinal, value)) filter (where kind = 'place') as context, arg_min(lower(value), (ordinal, value)) filter (where kind = 'address') as subject from v_mentions group by unit)"""


_IDENTITIES = f"""{_AXES}, res as (select unit, 'utility_bill' as specialist, case when unit % 7 > 0 then cast(period_from as varchar) end as f, case when unit % 7 > 1 then cast(period_to as varchar) end as t, case when unit % 3 > 0 then cast(due_date as varchar) end as due, cast(issue_date as varchar) as issued from v_bills
    union all select distinct unit, 'accounting_statement', concat(year - 1, '-07-01'), concat(year, '-06-30'), null, null from v_charges),
  filed as (select u.unit, coalesce(r.specialist, u.kind) as family, a.context, a.party, a.subject, coalesce(case when f is not null and t is not null then case when left(f, 7) = left(t, 7) then left(f, 7) else concat(left(f, 7), '/', left(t, 7)) end end, left(f, 7), left(t, 7), left(due, 7), left(issued, 7)) as period, r.specialist is not null as special
    from v_units u left join axes a on u.unit = a.unit left join res r on u.unit = r.unit),
  counted as (select *, (family is not null)::int + (context is not null)::int + (party is not null)::int + (subject is not null)::int + (period is not null)::int as n from filed),
  identity as (select unit, family, context, party, subject, period, case when special and n >= 4 then 85 when special and n >= 3 then 75 when n >= 3 then 65 when n >= 2 then 50 when n >= 1 then 35 else 15 end as confidence from counted)"""


@_register(f"with {_IDENTITIES} select * from identity")
def prj_archive_identity(v):
    """What every unit is filed under: family, context, party, subject and period, and how sure that is; some bills lack dates."""
    first = lambda k, name: F.min_by(F.when(F.col("kind") == k, F.lower("value")), F.when(F.col("kind") == k, F.struct("ordinal", "value"))).alias(name)
    axes = v("mentions").groupBy("unit").agg(first("organization", "party"), first("place", "context"), first("address", "subject"))
    some = lambda c, yes: F.when(yes, F.col(c).cast("string")).alias(c)
    u, always = F.col("unit"), F.lit(True)
    bill = v("bills").select("unit", F.lit("utility_bill").alias("specialist"), some("period_from", u % 7 > 0), some("period_to", u % 7 > 1), some("due_date", u % 3 > 0), some("issue_date", always))
    none = F.lit(None).cast("string")
    year = F.col("year")
    statement = v("charges").select("unit", "year").distinct().select("unit", F.lit("accounting_statement").alias("specialist"), F.concat((year - 1).cast("string"), F.lit("-07-01")).alias("period_from"), F.concat(year.cast("string"), F.lit("-06-30")).alias("period_to"), none.alias("due_date"), none.alias("issue_date"))
    return rules.identities(v("units").select("unit", F.col("kind").alias("family")), axes, bill.unionByName(statement))


_STORED = "stored as (select case when unit % 10 = 2 then -unit else unit end as unit, family, case when unit % 10 = 1 then 'elsewhere' when unit % 10 = 3 then null else context end as context, party, subject, period, case when unit % 10 = 4 then confidence + 1 else confidence end as confidence from identity where unit % 10 <> 0)"


@_register(f"""with {_IDENTITIES}, {_STORED}
  select coalesce(i.unit, s.unit) as unit, case when s.unit is null then 'insert' when i.unit is null then 'delete' when i.context is not distinct from s.context and i.confidence = s.confidence then 'unchanged' else 'update' end as change, i.family, i.context, i.party, i.subject, i.period, coalesce(i.confidence, 0) as confidence from identity i full join stored s on i.unit = s.unit""")
def apply_identity_changes(v):
    """Derived identities against stored ones, which lack some, hold others of old, and have some that are gone: what changes."""
    new = written(prj_archive_identity(v), "identities")
    t = F.col("unit") % 10
    stored = new.where(t != 0).select(F.when(t == 2, -F.col("unit")).otherwise(F.col("unit")).alias("unit"), "family", F.when(t == 1, "elsewhere").when(t != 3, F.col("context")).alias("context"), "party", "subject", "period", (F.col("confidence") + (t == 4).cast("int")).alias("confidence"))
    return latest.change_feed(stored, new, "unit").drop("hash").na.fill(0, ["confidence"])


@_register(f"with {_BREAKDOWN} select context, account, period, n_categories, n_totals from breakdown where status = 'inconsistent_total'")
def flt_accounting_statements(v):
    return accounting.period_breakdown(v("facts")).where("status = 'inconsistent_total'").select("context", "account", "period", "n_categories", "n_totals")


@_register("select unit, topic, confidence, nth from (select unit, topic, confidence, row_number() over (partition by unit order by confidence desc, topic) as nth from (select unit, topic, max(confidence) as confidence from v_assignments group by 1, 2)) where nth <= 3")
def topk_per_group(v):
    best = v("assignments").groupBy("unit", "topic").agg(F.max("confidence").alias("confidence"))
    return latest.best_per_key(best, ["unit"], [F.desc("confidence"), F.col("topic")], 3).select("unit", "topic", "confidence", "nth")


@_register("select unit, document, created from v_units order by created desc, unit limit 60")
def topk_global(v):
    return v("units").select("unit", "document", "created").orderBy(F.desc("created"), "unit").limit(60)


@_register("select sha, min(upload) as first_upload, count(*) as n from v_uploads group by sha")
def st_ingest_dedup(v):
    return v("uploads").groupBy("sha").agg(F.min("upload").alias("first_upload"), F.count(F.lit(1)).alias("n"))


@_register("with p as (select topic, topic // 8 as grp from v_topics) select topic, (grp * 8)::bigint as component from p")
def cl_merge_chains(v):
    """Chains of merges resolved to their ends."""
    t = v("topics").where("topic % 8 <> 0").select(F.col("topic").alias("a"), (F.col("topic") - 1).alias("b"))
    found = components(t).withColumnRenamed("node", "topic")
    return v("topics").select("topic").join(found, "topic", "left").select("topic", F.coalesce("component", "topic").alias("component"))


# Further parts register themselves in the same tables.
from docspark import queries_clustering, queries_consolidation, queries_knowledge, queries_merging, queries_more, queries_pages, queries_rules, queries_statements  # noqa: E402, F401
