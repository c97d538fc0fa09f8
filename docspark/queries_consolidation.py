"""Queries on bills, topic retrieval, merge suggestions, decisions and proposals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark import bridge
from docspark.functions import text as fn
from docspark.operators import bills, consolidation, contexts
from docspark.queries import _register, _topic_tokens, _STOP as _TITLE_STOP, _TOKENS

# --- bills -----------------------------------------------------------------------------------------------------------

_SERVICE = "case when issuer like 'Enel%' then 'electricity' else 'water' end"


@_register(f"""select unit, issuer, holder, issue_date::varchar as issue_date, due_date::varchar as due_date, cents, concat('BL', code) as number, concat('C', code) as contract, concat('IT', code) as supply, 'VIA ROMA 12, SCANDICCI' as reference,
  period_from::varchar as period_from, period_to::varchar as period_to, payment_status, {_SERVICE} as service from v_bills""")
def fn_bill_fields(v):
    """Thirteen fields read out of printed bills."""
    f = bills.bill_fields(bridge.bill_texts(v("bills")))
    return f.withColumn("cents", F.round(F.col("total") * 100).cast("long")).drop("total")


@_register(f"select unit, payment_status, {_SERVICE} as service from v_bills")
def fn_payment_status(v):
    """Status and service by the words of a bill."""
    df = bridge.bill_texts(v("bills"))
    return df.select("unit", bills.payment_status(F.col("text")).alias("payment_status"), bills.service_type(F.col("text")).alias("service"))


@_register("select unit, 0.98::double as confidence from v_bills")
def agg_extraction_confidence(v):
    """How complete each bill's fields are."""
    return bills.bill_confidence(bills.bill_fields(bridge.bill_texts(v("bills"))))


@_register("""select unit, issuer, due_date::varchar as due_date, payment_status from v_bills where contains(lower(concat_ws(' ', issuer, holder, concat('BL', code), concat('C', code), concat('IT', code), 'VIA ROMA 12, SCANDICCI')), 'building')
  and contains(lower(issuer), 'enel') and due_date < date '1998-01-01' and payment_status <> 'paid' order by due_date desc, unit limit 100""")
def flt_utility_bills(v):
    """Bills that a text query and an issuer fit, overdue as of a day, newest first, at most 100 (the listing's page)."""
    f = bills.bill_fields(bridge.bill_texts(v("bills")))
    text = F.lower(F.concat_ws(" ", "issuer", "holder", "number", "contract", "supply", "reference"))
    df = f.where(text.contains("building") & F.lower("issuer").contains("enel") & (F.col("due_date") < "1998-01-01") & (F.col("payment_status") != "paid"))
    return df.orderBy(F.desc("due_date"), "unit").limit(100).select("unit", "issuer", "due_date", "payment_status")


_NUMBERED = "concat_ws(' ', title, summary, case unit % 5 when 0 then concat('protbl', lpad(cast(unit - 3 as {0}), 8, '0'), 'bis ricevuta') when 1 then concat('Acquedotto: dettaglio e pagamento dal ', cast(month as {0})) when 2 then concat('al ', cast(last_day(month) as {0}), ' publiacquaservizi, letture') end)"


@_register(f"""with h as (select unit as other, document_type, lower({_NUMBERED.format('varchar')}) as hay from v_notes),
  d as (select *, regexp_matches(hay, '\\b(dettaglio|consumi|letture|componenti tariffarie|totale bolletta)\\b') as detail, regexp_matches(hay, '\\b(pagamento|quietanza|ricevuta|bonifico|estratto conto|mav|pagata)\\b') as paid from h),
  b as (select unit, concat('bl', code) as number, list_distinct(regexp_extract_all(lower(issuer), '[a-z0-9]{{3,}}')) as tokens, cast(period_from as varchar) as f, cast(period_to as varchar) as t from v_bills),
  m as (select b.unit, d.*, contains(hay, number) as n, contains(hay, f) as cf, contains(hay, t) as ct, len(list_filter(tokens, lambda x: contains(hay, x))) >= greatest(1, len(tokens) // 2) as i from b join d on b.unit <> d.other),
  s as (select unit, other, case when paid then 'utility_bill_payment' when detail then 'utility_bill_detail' else 'utility_bill_reference' end as link_type,
    least(95, n::int * 55 + i::int * 25 + cf::int * 10 + ct::int * 10 + detail::int * 12 + paid::int * 14 + case when paid or detail then 0 when document_type in ('bolletta', 'fattura') then 5 when document_type in ('lettera', 'nota') then 3 else 0 end) as points from m)
  select * from (select *, row_number() over (partition by unit order by points desc, other) as nth from s where points >= 45) where nth <= 5""")
def join_bill_links(v):
    """Each bill's five best related units, by number, issuer, period and words, also inside longer words."""
    notes = v("notes").select("unit", "document_type", F.expr(_NUMBERED.format("string")).alias("haystack"))
    return bills.bill_links(bills.bill_fields(bridge.bill_texts(v("bills"))), notes)


# --- retrieval -------------------------------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(consolidation.STOPWORDS))
_NOT_ANCHOR = ", ".join(f"'{w}'" for w in consolidation.GENERIC + consolidation.STREETS)


def _words(x: str) -> str:
    return rf"list_distinct(list_filter(string_split_regex(lower({x}), '[^\p{{L}}\p{{N}}_]+'), lambda w: regexp_full_match(w, '[a-zàéìòù]{{3,}}') and w not in ({_STOP})))"


def _anchored(x: str) -> str:
    return f"list_filter({_words(f'''replace({x}, '_', ' ')''')}, lambda w: w not in ({_NOT_ANCHOR}))"


@_register(f"select doc_id, len({_words('text')}) as n_tokens, array_to_string(list_sort({_anchored('text')})[1:3], '_') as anchor from documents")
def fn_retrieval_tokens(v):
    """Words by which a text is found, and the first three in order that tell it from others."""
    text = F.col("text")
    return v("documents").select("doc_id", F.size(consolidation.retrieval_tokens(text)).cast("long").alias("n_tokens"), F.array_join(F.slice(F.array_sort(consolidation.anchor_tokens(text)), 1, 3), "_").alias("anchor"))


@_register(f"""select distinct value, array_to_string(list_distinct_in_order[1:3], '_') as anchor from (select value, list_filter(w, lambda x, i: list_position(w, x) = i) as list_distinct_in_order from (select value, list_filter(string_split_regex(lower(value), '[^a-z0-9]+'), lambda x: length(x) >= 3 and not regexp_full_match(x, '[0-9]+') and x not in ({_TITLE_STOP})) as w from (select value from v_mentions union select title from v_topics)))""")
def fn_anchor_value(v):
    """The words of a value by which entities are told apart."""
    values = v("mentions").select("value").union(v("topics").select("title")).distinct()
    return values.select("value", consolidation.anchor_value(F.col("value"), fn.STOP).alias("anchor"))


_FAMILY = "case " + " ".join(f"when contains(lower(title), '{w}') then '{f}'" for w, f in fn.FAMILIES.items()) + " end"


@_register(f"select topic, title, {_FAMILY} as family from v_topics")
def fn_topic_family(v):
    return v("topics").select("topic", "title", fn.family(F.col("title")).alias("family"))


_SPECIFIC = r"(regexp_matches(lower(title), '\b(19|20)\d{2}\b') or regexp_matches(lower(title), '\b(fattura|bolletta|n\.|nr\.|num\.|numero)\s*\d') or (len(string_split_regex(trim(title), '\s+')) <= 3 and topic_kind = 'entity') or regexp_matches(lower(title), '\b(pagamento|versamento|rata)\b'))"


@_register(f"select topic, title, {_SPECIFIC} as specific from v_topics")
def flt_specific_topic(v):
    """Titles of one document rather than a lasting matter."""
    return v("topics").select("topic", "title", consolidation.specific(F.col("title"), F.col("topic_kind")).alias("specific"))


@_register("select topic, title, topic_kind, class from v_topics where is_active and topic_kind = 'issue' and class in ('ECONOMY', 'STANDARD')")
def flt_topics(v):
    """Active topics of a kind and some classes."""
    return v("topics").where("is_active and topic_kind = 'issue' and class in ('ECONOMY', 'STANDARD')").select("topic", "title", "topic_kind", "class")


_VALUES = "select distinct lower(value) as pattern from v_mentions union select distinct p_name from part"


@_register(f"select t.topic as id, p.pattern from v_topics t join ({_VALUES}) p on contains(lower(t.title), p.pattern)")
def scan_patterns(v):
    """Which entity values and names occur in which topics' titles."""
    values = v("mentions").select(F.lower("value").alias("pattern")).union(v("part").select("p_name"))
    return consolidation.scan_patterns(v("topics").select(F.col("topic").alias("id"), F.lower("title").alias("text")), values)


_ENTITIES = "e as (select unit, 'address' as kind, lower(brand) as value, lower(replace(brand, '#', '-')) as normalized from v_notes union all select unit, 'condominio', 'via verdi 3', 'via_verdi' from v_notes where unit % 5 = 0)"
_FIT = " ".join(f"when document_type = '{k}' and topic_class = '{c}' then {n}" for k, some in consolidation.COMPATIBLE.items() for c, n in some.items())


@_register(f"""with {_ENTITIES}, t as (select *, {_words('title')} as tw, {_words('slug')} as sw, {_words('description')} as dw, {_SPECIFIC} as specific,
    case when regexp_matches(lower(concat_ws(' ', title, slug, description)), '\\b(condominio|via|viale|piazza|corso|largo|vicolo|strada|localit[aà])\\b') then {_anchored("concat_ws(' ', title, slug, description)")} else [] end as anchor from v_topics where is_active),
  ti as (select topic, unnest(tw) as w from t), si as (select topic, unnest(sw) as w from t), di as (select topic, unnest(dw) as w from t),
  u as (select unit, unnest({_words('title')}) as w from v_notes), m as (select unit, unnest({_words('summary')}) as w from v_notes),
  ev as (select v.value, t.topic from (select distinct value from e) v join t on contains(lower(t.title), v.value) or contains(t.slug, v.value)), en as (select v.normalized, t.topic from (select distinct normalized from e) v join t on contains(t.slug, v.normalized)),
  p as (select unit, topic, sum(points) as points from (
    select unit, topic, count(*) * 30 as points from u join ti on u.w = ti.w group by 1, 2 union all select unit, topic, count(*) * 25 from u join si on u.w = si.w group by 1, 2
    union all select distinct unit, topic, 20 from e join ev on e.value = ev.value union all select distinct unit, topic, 25 from e join en on e.normalized = en.normalized
    union all select unit, topic, count(*) * 10 from m join ti on m.w = ti.w group by 1, 2 union all select unit, topic, count(*) * 5 from m join di on m.w = di.w group by 1, 2
    union all select n.unit, t.topic, 0 from v_notes n join t on case {_FIT} else 0 end > 0) group by 1, 2),
  a as (select topic, count(*) as n from v_assignments group by 1), pl as (select unit, list({_anchored('normalized')}) as places from e group by 1),
  s as (select p.unit, p.topic, (p.points + case {_FIT} else 0 end)::double / case when t.specific and coalesce(a.n, 0) <= 1 then 2 else 1 end as score
    from p join t on p.topic = t.topic join v_notes n on p.unit = n.unit join pl on p.unit = pl.unit left join a on p.topic = a.topic where not (len(t.anchor) > 0 and len(list_filter(pl.places, lambda x: len(x) > 0 and not list_has_any(x, t.anchor))) > 0))
  select unit, topic, least(score, 100)::double as points, nth, score >= 70 as strong from (select *, row_number() over (partition by unit order by score desc, topic) as nth from s) where nth <= 10""")
def join_retrieve_topics(v):
    """The ten best topics of every unit, by nine signals."""
    n = v("notes")
    place = n.select("unit", F.lit("address").alias("kind"), F.col("brand").alias("value"), F.lower(F.replace("brand", F.lit("#"), F.lit("-"))).alias("normalized"))
    other = n.where("unit % 5 = 0").select("unit", F.lit("condominio").alias("kind"), F.lit("Via Verdi 3").alias("value"), F.lit("via_verdi").alias("normalized"))
    counts = v("assignments").groupBy("topic").agg(F.count(F.lit(1)).alias("n"))
    return consolidation.retrieved(n, place.unionByName(other), v("topics"), counts)


# --- consolidation ---------------------------------------------------------------------------------------------------

_AXIS = "case topic_kind when 'family' then 'document_family' when 'issue' then 'case_or_issue' else 'subject' end"
_SETS = f"""x as (select t.topic, {_AXIS} as axis, {_FAMILY} as family, {_TOKENS} as tokens from v_topics t where is_active),
  ae as (select a.topic, list(distinct m.value) as entities from v_assignments a join v_mentions m on a.unit = m.unit and a.line = m.ordinal and m.kind = 'organization' and m.confidence >= 9 group by 1),
  ad as (select a.topic, list(distinct u.document) as documents from v_assignments a join v_units u on a.unit = u.unit group by 1), aw as (select topic, count(*) * 1000000 + coalesce(sum(confidence), 0) as weight from v_assignments group by 1),
  pr as (select x.*, coalesce(weight, 0)::bigint as weight, coalesce(entities, []) as entities, coalesce(documents, []) as documents from x left join ae on x.topic = ae.topic left join ad on x.topic = ad.topic left join aw on x.topic = aw.topic)"""
_LIKE = "case when len(a.{0}) = 0 or len(b.{0}) = 0 then 0 else len(list_intersect(a.{0}, b.{0}))::double / len(list_distinct(list_concat(a.{0}, b.{0}))) end"
_SCORED = f"""pairs as (select a.axis, a.topic as a, b.topic as b, a.weight as wa, b.weight as wb, {_LIKE.format('entities')} as e, {_LIKE.format('tokens')} as t, {_LIKE.format('documents')} as d, coalesce((a.family = b.family)::int, 0) as f from pr a join pr b on a.axis = b.axis and a.topic < b.topic),
  scored as (select *, round(case axis when 'subject' then 60 * e + 25 * t + 15 * d + 0 * f when 'document_family' then 30 * e + 35 * t + 20 * d + 15 * f else 35 * e + 25 * t + 40 * d + 0 * f end, 6) as score from pairs),
  good as (select axis, case when wa >= wb then b else a end as source, case when wa >= wb then a else b end as target, score from scored where (e > 0 or t > 0) and (axis <> 'subject' or e >= 0.08 or t >= 0.34) and score >= case axis when 'subject' then 28 when 'document_family' then 32 else 30 end),
  best as (select axis, source, target, score, nth from (select *, row_number() over (partition by axis order by score desc, target, source) as nth from good) where nth <= 12)"""


def _profiles_of(v) -> DataFrame:
    """Axis, family, words, weight, sure entities and documents of every active topic."""
    a, m = v("assignments"), v("mentions").where("kind = 'organization' and confidence >= 9")
    kind = F.col("topic_kind")
    axis = F.when(kind == "family", "document_family").when(kind == "issue", "case_or_issue").otherwise("subject")
    entities = a.select("topic", "unit", F.col("line").alias("ordinal")).join(m.select("unit", "ordinal", "value"), ["unit", "ordinal"]).groupBy("topic").agg(F.collect_set("value").alias("entities"))
    documents = a.select("topic", "unit").join(v("units").select("unit", "document"), "unit").groupBy("topic").agg(F.collect_set("document").alias("documents"))
    weight = a.groupBy("topic").agg((F.count(F.lit(1)) * 1000000 + F.coalesce(F.sum("confidence"), F.lit(0))).alias("weight"))
    df = _topic_tokens(v("topics").where("is_active")).select("topic", axis.alias("axis"), fn.family(F.col("title")).alias("family"), "tokens")
    df = df.join(entities, "topic", "left").join(documents, "topic", "left").join(weight, "topic", "left")
    empty = lambda c, kind: F.coalesce(c, F.array().cast(f"array<{kind}>")).alias(c)
    return df.select("topic", "axis", "family", "tokens", F.coalesce("weight", F.lit(0)).alias("weight"), empty("entities", "string"), empty("documents", "bigint"))


@_register(f"with {_SETS}, {_SCORED} select * from best")
def join_merge_suggestions(v):
    """The twelve best merges of each axis, by weighted likeness of entities, words and documents."""
    return consolidation.merge_suggestions(_profiles_of(v))


@_register(f"with {_SETS}, {_SCORED} select axis, source, target, score, nth from best where (source + target) % 2 = 1")
def join_anti_reviewed(v):
    """Suggestions that nobody has reviewed for the same axis, source and target; reviews of half of them are given."""
    from docspark.plans.storage import written

    found = written(consolidation.merge_suggestions(_profiles_of(v)), "suggestions")
    reviews = found.where("(source + target) % 2 = 0").select("axis", "source", "target")
    return consolidation.unreviewed(found, reviews).select("axis", "source", "target", "score", "nth")


@_register("""with g as (select topic as source, topic - 1 as target from v_topics where topic % 10 = 5), p as (select a.unit, a.topic, a.role, u.document from v_assignments a join v_units u on a.unit = u.unit),
  s as (select distinct g.source, p.document from g join p on p.topic = g.target)
  select p.unit, p.topic, case when s.source is not null then 'secondary' else p.role end as role, s.source is not null and p.role <> 'secondary' as changed from p join g on p.topic = g.source left join s on s.source = p.topic and s.document = p.document""")
def secondary_on_shared_docs(v):
    """Assignments of topics that become secondary to another where both are on a document."""
    merges = v("topics").where("topic % 10 = 5").select(F.col("topic").alias("source"), (F.col("topic") - 1).alias("target"))
    return consolidation.made_secondary(v("assignments").select("unit", "topic", "role"), v("units"), merges)


@_register(f"with p as (select topic, class, {_TOKENS} as tokens from v_topics) select a.topic as a, b.topic as b, round(len(list_intersect(a.tokens, b.tokens))::double / len(list_distinct(list_concat(a.tokens, b.tokens))), 6) as score, array_to_string(list_sort(list_intersect(a.tokens, b.tokens)), ' ') as shared from p a join p b on a.class = b.class and a.topic < b.topic and len(list_intersect(a.tokens, b.tokens)) * 10 >= len(list_distinct(list_concat(a.tokens, b.tokens))) * 6")
def set_jaccard(v):
    """Pairs of topics of a class whose title words are alike by 0.6 or more, with what they share."""
    p = _topic_tokens(v("topics")).select("topic", F.col("class").alias("axis"), F.array_sort("tokens").alias("tokens"))
    return consolidation.alike_sets(p, 6, {"score": F.round("score", 6), "shared": F.array_join("shared", " ")})


@_register("""with m as (select unit, document, lower(value) as context, confidence / 10.0 as confidence from v_mentions where kind = 'place'), d as (select document, context, max(confidence) as most from m group by 1, 2), o as (select unit, context, max(confidence) as own from m group by 1, 2)
  select u.unit, d.context, case when o.own is not null then 'direct' else 'document_scope' end as role, coalesce(o.own, least(d.most, 0.8))::double as confidence from v_units u join d on u.document = d.document left join o on o.unit = u.unit and o.context = d.context""")
def join_context_membership(v):
    m = v("mentions").where("kind = 'place'").select("unit", "document", F.lower("value").alias("context"), (F.col("confidence") / 10.0).alias("confidence"))
    return contexts.memberships(v("units"), m)


@_register("""with a as (select distinct topic, unit from v_assignments) select a.topic, a.unit, u.document, u.created, row_number() over (partition by a.topic order by u.created desc, a.unit desc) as nth from a join v_units u on a.unit = u.unit""")
def agg_topic_detail(v):
    """All units of every topic, newest document first."""
    from pyspark.sql import Window

    a = v("assignments").select("topic", "unit").distinct().join(v("units").select("unit", "document", "created"), "unit")
    nth = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("created"), F.desc("unit")))
    return a.select("topic", "unit", "document", "created", nth.alias("nth"))


@_register("""with e as (select unit, string_agg(concat(kind, ':', value), ',' order by ordinal, kind, value) as entities from v_mentions group by unit), a as (select unit, string_agg(concat(topic, ':', role), ',' order by topic, role) as topics from (select distinct unit, topic, role from v_assignments) group by unit),
  u as (select u.*, coalesce(e.entities, '') as entities, coalesce(a.topics, '') as topics from v_units u left join e on u.unit = e.unit left join a on u.unit = a.unit) select document, string_agg(concat(unit, '[', entities, '][', topics, ']'), ';' order by unit) as content, count(*) as units from u group by document""")
def agg_document_knowledge(v):
    """Documents with their units, and these with their entities and assignments: each child is gathered before its join."""
    inner = F.array_sort(F.collect_list(F.struct("ordinal", "kind", "value")))
    e = v("mentions").groupBy("unit").agg(F.array_join(F.transform(inner, lambda x: F.concat_ws(":", x["kind"], x["value"])), ",").alias("entities"))
    roles = F.array_sort(F.collect_set(F.struct("topic", "role")))
    a = v("assignments").groupBy("unit").agg(F.array_join(F.transform(roles, lambda x: F.concat_ws(":", x["topic"].cast("string"), x["role"])), ",").alias("topics"))
    u = v("units").select("unit", "document").join(e, "unit", "left").join(a, "unit", "left").na.fill("", ["entities", "topics"])
    rows = F.array_sort(F.collect_list(F.struct("unit", "entities", "topics")))
    one = lambda x: F.concat(x["unit"].cast("string"), F.lit("["), x["entities"], F.lit("]["), x["topics"], F.lit("]"))
    return u.groupBy("document").agg(F.array_join(F.transform(rows, one), ";").alias("content"), F.count(F.lit(1)).alias("units"))


@_register("""with v0 as (select 'place' as kind, n_name as key, n_nationkey % 5 as canonical from nation), d as (select 'place' as kind, n_name as key, n_nationkey % 3 as canonical, 1 as nth from nation where n_nationkey % 7 = 0 union all select 'place', n_name, 9, 2 from nation where n_nationkey % 14 = 0 union all select 'organization', s_name, s_suppkey % 5, 1 from supplier where s_suppkey % 6 = 0),
  l as (select kind, key, arg_max(canonical, nth) as canonical from d group by 1, 2), n as (select * from l union all select kind, key, canonical from v0 where (kind, key) not in (select (kind, key) from l))
  select canonical::int as canonical, max(m.value) as display, count(distinct (n.kind, n.key)) as variants, count(distinct m.document) as documents from n left join v_mentions m on m.kind = n.kind and m.value = n.key group by 1""")
def cl_canonical_merge(v):
    """Keys attached to canonical entities, some of them moved twice."""
    n, s = v("nation"), v("supplier")
    place = lambda df, canonical, nth: df.select(F.lit("place").alias("kind"), F.col("n_name").alias("key"), canonical.cast("int").alias("canonical"), F.lit(nth).alias("nth"))
    decisions = place(n.where("n_nationkey % 7 = 0"), F.col("n_nationkey") % 3, 1).unionByName(place(n.where("n_nationkey % 14 = 0"), F.lit(9), 2))
    decisions = decisions.unionByName(s.where("s_suppkey % 6 = 0").select(F.lit("organization").alias("kind"), F.col("s_name").alias("key"), (F.col("s_suppkey") % 5).cast("int").alias("canonical"), F.lit(1).alias("nth")))
    mentions = v("mentions").select("kind", F.col("value").alias("key"), "value", "document")
    return consolidation.canonical_merged(place(n, F.col("n_nationkey") % 5, 0).drop("nth"), decisions, mentions)


@_register(r"""with k as (select reference, arg_min(topic, (rank, topic)) as topic from (select topic::varchar as reference, 0 as rank, topic from v_topics union all select slug, 1, topic from v_topics union all select lower(title), 2, topic from v_topics) group by 1),
  d as (select d.unit, d.nth as line, d.decision, lower(trim(d.reference)) as reference, k.topic from v_decisions d left join k on lower(trim(d.reference)) = k.reference),
  a as (select *, case when decision like 'assign%' and topic is not null then 'assigned' when decision = 'propose_new' and topic is not null then 'matched_existing' when decision = 'propose_new' then 'proposed' else 'unresolved' end as action from d),
  s as (select *, case when action = 'proposed' then trim(regexp_replace(reference, '[^a-z0-9]+', '-', 'g'), '-') end as slug from a)
  select unit, line, action, topic, slug, action = 'proposed' and row_number() over (partition by action, slug order by unit, line) = 1 as creates, case when action in ('assigned', 'matched_existing') then 'auto_accepted' else 'needs_review' end as status from s""")
def apply_topic_decisions(v):
    """Decisions on units' topics carried out: assigned, matched, proposed or left for review."""
    decisions = v("decisions").select("unit", F.col("nth").alias("line"), "decision", "reference")
    return consolidation.topic_decisions(decisions, v("topics").select("topic", "slug", "title"))


@_register()
def cl_scan_proposals(v):
    """Proposals of a document whose anchors are alike, each kept by the first."""
    p = v("notes").join(v("units").select("unit", F.col("document").alias("scan")), "unit")
    anchor = F.replace(F.lower(F.concat_ws("_", F.col("title"), F.col("document_type"))), F.lit(" "), F.lit("_"))
    return consolidation.scan_proposals(p.select("scan", F.col("unit").alias("proposal"), anchor.alias("anchor")))


@_register(r"""select doc_id, regexp_replace(regexp_replace(lower(trim(text, chr(32) || chr(9) || chr(10) || chr(12) || chr(13))), '[ \t\n\f\r]+', '_', 'g'), '[^a-z0-9_./-]+', '', 'g') as normalized, trim(regexp_replace(lower(text), '[^a-z0-9]+', '_', 'g'), '_') as key from documents""")
def fn_entity_normalize(v):
    """Values and proposals as keys, of whole texts."""
    text = F.lower("text")
    normalized = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"^[ \t\n\f\r]+|[ \t\n\f\r]+$", ""), r"[ \t\n\f\r]+", "_"), "[^a-z0-9_./-]+", "")
    return v("documents").select("doc_id", normalized.alias("normalized"), F.regexp_replace(F.regexp_replace(text, "[^a-z0-9]+", "_"), "^_+|_+$", "").alias("key"))


@_register("select job, arg_max(status, (ts, event)) as status, max(ts) as ts, count(*) filter (where status = 'failed') as failures, arg_max(event, (ts, event)) filter (where status = 'failed') as last_failure from v_jobs group by job")
def st_latest_status(v):
    """Each job's latest status, kept current by merging a batch's latest into the ones before."""
    from docspark.streaming.jobs import merged_status

    jobs = v("jobs")
    early, late = jobs.where("ts < timestamp '2024-01-15'"), jobs.where("ts >= timestamp '2024-01-15'")
    return merged_status(merged_status(None, early), late).select("job", "status", "ts", "failures", "last_failure")
