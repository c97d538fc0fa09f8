"""Queries on merged topics, families and reviewed proposals."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.operators import merging
from docspark.queries import _register, _topic_tokens, _TOKENS
from docspark.queries_consolidation import _FAMILY
from docspark.queries_more import _ANCHOR, _anchors
from docspark.queries_rules import _named_anchors

_WEIGHTS = """w as (select t.topic, coalesce(a.n, 0) as a, coalesce(p.n, 0) as p, coalesce(a.c, 0) + coalesce(p.c, 0) as c from v_topics t left join (select topic, count(*) as n, sum(confidence) as c from v_assignments group by 1) a on t.topic = a.topic
  left join (select topic, count(*) as n, sum(confidence) as c from v_proposals where topic is not null group by 1) p on t.topic = p.topic)"""
_TIED = f"{_WEIGHTS}, tied as (select topic, arg_max(topic, (a, p, c, -topic)) over (partition by topic // 10) as survivor from w)"
_NAMED = f"{_ANCHOR}, named as (select topic, max(case when kind = 'address' then lower(value) end) as ad, max(case when kind = 'organization' then lower(value) end) as org, max(case when kind = 'place' then lower(value) end) as pl from anchor group by 1)"


def _weighted(v):
    return merging.weights(v("topics"), v("assignments"), v("proposals"))


def _merges(v):
    """Chains of ten topics, each merged into the one before it."""
    t = v("topics").where("topic % 10 <> 0").select(F.col("topic").alias("source"), (F.col("topic") - 1).alias("target"))
    return merging.merged_map(t, _weighted(v))


@_register(f"""with {_TIED}, x as (select a.*, case when line % 3 > 0 then concat('line ', line::varchar) end as rationale, t.survivor from v_assignments a join tied t on a.topic = t.topic)
  select unit, survivor as topic, role, max(confidence) as confidence, arg_min(rationale, (topic <> survivor, topic, rationale)) filter (where rationale is not null) as rationale from x group by 1, 2, 3""")
def cl_apply_merges(v):
    """Assignments after chains of merges: the heaviest topic of a chain survives; repeated roles keep the best confidence and the first rationale."""
    rationale = F.when(F.col("line") % 3 > 0, F.concat(F.lit("line "), F.col("line").cast("string")))
    return merging.merged_assignments(v("assignments").withColumn("rationale", rationale), _merges(v))


@_register(f"""with {_TIED}, k as (select survivor, count(*) as n from tied group by 1)
  select t.topic, t.survivor, t.topic = t.survivor as is_active, w.a + w.p as moved from tied t join w on t.topic = w.topic join k on t.survivor = k.survivor where k.n > 1""")
def cl_merged_topics(v):
    """Topics of merges: which survive, and how many assignments and proposals each one brings."""
    w = _weighted(v).select("topic", (F.col("weight.assignments") + F.col("weight.proposals")).alias("moved"))
    return _merges(v).join(w, "topic").select("topic", "survivor", (F.col("topic") == F.col("survivor")).alias("is_active"), "moved")


@_register(f"""with {_TIED}, n as (select topic, unnest([slug, title]) as alias from v_topics), l as (select t.survivor as topic, alias from tied t join n on t.topic = n.topic where t.topic <> t.survivor)
  select topic, min(alias) as alias from l where not exists (select 1 from n where n.topic = l.topic and lower(n.alias) = lower(l.alias)) group by topic, lower(alias)""")
def cl_merged_aliases(v):
    """Slugs and titles of the topics that lost, as aliases of the one that survives."""
    return merging.merged_aliases(v("topics").select("topic", "slug", "title"), _merges(v))


@_register(f"""with {_NAMED}, {_WEIGHTS}, x as (select t.topic, t.topic_class, {_FAMILY} as family, coalesce(ad, pl) as near, org, coalesce(ad, org, pl) as first from v_topics t left join named n on t.topic = n.topic where t.is_active),
  g as (select *, case when topic_class = 'legal_matter' and family in ('privacy', 'contract', 'tax', 'cadastre') then 'admin_finance' when topic_class in ('financial_period', 'general_administration', 'vendor_relationship') then 'admin_finance' when topic_class in ('legal_matter', 'building_issue') then 'matter' end as grp from x),
  s as (select topic, case when grp = 'admin_finance' and org is not null then concat_ws('|', grp, org, case when near <> org then near end) when grp = 'admin_finance' and near is not null then concat_ws('|', grp, near, case when family in ('tax', 'statement', 'cadastre', 'privacy') then family end) when grp = 'matter' and first is not null then concat_ws('|', grp, first, family) end as key from g),
  b as (select key, count(*) as n, arg_max(s.topic, (a, p, c, -s.topic)) as survivor from s join w on s.topic = w.topic where key is not null group by 1)
  select s.topic, s.key, b.survivor from s join b on s.key = b.key where b.n > 1""")
def cl_topics_cross_class(v):
    """Active topics of compatible classes with one signature, and the heaviest of them, which survives."""
    active = v("topics").where("is_active")
    keyed = merging.cross_class(active, _named_anchors(_anchors(v, active))).withColumnRenamed("signature", "key")
    return merging.survivors(keyed, _weighted(v))


_MEETINGS = f"""{_NAMED}, {_WEIGHTS}, label as (select topic, coalesce(max(value) filter (where kind = 'address'), max(value) filter (where kind = 'organization'), max(value) filter (where kind = 'place')) as label from anchor group by 1),
  m as (select t.topic, case when coalesce(ad, org, pl) is not null then concat('a:', coalesce(ad, org, pl)) else concat('w:', array_to_string(list_sort({_TOKENS})[1:3], '_')) end as key, a, p, c from v_topics t left join named n on t.topic = n.topic join w on t.topic = w.topic where t.is_active and t.topic_class = 'meeting'),
  b as (select key, arg_max(topic, (a, p, c, -topic)) as first, sum(a) as a, sum(p) as p, sum(c) as c from m group by 1),
  h as (select b.*, concat_ws(' - ', 'Assemblee condominiali', l.label) as title, t.description from b join v_topics t on t.topic = b.first left join label l on l.topic = b.first),
  s as (select *, array_to_string(list_sort(list_filter({_TOKENS.replace('lower(title)', "lower(concat_ws(' ', title, description))")}, lambda y: y not in ('verbale', 'assemblea', 'condominiale', 'condominiali', 'ordinaria', 'straordinaria')))[1:4], '_') as signature from h),
  f as (select signature, arg_max(first, (a, p, c, -first)) as survivor from s group by 1),
  families as (select m.topic, s.first, s.title, f.survivor from m join s on m.key = s.key join f on s.signature = f.signature)"""


def _meetings(v):
    t = _topic_tokens(v("topics").where("is_active and topic_class = 'meeting'")).select("topic", "title", "description", "tokens")
    anchors = _anchors(v, t)
    labels = anchors.groupBy("topic").agg(*(F.max(F.when(F.col("kind") == k, F.col("value"))).alias(k) for k in ("address", "organization", "place")))
    labels = labels.select("topic", F.coalesce("address", "organization", "place").alias("label"))
    return merging.meeting_families(t, _named_anchors(anchors), labels, _weighted(v))


@_register(f"with {_MEETINGS} select * from families")
def cl_meeting_family(v):
    """Topics of meetings merged by anchor, renamed to a family, and merged again by the family's words."""
    return _meetings(v)


@_register(f"""with {_MEETINGS}, x as (select a.unit, f.first, a.confidence, a.topic, a.role from v_assignments a join families f on a.topic = f.topic join v_units u on a.unit = u.unit where u.kind = 'meeting_minutes'),
  n as (select unit, first as topic, 'document_family' as role, arg_min(confidence, (topic, role, confidence)) as confidence from x group by x.unit, x.first)
  select * from n where not exists (select 1 from v_assignments a where a.unit = n.unit and a.topic = n.topic and a.role = 'document_family')""".replace("arg_min(confidence, (topic, role, confidence))", "arg_min(x.confidence, (x.topic, x.role, x.confidence))"))
def cl_meeting_assignments(v):
    """Minutes put under the family of their meeting."""
    return merging.meeting_assignments(_meetings(v), v("assignments"), v("units"), "meeting_minutes")


_ACCOUNTS = f"""{_WEIGHTS}, u as (select unit from v_units where kind = 'accounting_statement'), e as (select unit, lower(value) as key, arg_min(value, (ordinal, value)) as value from v_mentions where unit in (select unit from u) group by 1, 2),
  mine as (select unit, arg_min(key, (-length(key), key)) as anchor, arg_min(value, (-length(key), key)) as value from e group by 1), held as (select m.unit, m.anchor, a.topic, a.role, t.topic_class, t.topic_kind from mine m join v_assignments a on m.unit = a.unit join v_topics t on a.topic = t.topic)"""


def _accounts(v):
    m = v("mentions").select("unit", F.lower("value").alias("key"), "value", "ordinal")
    t = v("topics").select("topic", "slug", "topic_class", "topic_kind")
    return merging.accounting_families(v("units").where("kind = 'accounting_statement'"), m, v("assignments"), t, _weighted(v))


@_register(f"""with {_ACCOUNTS}, best as (select anchor, arg_max(h.topic, (a, p, c, -h.topic)) as held from (select distinct anchor, topic from held where topic_class = 'financial_period') h join w on h.topic = w.topic group by 1),
  l as (select anchor, concat('Rendiconti Condominiali - ', arg_min(value, unit)) as title from mine group by 1)
  select m.unit, m.anchor, b.held as topic, l.title, trim(regexp_replace(lower(l.title), '[^a-z0-9]+', '-', 'g'), '-') as slug from mine m join l on m.anchor = l.anchor left join best b on m.anchor = b.anchor""")
def cl_accounting_family(v):
    """Each accounting unit's umbrella topic by its longest anchor: the heaviest financial one, else one to be made."""
    return _accounts(v)[0]


@_register(f"with {_ACCOUNTS} select distinct unit, topic, role from held where topic_class = 'meeting' and topic_kind = 'family'")
def cl_accounting_removals(v):
    """Assignments of accounting units to families of meetings, which go."""
    return _accounts(v)[1]


# --- proposals -------------------------------------------------------------------------------------------------------


@_register("select p.proposal, p.status, p.created, u.document, t.title as matched from v_proposals p left join v_units u on p.unit = u.unit left join v_topics t on p.topic = t.topic where p.status in ('proposed', 'merged_into_existing')")
def flt_proposals(v):
    """Proposals that wait or were merged, with their document and matched topic, newest first."""
    p = v("proposals").where(F.col("status").isin("proposed", "merged_into_existing"))
    df = p.join(v("units").select("unit", "document"), "unit", "left").join(v("topics").select("topic", F.col("title").alias("matched")), "topic", "left")
    return df.select("proposal", "status", "created", "document", "matched").orderBy(F.desc("created"), "proposal")


_DECIDED = """named as (select slug, min(topic) as named from v_topics group by 1),
  x as (select p.proposal, p.unit, p.slug, p.title, p.confidence, p.topic as matched, p.status as before, case when p.status = 'proposed' then r.action end as action, r.role, t.topic as found, n.named
    from v_proposals p left join v_reviews r on p.proposal = r.proposal left join v_topics t on t.topic = coalesce(r.target, p.topic) left join named n on p.slug = n.slug),
  d as (select *, case when action = 'reject' then 'rejected' when action in ('merge_into_existing', 'add_secondary_topic') and found is not null then 'approved' when action = 'approve_new_topic' then 'approved' end as done from x),
  decided as (select proposal, unit, slug, title, confidence, matched, coalesce(done, case when before = 'proposed' and action is null and matched is not null then 'merged_into_existing' end, before) as status, case when done is not null then action end as action, role,
    case when action in ('merge_into_existing', 'add_secondary_topic') then found when action = 'approve_new_topic' then named else matched end as topic, coalesce(action = 'approve_new_topic' and named is null, false) as is_new from d)"""


def _decided(v):
    return merging.reviewed(v("proposals").drop("created"), v("reviews"), v("topics").select("topic", "slug"))


@_register(f"with {_DECIDED} select proposal, status, action, topic, is_new from decided")
def apply_review_status(v):
    """Proposals after their reviews; those that wait with a matched topic are merged into it."""
    return _decided(v).select("proposal", "status", "action", "topic", "is_new")


@_register(f"""with {_DECIDED}, asg as (select unit, topic, case when role = 'subject' and line = 1 then 'primary' else role end as role, max(confidence) as confidence from v_assignments group by 1, 2, 3),
  gone as (select unit, matched, action from decided where action in ('reject', 'merge_into_existing')), merged as (select distinct unit from gone where action = 'merge_into_existing'),
  kept as (select a.* from asg a left join v_topics t on a.topic = t.topic where not exists (select 1 from gone g where g.unit = a.unit and g.matched = a.topic) and not (a.role = 'primary' and not coalesce(t.is_active, false) and a.unit in (select unit from merged))),
  new as (select unit, topic, case when is_new then slug end as slug, role, max(confidence) as confidence from decided where action is not null and action <> 'reject' group by 1, 2, 3, 4)
  select unit, topic, null::varchar as slug, role, confidence from kept k where not exists (select 1 from new n where n.unit = k.unit and n.topic = k.topic and n.role = k.role) union all select * from new""")
def apply_proposal_reviews(v):
    """Assignments after proposals were merged, added, approved as new topics or rejected."""
    role = F.when((F.col("role") == "subject") & (F.col("line") == 1), "primary").otherwise(F.col("role")).alias("role")
    held = v("assignments").select("unit", "topic", role, "confidence").groupBy("unit", "topic", "role").agg(F.max("confidence").alias("confidence"))
    return merging.assignments_after(_decided(v), held, v("topics"))
