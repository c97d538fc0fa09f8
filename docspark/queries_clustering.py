"""Topics clustered within their classes, and the SQL that walks through them one by one."""

from __future__ import annotations

from pyspark.sql import functions as F

from docspark.operators import clustering, rules
from docspark.queries import _register, _topic_tokens
from docspark.queries_more import _anchors
from docspark.queries_rules import _named_anchors, _SIGNED

_THRESHOLD = "case topic_class " + " ".join(f"when '{c}' then {t}::double" for c, t in clustering.THRESHOLDS.items()) + f" else {clustering.OTHERWISE}::double end"


def _likeness(a: str, b: str) -> str:
    return f"len(list_intersect({a}, {b}))::double / (len({a}) + len({b}) - len(list_intersect({a}, {b})))"


#: ``walk`` goes through each class in order of topics and keeps the list of leaders.
_CLUSTERED = f"""{_SIGNED},
  t as (select s.topic, topic_class, {_THRESHOLD} as least, list_distinct(string_split(signature, '|')) as parts, tokens, array_to_string(list_sort(tokens), ' ') as joined,
    row_number() over (partition by topic_class order by topic) as nth from signed s where topic in (select topic from v_topics where is_active)),
  likely as (select a.topic_class, a.topic as a, b.topic as b, a.least, {_likeness('a.parts', 'b.parts')} as by_parts, case when len(a.tokens) = 0 or len(b.tokens) = 0 then 0.0::double
    else least(1.0::double, {_likeness('a.tokens', 'b.tokens')} + case when contains(a.joined, b.joined) or contains(b.joined, a.joined) then {clustering.INSIDE}::double else 0.0::double end) end as by_title
    from t a join t b on a.topic_class = b.topic_class and a.topic < b.topic),
  near as (select topic_class, a, b, greatest(by_parts, by_title) as score from likely where greatest(by_parts, by_title) >= least),
  earlier as (select b as topic, list(a) as who from near group by b),
  walk(topic_class, nth, leaders) as (select topic_class, 0::bigint, []::bigint[] from (select distinct topic_class from t)
    union all select w.topic_class, t.nth, case when e.who is not null and list_has_any(e.who, w.leaders) then w.leaders else list_append(w.leaders, t.topic) end
    from walk w join t on t.topic_class = w.topic_class and t.nth = w.nth + 1 left join earlier e on e.topic = t.topic),
  led as (select unnest(leaders) as topic from (select topic_class, arg_max(leaders, nth) as leaders from walk group by 1))"""


@_register(f"with recursive {_CLUSTERED} select topic, topic as leader, 1.0::double as score from led union all select b, arg_min(a, (-score, a)), round(max(score), 6) from near where a in (select topic from led) and b not in (select topic from led) group by b")
def cl_topics_by_class(v):
    """Active topics of each class around their oldest ones, by its threshold: signatures, words of titles, titles inside others."""
    t = _topic_tokens(v("topics").where("is_active"))
    signed = rules.signatures(t.select("topic", "topic_class", "title", "tokens"), _named_anchors(_anchors(v, t)))
    found = clustering.topic_clusters(t.join(signed, "topic").select("topic", "topic_class", F.col("tokens").alias("words"), "signature"))
    return found.select("topic", "leader", F.round("score", 6).alias("score"))
