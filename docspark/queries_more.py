"""The second part of the archive's queries: text rules, retrieval, consolidation, proposals, nested views."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docspark.functions import text as fn
from docspark.operators import clustering, fuzzy, latest, topics
from docspark.plans.storage import written
from docspark.queries import _TOKENS, _register


@_register("select unit, case when kind = 'utility_bill' then concat(class_conf::varchar, ' EUR') when kind = 'accounting_statement' then concat(strftime(created, '%Y'), ' - ', (extract(year from created) + 1)::varchar) when length(title) <= 1024 then title end as display from v_units")
def prj_context_key_values(v):
    year = F.year("created")
    money = F.concat(F.col("class_conf").cast("string"), F.lit(" EUR"))
    span = F.concat_ws(" - ", year.cast("string"), (year + 1).cast("string"))
    return v("units").select("unit", F.when(F.col("kind") == "utility_bill", money).when(F.col("kind") == "accounting_statement", span).when(F.length("title") <= 1024, F.col("title")).alias("display"))


@_register("select (n_nationkey % 5)::int as canonical, count(distinct n_name) as variants, count(distinct m.document) as documents from nation join v_mentions m on m.kind = 'place' and m.value = n_name group by 1")
def agg_canonical_summary(v):
    n = v("nation").select((F.col("n_nationkey") % 5).alias("canonical"), F.col("n_name").alias("value"))
    return v("mentions").where("kind = 'place'").join(n, "value").groupBy("canonical").agg(F.count_distinct("value").alias("variants"), F.count_distinct("document").alias("documents"))


_ANCHOR = "anchor as (select topic, kind, value from (select *, row_number() over (partition by topic, kind order by n desc, length(value) desc, value) as nth from (select a.topic, m.kind, m.value, count(*) as n from (select distinct unit, topic from v_assignments) a join (select distinct unit, kind, value from v_mentions) m on a.unit = m.unit group by 1, 2, 3)) where nth = 1)"


def _anchors(v, of: DataFrame) -> DataFrame:
    """Anchors of the topics in ``of``, written once for all that reads them."""
    held = v("assignments").join(of.select("topic"), "topic", "left_semi")
    return written(topics.anchors(topics.topic_values(held, v("mentions"))), "anchors")


@_register("select scan, string_agg(concat('--- Page ', page::varchar, ' ---', chr(10), text), chr(10) order by page) as text from v_pages group by scan")
def agg_page_text(v):
    rows = F.array_sort(F.collect_list(F.struct("page", "text")))
    page = lambda p: F.concat(F.lit("--- Page "), p["page"].cast("string"), F.lit(" ---\n"), p["text"])
    return v("pages").groupBy("scan").agg(F.array_join(F.transform(rows, page), "\n").alias("text"))


@_register("select unit, kind, created, row_number() over (partition by kind order by created desc, unit) as nth from v_units qualify nth <= 20")
def sort_multi_key(v):
    return latest.best_per_key(v("units").select("unit", "kind", "created"), ["kind"], [F.desc("created"), F.col("unit")], 20)


@_register("select distinct lower(title) as alias from v_topics union select distinct lower(p_type) from part union select lower(n_name) from nation")
def set_alias_union(v):
    a = v("topics").select(F.lower("title").alias("alias"))
    return a.union(v("part").select(F.lower("p_type"))).union(v("nation").select(F.lower("n_name"))).distinct()


@_register(f"select topic, array_to_string(list_sort(list_filter({_TOKENS}, lambda x: x not in ('brand', 'small', 'large'))), ' ') as anchors from v_topics")
def set_tokens_minus(v):
    kept = F.array_except(fn.tokens(F.col("title")), F.array(F.lit("brand"), F.lit("small"), F.lit("large")))
    return v("topics").select("topic", F.array_join(F.sort_array(kept), " ").alias("anchors"))


@_register("select 'unit' as name, kind as value, count(*) as n from v_units group by 2 union all select 'mention', kind, count(*) from v_mentions group by 2 union all select 'topic', class, count(*) from v_topics group by 2")
def set_union_all(v):
    one = lambda name, table, c: v(table).groupBy(F.col(c).alias("value")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "value", "n")
    return one("unit", "units", "kind").unionByName(one("mention", "mentions", "kind")).unionByName(one("topic", "topics", "class"))


@_register()
def cl_duplicate_titles(v):
    """Titles alike by 0.9 or more, in groups around the first of each in order of titles."""
    return clustering.duplicate_titles(v("topics").select("topic", "title"))


@_register("select concat('nation:', context::varchar) as scope, concat('account_', account::varchar) as account_key, category, period, cents, is_total, (cents + 50) // 100 as units from v_facts where cents is not null")
def prj_accounting_facts(v):
    df = v("facts").where("cents is not null")
    return df.select(F.concat(F.lit("nation:"), F.col("context").cast("string")).alias("scope"), F.concat(F.lit("account_"), F.col("account").cast("string")).alias("account_key"), "category", "period", "cents", "is_total", F.expr("(cents + 50) div 100").alias("units"))


@_register("select distinct unit, kind, value, least(greatest(ordinal, 1) + 3, 9) as page from v_mentions where kind = 'place'")
def fn_entity_pages(v):
    df = v("mentions").where("kind = 'place'")
    return df.select("unit", "kind", "value", F.least(F.greatest("ordinal", F.lit(1)) + 3, F.lit(9)).alias("page")).distinct()


@_register("select event_id, (props::json->>'k')::bigint as k from events")
def fn_json_paths(v):
    return v("events").select("event_id", F.get_json_object("props", "$.k").cast("long").alias("k"))


@_register()
def fn_normalize_key(v):
    """Keys of mention values, folded to ASCII once for each distinct value."""
    return fuzzy.normalized_keys(v("mentions").select("value").unionByName(v("documents").select(F.col("text").alias("value"))))
