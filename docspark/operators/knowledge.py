"""What units say, and searching it: typed assertions, topics by slug, hits by field, review payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from docspark.functions.text import bounded

LABEL = 1024
AXES = ("document_family", "context_key", "primary_party_key", "subject_key", "period_key")
#: What a rationale may name as a reason.
FACTORS = ["stesso fornitore", "stesso condominio", "stesso indirizzo", "stessa persona", "stesso periodo", "stesso contesto", "same vendor", "same condominium", "same address", "same person", "same period", "same context", "entità corrispondente", "entita corrispondente"]


def _known(x: Column) -> Column:
    return F.when(~F.lower(F.trim(x)).isin("", "unknown"), x)


def _stated(df: DataFrame, source: str, values: dict[str, Column]) -> DataFrame:
    """One row for each value that isn't null; one scan of ``df``."""
    rows = F.array(*(F.struct(F.lit(p).alias("predicate"), c.cast("string").alias("object")) for p, c in values.items()))
    return df.select("unit", F.lit(source).alias("source"), F.explode(F.filter(rows, lambda r: r["object"].isNotNull())).alias("r")).select("unit", "source", "r.predicate", "r.object")


def assertions(units: DataFrame, about: DataFrame, bills: DataFrame, statements: DataFrame) -> DataFrame:
    """(unit, source, predicate, object): what is known of each unit, in fifteen predicates.

    ``units`` has unit, kind; ``about`` unit, node; ``bills`` the fields of bills; ``statements`` unit, statement_type, period_from,
    period_to, validation. A bill whose issuer is given but is no usable label states nothing at all. Values that
    are empty or ``unknown``, and labels that are too long or hold tables, are left out."""
    span = F.when(F.col("period_from").isNotNull() | F.col("period_to").isNotNull(), F.concat(F.coalesce("period_from", F.lit("")), F.lit(".."), F.coalesce("period_to", F.lit(""))))
    issuer, holder = bounded(F.col("issuer"), LABEL), F.nullif(bounded(F.col("holder"), LABEL), F.lit(""))
    usable = _known(F.col("issuer")).isNull() | (F.coalesce(issuer, F.lit("")) != "")
    node = lambda kind, x: F.when(x.isNotNull(), F.concat(kind, F.lit(":"), x))
    person = F.when(F.lower(holder).contains("condominio"), "organization").otherwise("person")
    place = F.when(F.col("node").isNull(), F.nullif(bounded(F.col("reference"), LABEL), F.lit("")))
    plain = {"service_type": "service", "issue_date": "issue_date", "due_date": "due_date", "payment_status": "payment_status", "document_number": "number", "contract_code": "contract", "supply_code": "supply"}
    bill = {"document_type": F.lit("utility_bill"), "issued_by": node(F.lit("organization"), _known(issuer)), "addressed_to": node(person, holder), "about": node(F.lit("address"), place)}
    bill |= {p: _known(F.col(c).cast("string")) for p, c in plain.items()} | {"covers_period": span, "amount_total": F.round(F.col("total") * 100).cast("long")}
    statement = {"document_type": F.lit("accounting_statement"), "statement_type": _known(F.col("statement_type")), "covers_period": span, "validation_status": F.col("validation")}
    parts = [
        _stated(units, "classification", {"document_type": F.col("kind")}),
        _stated(about, "entity", {"about": F.col("node")}),
        _stated(bills.where(usable).join(about, "unit", "left"), "utility_bill", bill),
        _stated(statements, "accounting_statement", statement),
    ]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def upserted_topics(topics: DataFrame, payloads: DataFrame) -> DataFrame:
    """(slug, topic, title, topic_class, topic_kind, description, is_active) after ``payloads`` (the same columns but topic and
    is_active, and nth): topics with a payload's slug are refreshed and active, others are made (topic null); of several
    payloads of a slug the last counts."""
    rest = ["title", "topic_class", "topic_kind", "description"]
    new = payloads.where("slug is not null").groupBy("slug").agg(F.max_by(F.struct(*rest), "nth").alias("new"))
    df = topics.select("slug", "topic", *rest, "is_active").join(new, "slug", "full")
    pick = lambda c: F.when(F.col("new").isNotNull(), F.col(f"new.{c}")).otherwise(F.col(c)).alias(c)
    return df.select("slug", "topic", *map(pick, rest), (F.col("new").isNotNull() | F.coalesce("is_active", F.lit(False))).alias("is_active"))


def added_aliases(upserted: DataFrame, aliases: DataFrame, given: DataFrame) -> DataFrame:
    """(slug, alias) of ``given`` that are new: neither slug nor title nor one of ``aliases`` (slug, alias) of the topic, in any
    case; of those that differ in case only the first."""
    low = lambda df, c: df.select("slug", F.lower(c).alias("low")).where("low is not null")
    known = low(upserted, F.col("slug")).unionByName(low(upserted, F.col("title"))).unionByName(low(aliases, F.col("alias"))).distinct()
    new = given.where("alias is not null").withColumn("low", F.lower("alias")).join(known, ["slug", "low"], "left_anti")
    return new.groupBy("slug", "low").agg(F.min("alias").alias("alias")).select("slug", "alias")


def hits(df: DataFrame, key: str, fields: dict[str, str], queries: list[str]) -> DataFrame:
    """(key, query, field) of every field of a row that holds a query, in any case. Queries are trimmed; those shorter than two
    letters find nothing. One scan for all of them; ``queries`` is a list of the caller's, not a table."""
    asked = [q.strip() for q in dict.fromkeys(queries) if len(q.strip()) >= 2]
    if not asked:
        return df.select(key, F.lit("").alias("query"), F.lit("").alias("field")).where("false")
    rows = [F.when(F.coalesce(F.contains(F.lower(F.col(c)), F.lit(q.lower())), F.lit(False)), F.struct(F.lit(q).alias("query"), F.lit(name).alias("field"))) for q in asked for name, c in fields.items()]
    return df.select(key, F.explode(F.array_compact(F.array(*rows))).alias("h")).select(key, "h.query", "h.field")


def found(parts: list[DataFrame], key: str, order: list[str]) -> DataFrame:
    """(key, query, fields): the different fields of each hit, in the order given."""
    all_ = parts[0]
    for p in parts[1:]:
        all_ = all_.unionByName(p)
    mine = all_.groupBy(key, "query").agg(F.collect_set("field").alias("s"))  # at most as many as there are fields
    return mine.select(key, "query", F.concat_ws(",", *(F.when(F.array_contains("s", f), f) for f in order)).alias("fields"))


def proposal_payloads(proposals: DataFrame, candidates: DataFrame, k: int = 5) -> DataFrame:
    """(proposal, matched, missing, candidates, factors): axes of the unit's identity that are known and that aren't, its ``k`` best
    candidates, and up to five reasons that the rationale names.

    ``proposals`` has proposal, rationale and the axes; ``candidates`` proposal, topic, score."""
    w = Window.partitionBy("proposal").orderBy(F.desc("score"), "topic")
    best = candidates.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= k).groupBy("proposal").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "topic"))), lambda x: x["topic"].cast("string")), ",").alias("candidates"))
    has = lambda a: F.coalesce(F.col(a), F.lit("")) != ""
    reason = F.lower(F.coalesce("rationale", F.lit("")))
    factors = F.slice(F.array_compact(F.array(*(F.when(reason.contains(x), x) for x in FACTORS))), 1, 5)
    df = proposals.join(best, "proposal", "left")
    return df.select("proposal", F.concat_ws(",", *(F.when(has(a), a) for a in AXES)).alias("matched"), F.concat_ws(",", *(F.when(~has(a), a) for a in AXES)).alias("missing"), F.coalesce("candidates", F.lit("")).alias("candidates"), F.array_join(factors, ",").alias("factors"))
