"""Rules on units, topics and facts: routing, titles, signatures, dominant axes, corrections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docspark.functions.text import family

#: Phrases by which units are sent to specialists.
UTILITY = ["bolletta", "fornitura", "data di emissione", "entro quando devo pagare", "totale bolletta", "numero cliente", "rif.bolletta", "pod", "pdr", "energia elettrica", "gas", "acqua"]
ACCOUNTING = ["bilancio preventivo", "rendiconto", "riparto", "preventivo ripartizioni", "saldo finale", "totale gestione", "esercizio", "spese deliberate", "importi", "totali"]
#: What the signatures of a class begin with.
PREFIXES = {"financial_period": "financial", "general_administration": "general", "vendor_relationship": "vendor", "meeting": "meeting", "legal_matter": "legal", "case_file": "case", "building_issue": "building", "other": "other"}


def specialists(document_type: Column, text: Column) -> Column:
    """Specialists that a unit goes to, by its type and how many of their phrases it holds."""
    low = F.lower(text)
    hits = lambda words: sum((low.contains(w).cast("int") for w in words), F.lit(0))
    kind = F.coalesce(document_type, F.lit(""))
    bill = (kind == "bolletta") | ((kind == "fattura") & (hits(UTILITY) >= 3)) | (hits(UTILITY) >= 5)
    statement = kind.isin("rendiconto_contabile", "riparto_spese") | (hits(ACCOUNTING) >= 4)
    return F.array_compact(F.array(F.when(bill, "utility_bill"), F.when(statement, "accounting_statement")))


def pipeline_family(text: Column) -> Column:
    """Family of a text by the first of its words that decides."""
    has = lambda *words: F.greatest(*(F.lower(text).contains(w) for w in words), F.lit(False))
    return (
        F.when(has("regolamento") & has("art.", "articolo"), "normative")
        .when(has("verbale", "convocazione"), "meeting")
        .when(has("bolletta", "servizio idrico", "pod", "pdr"), "utility_vendor")
        .when(has("rendiconto", "riparto", "fattura"), "financial")
        .otherwise("general")
    )


def signatures(topics: DataFrame, anchors: DataFrame) -> DataFrame:
    """(topic, signature): class, the anchors that its class goes by, and family; without an anchor three words of the title.

    ``topics`` has topic, topic_class, title, tokens; ``anchors`` topic and address, organization, person, place (the
    commonest of each, or null)."""
    df = topics.join(anchors, "topic", "left")
    a, o, p, l = (F.col(c) for c in ("address", "organization", "person", "place"))  # noqa: E741
    kind, fam, none = F.col("topic_class"), family(F.col("title")), F.lit(None).cast("string")
    by = lambda financial, general, meeting, vendor, rest: F.when(kind == "financial_period", financial).when(kind == "general_administration", general).when(kind == "meeting", meeting).when(kind == "vendor_relationship", vendor).otherwise(rest)
    first = by(F.coalesce(a, o, l), F.coalesce(a, o, p, l), F.coalesce(a, o, l), o, F.coalesce(a, o, l, p))
    second = by(none, F.nullif(F.coalesce(o, p), first), none, F.coalesce(p, a, l), none)
    last = F.when(kind == "meeting", "assembly").otherwise(fam)
    prefix = F.coalesce(F.create_map(*(F.lit(x) for pair in PREFIXES.items() for x in pair))[kind], kind)
    known = F.array_compact(F.array(prefix, first, second, last))
    return df.select("topic", F.when(first.isNotNull(), known).otherwise(F.concat(F.array(prefix), F.slice(F.array_sort("tokens"), 1, 3))).alias("signature"))


def dominant(values: DataFrame, axes: list[str], parts: int | None = None) -> DataFrame:
    """Per topic the commonest value of each axis, ties to the smallest; ``values`` has topic and the axes (null where unknown).
    A topic's rows go to one of ``parts`` tasks as they are (as Spark sees fit without it): neither its counts nor its best values are shuffled."""
    held = values.select("topic", *axes)
    held = held.repartition(parts, "topic") if parts else held.repartition("topic")
    entries = F.explode(F.array(*(F.struct(F.lit(x).alias("axis"), F.col(x).cast("string").alias("value")) for x in axes)))
    n = held.select("topic", entries.alias("e")).where("e.value is not null").groupBy("topic", "e.axis", "e.value").agg(F.count(F.lit(1)).alias("n"))
    best = n.groupBy("topic", "axis").agg(F.min(F.struct(-F.col("n"), F.col("value").alias("value")))["value"].alias("value"))
    return best.groupBy("topic").agg(*(F.max(F.when(F.col("axis") == x, F.col("value"))).alias(x) for x in axes))


def corrected(facts: DataFrame, corrections: DataFrame) -> DataFrame:
    """Human corrections found again in regenerated facts: correction, status, and what the fact becomes.

    ``facts`` has unit, account_key, fact_type, accounting_role, period_from, position, category, amount, is_total, evidence
    (a string or null); ``corrections`` correction, the same anchor columns with evidence or the old category, amount and
    is_total, and new_amount. Evidence decides where it is given; of several facts the first position counts."""
    keys = ["unit", "account_key", "fact_type", "accounting_role", "period_from"]
    c, f = corrections.alias("c"), facts.alias("f")
    same = F.col("f.unit") == F.col("c.unit")
    for k in keys[1:]:
        same &= F.col(f"f.{k}").eqNullSafe(F.col(f"c.{k}"))
    old = F.col("f.category").eqNullSafe(F.col("c.category")) & (F.col("f.amount") == F.col("c.amount")) & (F.col("f.is_total") == F.col("c.is_total"))
    fits = F.when(F.col("c.evidence").isNotNull(), F.col("f.evidence") == F.col("c.evidence")).otherwise(old)
    met = c.join(f, same & fits).groupBy("c.correction").agg(F.min(F.struct("f.position", F.col("f.amount").alias("amount"))).alias("hit"))
    df = corrections.join(met, "correction", "left")
    status = F.when(F.col("hit").isNotNull(), "reapplied").otherwise("unmatched_after_reprocessing")
    return df.select("correction", status.alias("status"), F.col("hit.position").alias("position"), F.col("hit.amount").alias("before"), F.when(F.col("hit").isNotNull(), F.col("new_amount")).alias("after"))


def unit_titles(units: DataFrame, bills: DataFrame, statements: DataFrame) -> DataFrame:
    """(unit, title): the given one, else one made of the unit's bill, its statement, its kind and entities, its pages.

    ``units`` has unit, title, kind, organization, place, start_page, end_page; ``bills`` unit, service, issuer, holder,
    period_from; ``statements`` unit, label, context, period_from. Parts that are missing are left out."""
    df = units.join(bills.select("unit", "service", "issuer", "holder", F.left("period_from", F.lit(7)).alias("bill_month")), "unit", "left")
    df = df.join(statements.select("unit", "label", "context", F.left("period_from", F.lit(7)).alias("month")), "unit", "left")
    made = lambda *parts: F.nullif(F.concat_ws(" - ", *parts), F.lit(""))
    bill = F.when(F.col("issuer").isNotNull(), made("service", "issuer", "holder", "bill_month"))
    statement = F.when(F.col("label").isNotNull(), made("label", "context", "month"))
    named = F.when(F.col("kind") == "meeting_minutes", made(F.lit("Verbale"), "place")).when(F.col("kind") == "regulation", made(F.lit("Regolamento"), "place"))
    pages = F.concat(F.lit("Pagine "), F.col("start_page").cast("string"), F.lit("-"), F.col("end_page").cast("string"))
    return df.select("unit", F.coalesce(F.nullif(F.trim("title"), F.lit("")), bill, statement, named, made("organization"), pages).alias("title"))


def identities(units: DataFrame, axes: DataFrame, results: DataFrame) -> DataFrame:
    """(unit, family, context, party, subject, period, confidence): what a unit is filed under, and how sure that is.

    ``units`` has unit, family; ``axes`` unit, context, party, subject (or null); ``results`` unit, specialist, period_from, period_to, due_date,
    issue_date (ISO texts or null), at most one row a unit: a specialist's family counts before the unit's. The period is a month,
    or two parted by a slash, from the result's period, else its due or issue date. Confidence grows with the axes that are
    known, and with a specialist's result, in hundredths."""
    df = units.join(axes, "unit", "left").join(results, "unit", "left")
    month = lambda c: F.left(c, F.lit(7))
    both = F.when(month("period_from") == month("period_to"), month("period_from")).otherwise(F.concat_ws("/", month("period_from"), month("period_to")))
    period = F.coalesce(F.when(F.col("period_from").isNotNull() & F.col("period_to").isNotNull(), both), month("period_from"), month("period_to"), month("due_date"), month("issue_date"))
    df = df.select("unit", F.coalesce("specialist", "family").alias("family"), "context", "party", "subject", period.alias("period"), F.col("specialist").isNotNull().alias("special"))
    filled = sum((F.col(c).isNotNull().cast("int") for c in ("family", "context", "party", "subject", "period")), F.lit(0))
    sure = F.when(F.col("special") & (filled >= 4), 85).when(F.col("special") & (filled >= 3), 75).when(filled >= 3, 65).when(filled >= 2, 50).when(filled >= 1, 35).otherwise(15)
    return df.select("unit", "family", "context", "party", "subject", "period", sure.alias("confidence"))
