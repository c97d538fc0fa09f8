"""Accounting facts: totals checked against components, periods compared, categories that changed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

#: Cents by which a reported total may differ from its components.
TOLERANCE = 2


def period_breakdown(facts: DataFrame) -> DataFrame:
    """Per (context, account, role, period): components, reported total and how they agree. ``facts`` has these keys,
    category, cents and is_total."""
    keys = ["context", "account", "role", "period"]
    parts = facts.groupBy(*keys).agg(
        F.sum(F.when(~F.col("is_total"), F.col("cents"))).alias("components"),
        F.count_if(F.col("is_total")).alias("n_totals"),
        F.max(F.when(F.col("is_total"), F.col("cents"))).alias("reported"),
        F.count_distinct(F.when(~F.col("is_total"), F.col("category"))).alias("n_categories"),
    )
    status = (
        F.when((F.col("n_categories") == 0) & (F.col("n_totals") == 0), "missing")
        .when(F.col("n_categories") == 0, "missing_components")
        .when(F.col("n_totals") > 1, "ambiguous_total")
        .when((F.col("n_totals") == 1) & (F.abs(F.col("reported") - F.col("components")) > TOLERANCE), "inconsistent_total")
        .otherwise("validated")
    )
    return parts.withColumn("status", status).withColumn("reported", F.when(F.col("n_totals") == 1, F.col("reported")))


def period_over_period(breakdown: DataFrame) -> DataFrame:
    """Each period against the one before it of the same (context, account, role), in one window."""
    w = Window.partitionBy("context", "account", "role").orderBy("period")
    df = breakdown.withColumns({"period_a": F.lag("period").over(w), "cents_a": F.lag("components").over(w), "status_a": F.lag("status").over(w)}).where("period_a is not null")
    delta = F.col("components") - F.col("cents_a")
    both = (F.col("status") == "validated") & (F.col("status_a") == "validated")
    return df.select(
        "context", "account", "role", "period_a", F.col("period").alias("period_b"), "cents_a", F.col("components").alias("cents_b"), delta.alias("delta"),
        F.when(F.col("cents_a") != 0, F.bround(delta.cast("double") * 100 / F.col("cents_a"), 2)).alias("percent"),
        F.when(delta > 0, "up").when(delta < 0, "down").otherwise("same").alias("direction"),
        F.when(F.col("cents_a").isNull() | F.col("components").isNull(), "insufficient_data").when(both, "comparable").otherwise("needs_review").alias("comparison"),
    )


def category_changes(facts: DataFrame, period_a: int, period_b: int) -> DataFrame:
    """Category totals of two periods side by side; unchanged ones are left out."""
    parts = facts.where(~F.col("is_total") & F.col("period").isin(period_a, period_b))
    total = lambda p: F.coalesce(F.sum(F.when(F.col("period") == p, F.col("cents"))), F.lit(0)).alias
    df = parts.groupBy("context", "account", "category").agg(total(period_a)("cents_a"), total(period_b)("cents_b"))
    delta = F.col("cents_b") - F.col("cents_a")
    percent = F.when(F.col("cents_a") != 0, F.bround(delta.cast("double") * 100 / F.col("cents_a"), 2))
    return df.withColumn("delta", delta).withColumn("percent", percent).where("delta <> 0")


def subjects(facts: DataFrame) -> DataFrame:
    """Accounts met in a context: facts, periods and units."""
    return facts.groupBy("context", "account").agg(F.count(F.lit(1)).alias("n_facts"), F.count_distinct("unit").alias("n_units"), F.array_join(F.sort_array(F.collect_set("period")), ",").alias("periods"))


def first_scope(links: DataFrame, units: DataFrame) -> DataFrame:
    """Each unit's scope: the node of its earliest link, else the unit itself."""
    first = links.groupBy("unit").agg(F.min_by("node", F.struct("ordinal", "node")).alias("node"))
    return units.select("unit").join(first, "unit", "left").select("unit", F.coalesce("node", F.concat(F.lit("document_unit:"), F.col("unit").cast("string"))).alias("scope"))


def confidence(filled: list[Column], base: float, step: float, cap: float) -> Column:
    """``base`` and ``step`` for each column that isn't null, at most ``cap``."""
    return F.least(F.lit(cap), F.round(F.lit(base) + sum((F.when(c.isNotNull(), 1).otherwise(0) for c in filled), F.lit(0)) * step, 4))
