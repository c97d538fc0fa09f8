"""Points in intervals, by an equi-join on bins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def points_within(points: DataFrame, spans: DataFrame, key: str, point: str, start: str, end: str) -> DataFrame:
    """Rows of both sides where the key is equal and ``point`` lies in ``start``..``end`` (whole numbers, both included), each pair once.

    A span of n places lies in one or two bins of the power of two from n on, so a bin that it meets has fewer than four times as many
    places as the span itself; a point lies in one bin of each width that spans have. Only those widths (at most 64 numbers)
    reach the driver. Long spans aren't cut into many pieces, and short ones never meet a whole key. Rows with
    nulls and spans that end before they start meet nothing.
    """
    good = spans.where(f"{key} is not null and {start} <= {end}")
    width = F.ceil(F.log2((F.col(end) - F.col(start) + 1).cast("double"))).cast("int")
    good = good.withColumn("_width", width)
    found = sorted(r[0] for r in good.select("_width").distinct().collect())
    bin_of = lambda x, w: F.floor(F.col(x) / F.pow(F.lit(2.0), w)).cast("long")
    low, high = bin_of(start, F.col("_width")), bin_of(end, F.col("_width"))
    good = good.withColumn("_bin", F.explode(F.sequence(low, high)))
    places = F.array(*(F.struct(F.lit(w).alias("_width"), bin_of(point, F.lit(w)).alias("_bin")) for w in found)) if found else F.array().cast("array<struct<_width:int,_bin:bigint>>")
    spread = points.where(F.col(point).isNotNull()).withColumn("_at", F.explode(places)).withColumns({"_width": F.col("_at._width"), "_bin": F.col("_at._bin")}).drop("_at")
    met = spread.join(good, [key, "_width", "_bin"]).where(F.col(point).between(F.col(start), F.col(end)))
    return met.drop("_width", "_bin")
