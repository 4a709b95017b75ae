"""Exact quantiles pooled over all rows of a group, without gathering the group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets per unit of the logarithm. Doubles reach log1p of 710, so a column has at most 1.5 million buckets.
RESOLUTION = 1024


def _bucket(v: Column) -> Column:
    """A whole number that never falls while ``v`` grows."""
    return F.floor(F.signum(v) * F.log1p(F.abs(v)) * RESOLUTION)


def pooled_quantiles(df: DataFrame, values: tuple[str, ...], rates: tuple[float, ...], by: tuple[str, ...] = ()) -> DataFrame:
    """``by``, rate and one column per value: its quantiles with linear interpolation between ranks.

    Rows are counted by distinct value, spread over all tasks by that value. A histogram of
    buckets, whose number has a bound whatever the rows, tells the buckets that hold the wanted
    ranks (two a rate at most); only the values of those are put in order. Nulls and NaN are left
    out; a group without values has null quantiles, and no rows at all still give a row for
    each rate if there is no ``by``.
    """
    keys = [*by, "_what"]
    each = F.array(*(F.struct(F.lit(v).alias("_what"), F.nanvl(F.col(v).cast("double"), F.lit(None)).alias("_v")) for v in values))
    counts = df.select(*by, F.inline(each)).groupBy(*keys, "_v").agg(F.count("*").alias("_n")).withColumn("_b", _bucket(F.col("_v")))
    present = counts.filter(F.col("_v").isNotNull())

    upto = Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)
    bars = present.groupBy(*keys, "_b").agg(F.sum("_n").alias("_n"))
    bars = bars.withColumn("_below", F.sum("_n").over(upto) - F.col("_n")).withColumn("_last", F.sum("_n").over(Window.partitionBy(*keys)) - 1)
    low, high = F.floor("_at"), F.ceil("_at")
    at = bars.withColumn("rate", F.explode(F.array(*(F.lit(float(r)) for r in rates)))).withColumn("_at", F.col("rate") * F.col("_last"))
    at = at.filter((high >= F.col("_below")) & (low < F.col("_below") + F.col("_n")))
    wanted = at.groupBy(*keys, "_b").agg(F.first("_below").alias("_below"), F.collect_list(F.struct("rate", "_at")).alias("_ranks"))

    inside = Window.partitionBy(*keys, "_b").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    ranked = present.join(wanted, [*keys, "_b"]).withColumn("_end", F.col("_below") + F.sum("_n").over(inside))
    ranked = ranked.select(*keys, "_v", "_end", (F.col("_end") - F.col("_n")).alias("_start"), F.inline("_ranks"))
    holds = lambda rank: F.max(F.when((rank >= F.col("_start")) & (rank < F.col("_end")), F.col("_v")))
    ends = ranked.groupBy(*keys, "rate").agg(holds(low).alias("_lo"), holds(high).alias("_hi"), F.first("_at").alias("_at"))
    between = (high - F.col("_at")) * F.col("_lo") + (F.col("_at") - low) * F.col("_hi")
    found = ends.withColumn("_q", F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).otherwise(between))
    found = found.groupBy(*by, "rate").agg(*(F.max(F.when(F.col("_what") == v, F.col("_q"))).alias(v) for v in values))

    groups = counts.select(*by).distinct() if by else df.sparkSession.range(1).select()
    return groups.select(*by, F.explode(F.array(*(F.lit(float(r)) for r in rates))).alias("rate")).join(found, [*by, "rate"], "left")
