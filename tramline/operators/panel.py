"""Long panels: one row per series and day, gaps filled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import PanelError
from ..functions.text import series_id

KEYS = ["line_id", "station_id"]


def densify(obs: DataFrame, value: str = "value", fill: float | None = None, keys: list[str] | None = None, carry: list[str] | None = None) -> DataFrame:
    """Every series on every day between the first and last date of the whole table.

    ``obs`` has ``keys``, ``date`` and ``value``, a row at most per key and date. Each row
    knows the next date of its series, so the gap behind it is a sequence to explode; the ends
    are stretched to the span of the table. That is one shuffle on the series, which later
    windows reuse, and no join but with one row. ``carry`` columns are constant per key.
    """
    keys = keys or KEYS
    span = obs.agg(F.min("date").alias("_from"), F.max("date").alias("_to"))
    w = Window.partitionBy(*keys).orderBy("date")
    rows = obs.crossJoin(F.broadcast(span)).withColumns({"_next": F.lead("date").over(w), "_first": F.lag("date").over(w).isNull()})
    start = F.when(F.col("_first"), F.col("_from")).otherwise(F.col("date"))
    end = F.coalesce(F.date_sub("_next", 1), F.col("_to"))
    rows = rows.withColumn("_day", F.explode(F.sequence(start, end)))
    filled = F.when(F.col("_day") == F.col("date"), F.col(value)).otherwise(F.lit(fill).cast("double"))
    return rows.select(*keys, *(carry or []), F.col("_day").alias("date"), filled.alias(value))


def with_series(df: DataFrame) -> DataFrame:
    return df.withColumn("series_id", series_id(F.col("line_id"), F.col("station_id")))


def assert_rectangular(panel: DataFrame, keys: list[str] | None = None) -> None:
    """Raise unless there is one row for each pair and day of the span."""
    keys = keys or KEYS
    r = panel.agg(F.count("*").alias("n"), F.count_distinct(F.struct(*keys)).alias("pairs"), F.count_distinct("date").alias("dates"), (F.datediff(F.max("date"), F.min("date")) + 1).alias("span")).first()
    if r["n"] != r["pairs"] * r["dates"] or (r["dates"] and r["dates"] != r["span"]):
        raise PanelError(f"{r['n']} rows for {r['pairs']} pairs and {r['dates']} dates over {r['span']} days")


def rectangular_panel(rows: DataFrame, ambiguous: str = "is_duplicate") -> DataFrame:
    """The dense panel of canonical rows, with rows marked ambiguous voided.

    Pairs that only have ambiguous rows are left out; the span is that of all rows; the name of
    a station is the most frequent one, the smallest of equally frequent ones.
    """
    span = rows.agg(F.min("date").alias("_from"), F.max("date").alias("_to"))
    sure = rows.filter(~F.col(ambiguous))
    w = Window.partitionBy(*KEYS)
    named = sure.withColumn("station_name", F.expr("mode(station_name, true)").over(w))
    seq = Window.partitionBy(*KEYS).orderBy("date")
    ends = named.crossJoin(F.broadcast(span)).withColumns({"_next": F.lead("date").over(seq), "_first": F.lag("date").over(seq).isNull()})
    start = F.when(F.col("_first"), F.col("_from")).otherwise(F.col("date"))
    out = ends.withColumn("_day", F.explode(F.sequence(start, F.coalesce(F.date_sub("_next", 1), F.col("_to")))))
    return out.select(F.col("_day").alias("date"), *KEYS, "station_name", F.when(F.col("_day") == F.col("date"), F.col("ridership").cast("double")).alias("ridership"))


def to_wide(panel: DataFrame, value: str = "value", series: list[str] | None = None) -> DataFrame:
    """A column per series, for export only; the first non-null value of a cell counts."""
    grouped = panel.groupBy("date").pivot("series_id", series) if series else panel.groupBy("date").pivot("series_id")
    return grouped.agg(F.first(value, ignorenulls=True)).orderBy("date")


def same_weekday_lag(horizon: Column | int):
    """Days from the origin back to the newest day with the target's weekday."""
    if isinstance(horizon, int):
        return -(-horizon // 7) * 7 - horizon
    return F.ceil(horizon / F.lit(7)).cast("int") * 7 - horizon
