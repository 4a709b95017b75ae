"""Runs of days: service status, interruptions, network events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import PanelError

OPERATING, CLOSED, NOT_YET_OPEN, NOT_MEASURED, AMBIGUOUS = "operating", "closed", "not_yet_open", "not_measured", "ambiguous_label"
INTERRUPTIONS = [CLOSED, NOT_YET_OPEN, NOT_MEASURED]
MIN_CLOSURE_DAYS = 4
MIN_NETWORK_SIZE = 10


def _by(keys: list[str]):
    return Window.partitionBy(*keys)


def find_runs(df: DataFrame, flag: Column, keys: list[str], order: str = "date") -> DataFrame:
    """Maximal runs of rows where ``flag`` is true: keys, start, end (inclusive), days.

    A null flag breaks a run. Rows are counted, so with one row per day days are days.
    """
    seq = _by(keys).orderBy(order)
    f = F.coalesce(flag, F.lit(False))
    rows = df.select(*keys, F.col(order).alias("_o"), f.alias("_f"), F.row_number().over(seq).alias("_n"))
    island = F.col("_n") - F.row_number().over(Window.partitionBy(*keys, "_f").orderBy("_o"))
    return rows.withColumn("_i", island).filter("_f").groupBy(*keys, "_i").agg(F.min("_o").alias("start"), F.max("_o").alias("end"), F.count("*").alias("days")).drop("_i")


def network_outage_dates(panel: DataFrame, value: str = "ridership", keys: tuple[str, ...] = ("line_id", "station_id"), min_network_size: int = MIN_NETWORK_SIZE) -> DataFrame:
    """Dates on which every series of a network of some size reports zero; a null is no zero."""
    by_day = panel.groupBy("date").agg(F.count("*").alias("n"), F.count_if(F.col(value) == 0).alias("zeros"))
    size = panel.agg(F.count_distinct(F.struct(*keys)).alias("size"))
    return by_day.filter("n = zeros").join(F.broadcast(size), F.col("size") >= min_network_size).select("date")


def service_status(panel: DataFrame, value: str = "ridership", keys: tuple[str, ...] = ("line_id", "station_id"), min_closure_days: int = MIN_CLOSURE_DAYS, min_network_size: int = MIN_NETWORK_SIZE) -> DataFrame:
    """``panel`` with a ``status`` for every row.

    A run of at least ``min_closure_days`` zeros is ``not_yet_open`` where it begins the
    series and ``closed`` elsewhere; days of a network outage are ``not_measured`` whatever
    the run, though they count towards it; everything else is ``operating``.
    """
    missing = {"date", value, *keys} - set(panel.columns)
    if missing:
        raise PanelError(f"status needs columns {sorted(missing)}")
    keys = list(keys)
    seq = _by(keys).orderBy("date")
    zero = F.coalesce(F.col(value) == 0, F.lit(False))
    rows = panel.withColumns({"_z": zero, "_n": F.row_number().over(seq)})
    rows = rows.withColumn("_i", F.col("_n") - F.row_number().over(Window.partitionBy(*keys, "_z").orderBy("date")))
    island = Window.partitionBy(*keys, "_z", "_i")
    rows = rows.withColumns({"_len": F.count("*").over(island), "_start": F.min("_n").over(island)})
    outages = network_outage_dates(panel, value, tuple(keys), min_network_size).withColumn("_out", F.lit(True))
    long = F.col("_z") & (F.col("_len") >= min_closure_days)
    status = F.when(F.col("_out"), NOT_MEASURED).when(long & (F.col("_start") == 1), NOT_YET_OPEN).when(long, CLOSED).otherwise(OPERATING)
    return rows.join(outages, "date", "left").withColumn("status", status).select(*panel.columns, "status")


def with_target(panel: DataFrame, value: str = "ridership") -> DataFrame:
    """Null cells become ``ambiguous_label`` over any status; only operating days have a target."""
    status = F.when(F.col(value).isNull(), AMBIGUOUS).otherwise(F.col("status"))
    return panel.withColumn("status", status).withColumn("target", F.when(F.col("status") == OPERATING, F.col(value)))


def summarize_status(panel: DataFrame) -> DataFrame:
    """Rows and their share (4 digits) by status."""
    by = panel.groupBy("status").agg(F.count("*").alias("n_rows"))
    total = by.agg(F.sum("n_rows").alias("_t"))
    return by.crossJoin(F.broadcast(total)).select("status", "n_rows", F.round(F.col("n_rows") / F.col("_t"), 4).alias("share"))


def interruptions(panel: DataFrame, keys: tuple[str, ...] = ("line_id", "station_id")) -> DataFrame:
    """Runs of one status that isn't service: keys, status, start, end, days.

    Runs of different statuses that touch stay apart.
    """
    keys = list(keys)
    seq = _by(keys).orderBy("date")
    rows = panel.withColumn("_i", F.row_number().over(seq) - F.row_number().over(Window.partitionBy(*keys, "status").orderBy("date")))
    rows = rows.filter(F.col("status").isin(INTERRUPTIONS))
    return rows.groupBy(*keys, "status", "_i").agg(F.min("date").alias("start"), F.max("date").alias("end"), F.count("*").alias("days")).drop("_i")


def network_events(found: DataFrame, min_days: int = 7) -> DataFrame:
    """Interruptions of one line with the same status and span, as one event with its stations."""
    long = found.filter(F.col("days") >= min_days)
    events = long.groupBy("line_id", "status", "start", "end", "days").agg(F.count_distinct("station_id").alias("n_stations"), F.concat_ws("|", F.array_sort(F.collect_set("station_id"))).alias("stations"))
    return events.orderBy("start", "line_id", "status", "end")
