"""Beyond parity: the panel's counts and alarms over a stream of events."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_counts(events: DataFrame, ts: str = "ts", keys: tuple[str, ...] = ("event_type",), late: str = "1 day") -> DataFrame:
    """Events a day and key; days close once the watermark passes them, so state stays bounded."""
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    counts = timed.groupBy(F.window("_ts", "1 day").alias("w"), *keys).agg(F.count("*").alias("n"))
    return counts.select(F.to_date("w.start").alias("date"), *keys, "n")


def sessions(events: DataFrame, ts: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    timed = events.withColumn("_ts", F.col(ts).cast("timestamp")).withWatermark("_ts", late)
    rows = timed.groupBy(F.session_window("_ts", gap).alias("w"), key).agg(F.count("*").alias("n"))
    return rows.select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
