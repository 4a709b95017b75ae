"""Demand panels over the sample tables: what plays the part of lines, stations and ridership."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.canonical import mark_duplicates
from ..operators.islands import service_status, with_target
from ..operators.panel import densify, rectangular_panel, with_series


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def orders_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sparse: orders a day by priority (line) and status (station); days without any are 0."""
    obs = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("line_id"), F.col("o_orderstatus").alias("station_id")).agg(F.count("*").cast("double").alias("ridership"))
    return with_series(densify(obs, "ridership", 0.0))


def orders_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_target(service_status(orders_panel(spark, sf_dir)))


def shipments_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dense: quantity shipped a day by line status (line) and return flag (station)."""
    obs = table(spark, sf_dir, "lineitem").groupBy(F.to_date("l_shipdate").alias("date"), F.col("l_linestatus").alias("line_id"), F.col("l_returnflag").alias("station_id")).agg(F.sum("l_quantity").alias("value"))
    return with_series(densify(obs, "value", 0.0))


#: Closures put into the dense panel: series pattern, first and last day.
CLOSURES = [("O:A", "1999-03-01", "1999-03-10"), ("F:R", "2000-06-05", "2000-06-09"), ("O:N", "2001-09-01", "2001-09-28"), ("O:%", "2001-10-10", "2001-10-13")]


def closed_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The dense panel with closures, their status, and value and target as ridership has them."""
    value = F.col("value")
    for series, a, b in CLOSURES:
        value = F.when(F.col("series_id").like(series) & F.col("date").between(F.lit(a).cast("date"), F.lit(b).cast("date")), 0.0).otherwise(value)
    rows = shipments_panel(spark, sf_dir).withColumn("ridership", value).drop("value")
    return with_target(service_status(rows))


def events_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Canonical rows with repeated keys: one row per event."""
    rows = table(spark, sf_dir, "events").select(F.to_date("ts").alias("date"), F.col("event_type").alias("line_id"), F.col("user_id").cast("string").alias("station_id"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("station_name"), F.col("value").alias("ridership"))
    return mark_duplicates(rows)


def events_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicated keys voided, then densified: null cells are ambiguous."""
    panel = with_series(rectangular_panel(events_rows(spark, sf_dir)))
    return with_target(service_status(panel))
