"""From raw rows to the modelling panel, its registry and its events, and from there to artifacts."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import NetworkShape
from ..functions.text import split_series_id
from ..operators.boosting import Boosted
from ..operators.canonical import assert_network, canonicalize, mark_duplicates, station_registry
from ..operators.detector import Detector
from ..operators.islands import interruptions, network_events, service_status, with_target
from ..operators.panel import assert_rectangular, rectangular_panel, with_series

PANEL_COLUMNS = ["date", "line_id", "station_id", "station_name", "ridership", "status", "target"]
SERVING_DAYS, SERVING_RATE = 120, 0.01


def build_panel(raw: DataFrame, network: NetworkShape | None = None, check: bool = True) -> tuple[DataFrame, DataFrame]:
    """(panel, registry) of raw rows: one lazy plan, with the contract checks as the only actions."""
    rows = canonicalize(raw, check)
    if network:
        assert_network(rows, network)
    marked = mark_duplicates(rows)
    panel = with_target(service_status(rectangular_panel(marked))).select(PANEL_COLUMNS)
    if check:
        assert_rectangular(panel)
    return panel, station_registry(rows)


def write_panel(panel: DataFrame, registry: DataFrame, folder: str) -> None:
    """Panel as Parquet; registry and events, which are small, as one CSV file each."""
    panel.write.mode("overwrite").option("compression", "snappy").parquet(f"{folder}/panel")
    registry.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/stations")
    events = network_events(interruptions(panel))
    events.coalesce(1).write.mode("overwrite").option("header", True).csv(f"{folder}/service_events")


def recent_anomalies(panel: DataFrame, days: int = SERVING_DAYS, rate: float = SERVING_RATE) -> tuple[DataFrame, DataFrame]:
    """(feed, cut-offs): the last days of observed ridership scored by a detector of operating days."""
    rows = with_series(panel)
    detector = Detector(rates=(rate,))
    params, cuts = detector.fit(rows, "target")
    last = rows.agg(F.max("date").alias("_l"))
    recent = rows.crossJoin(F.broadcast(last)).filter(F.col("date") > F.date_sub("_l", days)).drop("_l")
    feed = detector.detect(recent, params, cuts, "ridership", short=True)
    return feed.select("date", "series_id", "ridership", "expected", F.col("z").alias("score"), "is_anomaly", "reason", "line_id", "station_id", "station_name"), cuts


def long_forecast(predictions: DataFrame, names: DataFrame) -> DataFrame:
    """Forecast rows with names, rounded half to even."""
    line, station = split_series_id(F.col("series_id"))
    rows = predictions.select("date", "horizon", "series_id", line.alias("line_id"), station.alias("station_id"), F.bround("prediction").cast("long").alias("prediction"))
    return rows.join(names, ["line_id", "station_id"], "left").select("date", "horizon", "series_id", "line_id", "station_id", "station_name", "prediction")


def station_names(panel: DataFrame) -> DataFrame:
    return panel.groupBy("line_id", "station_id").agg(F.min_by("station_name", "date").alias("station_name"))


def train(panel: DataFrame, forecaster, folder: str, horizon: int = 14, coordinates: DataFrame | None = None, trained_at: str = "", operator: str = "metro") -> dict:
    """Fit the forecaster and the detector and write the serving tables and, where there is one to
    keep, the model; returns the metadata."""
    rows = with_series(panel)
    fitted = forecaster.fit(rows, value="target")
    predictions = forecaster.predict(fitted, horizon)
    if isinstance(fitted, Boosted):
        fitted.save(f"{folder}/model")
    long_forecast(predictions, station_names(panel)).write.mode("overwrite").parquet(f"{folder}/forecast")
    feed, cuts = recent_anomalies(panel)
    feed.write.mode("overwrite").parquet(f"{folder}/anomalies")
    located = coordinates is not None and not coordinates.isEmpty()
    if located:
        with_series(coordinates).select("series_id", "longitude", "latitude").write.mode("overwrite").parquet(f"{folder}/coordinates")
    spark = panel.sparkSession
    span = rows.agg(F.min("date").alias("a"), F.max("date").alias("b"), F.count_distinct("series_id").alias("s"), F.count("*").alias("n")).first()
    cut = cuts.first()
    ahead = spark.read.parquet(f"{folder}/forecast").agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
    # The names of these fields are fixed: readers of the metadata go by them.
    meta = {
        "operator": operator,
        "trained_at": trained_at,
        "data_from": str(span["a"]),
        "data_through": str(span["b"]),
        "n_panel_rows": span["n"],
        "n_series": span["s"],
        "horizons": list(range(1, horizon + 1)),
        "forecast_from": str(ahead["a"]),
        "forecast_to": str(ahead["b"]),
        "anomaly_window_days": SERVING_DAYS,
        "false_alarm_rate": SERVING_RATE,
        "anomaly_threshold": round(cut["z_cutoff"], 3),
        "cusum_threshold": round(cut["cusum_cutoff"], 3),
        "anomalies_flagged": spark.read.parquet(f"{folder}/anomalies").filter("is_anomaly").count(),
        "has_coordinates": located,
    }
    spark.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/metadata")
    return meta
