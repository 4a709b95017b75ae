"""The serving surface as query functions over artifact tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ArtifactsUnavailable, NotFound

MAX_HORIZON = 14


@dataclass(frozen=True)
class Store:
    forecast: DataFrame
    anomalies: DataFrame
    coordinates: DataFrame | None
    metadata: DataFrame

    def stations(self) -> DataFrame:
        """Distinct stations of the forecast, with coordinates where there are any."""
        rows = self.forecast.select("series_id", "line_id", "station_id", "station_name").distinct()
        if self.coordinates is None:
            rows = rows.withColumns({"longitude": F.lit(None).cast("double"), "latitude": F.lit(None).cast("double")})
        else:
            rows = rows.join(self.coordinates.select("series_id", "longitude", "latitude"), "series_id", "left")
        return rows.orderBy("line_id", "station_id")


def load_store(spark: SparkSession, path: str) -> Store:
    """Artifacts of a folder; an error that lists what is missing."""
    found, missing = {}, []
    for name in ("forecast", "anomalies", "metadata", "coordinates"):
        try:
            found[name] = spark.read.parquet(f"{path}/{name}") if name != "metadata" else spark.read.json(f"{path}/{name}")
        except Exception as e:  # Spark has one error type for a path that isn't there
            if "PATH_NOT_FOUND" not in str(e):
                raise
            if name != "coordinates":
                missing.append(name)
    if missing:
        raise ArtifactsUnavailable(f"missing under {path}: {', '.join(missing)}")
    return Store(found["forecast"].cache(), found["anomalies"].cache(), found.get("coordinates"), found["metadata"])


def health(store: Store) -> DataFrame:
    return store.metadata.select(F.lit("ok").alias("status"), "data_through", "trained_at")


def metadata(store: Store) -> DataFrame:
    """What was trained, on what, and up to which day: one row."""
    return store.metadata


def filter_stations(rows: DataFrame, line: str | None = None) -> DataFrame:
    if line is None:
        return rows
    out = rows.filter(F.col("line_id") == line.upper())
    if out.isEmpty():
        raise NotFound(f"no line {line!r}")
    return out


def filter_forecast(rows: DataFrame, station: str | None = None, line: str | None = None, horizon: int | None = None) -> DataFrame:
    """All days ahead, or the one that ``horizon`` names. An unknown station raises; an unknown line gives no rows."""
    if horizon is not None and not 1 <= horizon <= MAX_HORIZON:
        raise ValueError(f"horizon must be 1 to {MAX_HORIZON}")
    if station is not None:
        rows = rows.filter(F.col("series_id") == station) if ":" in station else rows.filter(F.col("station_id") == station)
        if rows.isEmpty():
            raise NotFound(f"no station {station!r}")
    if line is not None:
        rows = rows.filter(F.col("line_id") == line.upper())
    if horizon is not None:
        rows = rows.filter(F.col("horizon") == horizon)
    return rows.orderBy("date", "series_id")


def filter_anomalies(rows: DataFrame, station: str | None = None, date: str | None = None, line: str | None = None, flagged_only: bool = True) -> DataFrame:
    """The whole scored window, or a station's or a date's part of it; a station decides alone, the
    date counts only without one. Flagged rows come newest and worst first, all rows by date and series."""
    narrowed = station is not None or date is not None
    if station is not None:
        rows = rows.filter(F.col("station_id") == station)
    elif date is not None:
        rows = rows.filter(F.col("date") == F.lit(date).cast("date"))
    if narrowed and rows.isEmpty():
        raise NotFound(f"nothing for {station or date!r}")
    if line is not None:
        rows = rows.filter(F.col("line_id") == line.upper())
    if flagged_only:
        return rows.filter("is_anomaly").orderBy(F.desc("date"), "score")
    return rows.orderBy("date", "series_id")


def records(rows: DataFrame) -> DataFrame:
    """A JSON object a row, nulls kept, dates as ISO text."""
    dated = rows.withColumns({n: F.date_format(n, "yyyy-MM-dd") for n, t in rows.dtypes if t == "date"})
    return dated.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("record"))
