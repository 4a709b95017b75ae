"""Rolling statistics, lags and the supervised table, all over one window of a series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import FEATURES as CALENDAR
from ..functions.calendar import calendar_columns
from .panel import same_weekday_lag

#: Windows in days, and lags counted from the origin.
WINDOWS = (7, 28, 91)
LAGS = (0, 1, 2, 6, 13, 20, 27, 363)
WARMUP = max(*LAGS, *WINDOWS)
IDENTITY = ("series_id", "line_id", "station_id", "origin", "date")


def min_observations(window: int) -> int:
    return max(3, window // 4)


def series_window(by: list[str]):
    return Window.partitionBy(*by).orderBy("date")


def rolling(value: Column, stat, window: int, least: int, by: list[str]) -> Column:
    """``stat`` over the last ``window`` rows, null below ``least`` values."""
    frame = series_window(by).rowsBetween(-(window - 1), 0)
    return F.when(F.count(value).over(frame) >= least, stat(value).over(frame))


def median(c: Column) -> Column:
    """The exact median; unlike ``median`` it may be framed."""
    return F.percentile(c, 0.5)


def rolling_columns(value: str = "value", by: list[str] | None = None) -> dict[str, Column]:
    by, v = by or ["series_id"], F.col(value)
    out = {}
    for w in WINDOWS:
        out[f"mean_{w}"] = rolling(v, F.avg, w, min_observations(w), by)
        out[f"median_{w}"] = rolling(v, median, w, min_observations(w), by)
    out["std_7"] = rolling(v, F.stddev_samp, 7, min_observations(7), by)
    return out


def lag_columns(value: str = "value", by: list[str] | None = None, lags: tuple[int, ...] = LAGS) -> dict[str, Column]:
    w = series_window(by or ["series_id"])
    return {f"lag_{k}": F.lag(value, k).over(w) if k else F.col(value) for k in lags}


def origin_frame(panel: DataFrame, horizons: list[int], value: str = "value") -> DataFrame:
    """Every day of a dense panel as an origin, with its features and, as arrays by horizon,
    the targets ahead and the newest values of the targets' weekdays."""
    w = series_window(["series_id"])
    whole = Window.partitionBy("series_id")
    return panel.withColumns(
        {
            **rolling_columns(value),
            **lag_columns(value),
            "_position": F.row_number().over(w) - 1,
            "_days": F.count("*").over(whole),
            "_ahead": F.array(*(F.lead(value, h).over(w) for h in horizons)),
            "_weekday": F.array(*(F.lag(value, same_weekday_lag(h)).over(w) if same_weekday_lag(h) else F.col(value) for h in horizons)),
        }
    )


def _spread(frame: DataFrame, horizons: list[int], target: bool) -> DataFrame:
    rows = F.arrays_zip(F.array(*(F.lit(h).cast("short") for h in horizons)).alias("horizon"), F.col("_weekday").alias("same_weekday"), F.col("_ahead").alias("target"))
    names = [*rolling_columns(), *(f"lag_{k}" for k in LAGS)]
    out = frame.select("series_id", "line_id", "station_id", F.col("date").alias("origin"), *(F.col(n).cast("float").alias(n) for n in names), F.inline(rows).alias("horizon", "same_weekday", "target"))
    out = out.withColumns({"same_weekday": F.col("same_weekday").cast("float"), "target": F.col("target").cast("float"), "date": F.date_add("origin", F.col("horizon").cast("int"))})
    out = out.withColumns(calendar_columns(F.col("date")))
    return out if target else out.drop("target")


def supervised_frame(panel: DataFrame, horizons: list[int], value: str = "value", origins: DataFrame | None = None) -> DataFrame:
    """One row per origin, series and horizon with a known target.

    Origins need 363 days behind them and the longest horizon ahead; ``origins`` (a column
    ``date``) narrows them. Windows run over the whole series before that filter, and horizons
    are spread after it.
    """
    frame = origin_frame(panel, horizons, value).filter((F.col("_position") >= WARMUP) & (F.col("_position") < F.col("_days") - max(horizons)))
    if origins is not None:
        frame = frame.join(origins.select("date").distinct(), "date", "left_semi")
    return _spread(frame, horizons, True).filter(F.col("target").isNotNull())


def prediction_frame(panel: DataFrame, horizons: list[int], value: str = "value") -> DataFrame:
    """The same features for the days after the panel: its last day is the origin."""
    return _spread(origin_frame(panel, horizons, value).filter("_position = _days - 1"), horizons, False)


def feature_columns(frame: DataFrame) -> list[str]:
    return [c for c in frame.columns if c not in ("target", "date", "origin", "series_id")]


__all__ = ["CALENDAR", "LAGS", "WINDOWS", "feature_columns", "prediction_frame", "supervised_frame"]
