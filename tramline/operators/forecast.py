"""Forecasters whose fitted state is a table with one row per series.

``by`` is the key of a series, with more columns in front where many fits run at once (one per
fold or month): a refit is a key, not a loop.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .features import median, rolling

BY = ("series_id",)
LOOKBACK_CYCLES = 8
LEVEL_WINDOW, LEVEL_MIN, FACTOR_MIN = 56, 14, 8


class Forecaster(Protocol):
    def fit(self, history: DataFrame, by: tuple[str, ...] = BY) -> DataFrame: ...

    def predict(self, params: DataFrame, horizon: int, by: tuple[str, ...] = BY) -> DataFrame: ...


def ahead(params: DataFrame, horizon: int) -> DataFrame:
    """A row per series and step after ``last_date``."""
    if horizon < 1:
        raise ValueError("at least one step has to be forecast")
    return params.withColumn("horizon", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("date", F.date_add("last_date", F.col("horizon")))


class SeasonalNaive:
    """The newest observation of the same weekday, at most eight weeks old."""

    def __init__(self, lookback: int = LOOKBACK_CYCLES):
        self.lookback = lookback

    def fit(self, history: DataFrame, by: tuple[str, ...] = BY, value: str = "value") -> DataFrame:
        rows = history.withColumn("_last", F.max("date").over(Window.partitionBy(*by)))
        recent = F.when((F.col("date") > F.date_sub("_last", 7 * self.lookback)) & F.col(value).isNotNull(), F.col("date"))
        by_day = rows.groupBy(*by, F.weekday("date").alias("_dow")).agg(F.max_by(value, recent).alias("_v"), F.max("_last").alias("last_date"))
        return by_day.groupBy(*by).agg(F.max("last_date").alias("last_date"), F.map_from_entries(F.collect_list(F.struct("_dow", "_v"))).alias("newest"))

    def expected(self, params: DataFrame, date: str = "date") -> Column:
        return F.try_element_at("newest", F.weekday(date))

    def predict(self, params: DataFrame, horizon: int, by: tuple[str, ...] = BY) -> DataFrame:
        return ahead(params, horizon).select(*by, "date", "horizon", self.expected(params).alias("prediction"))

    def phase_table(self, params: DataFrame, by: tuple[str, ...] = BY) -> DataFrame:
        return params.select(*by, F.explode("newest").alias("day_of_week", "value"))


class HierarchicalSeasonal:
    """Level times weekday factor times month factor, all of them medians."""

    def __init__(self, window: int = LEVEL_WINDOW, least: int = LEVEL_MIN, support: int = FACTOR_MIN):
        self.window, self.least, self.support = window, least, support

    def decomposed(self, history: DataFrame, by: tuple[str, ...] = BY, value: str = "value") -> DataFrame:
        """History with its rolling level, and each row's weekday and month factor.

        All windows are partitioned by the series or finer, so one shuffle serves them.
        """
        by = list(by)
        v = F.col(value)
        rows = history.withColumn("level_at", rolling(v, median, self.window, self.least, by))
        rows = rows.withColumns({"_dow": F.weekday("date"), "_month": F.month("date"), "_ratio": F.when(F.col("level_at") > 0, v / F.col("level_at"))})
        factor = lambda c, w: F.when(F.count(c).over(w) >= self.support, median(c).over(w)).otherwise(1.0)
        rows = rows.withColumn("weekday_factor", factor(F.col("_ratio"), Window.partitionBy(*by, "_dow")))
        rows = rows.withColumn("_rest", F.try_divide("_ratio", "weekday_factor"))
        return rows.withColumn("month_factor", factor(F.col("_rest"), Window.partitionBy(*by, "_month")))

    def fit(self, history: DataFrame, by: tuple[str, ...] = BY, value: str = "value") -> DataFrame:
        rows = self.decomposed(history, by, value)
        as_map = lambda k, f: F.map_from_entries(F.collect_set(F.struct(k, f)))
        return rows.groupBy(*by).agg(
            F.max("date").alias("last_date"),
            F.max_by("level_at", F.when(F.col("level_at").isNotNull(), F.col("date"))).alias("level"),
            as_map("_dow", "weekday_factor").alias("weekday_factors"),
            as_map("_month", "month_factor").alias("month_factors"),
        )

    @staticmethod
    def expected(date: str = "date") -> Column:
        """The expectation for any date from a row's parameters; groups never seen count as 1."""
        at = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(1.0))
        return F.col("level") * at("weekday_factors", F.weekday(date)) * at("month_factors", F.month(date))

    def predict(self, params: DataFrame, horizon: int, by: tuple[str, ...] = BY) -> DataFrame:
        return ahead(params, horizon).select(*by, "date", "horizon", self.expected().alias("prediction"))
