"""One gradient-boosted model for all series, on ``pyspark.ml``."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .features import WARMUP, feature_columns, prediction_frame, supervised_frame
from .forecast import BY

SENTINEL = -1.0


class GradientBoosting:
    """Boosted trees over origin, series and horizon.

    The loss is the squared error: under the absolute one a tree of Spark's moves a prediction by
    no more than the rate, whatever the unit of the values.

    Missing numbers become a sentinel with a flag beside it; series seen only later fall into
    a category of their own.
    """

    def __init__(self, horizons: int = 14, train_years: int = 3, trees: int = 20, depth: int = 5, rate: float = 0.1, seed: int = 20260905, max_bins: int = 256, sample: float = 0.85):
        self.horizons, self.train_years = horizons, int(train_years)
        self.trees, self.depth, self.rate, self.seed, self.max_bins, self.sample = trees, depth, rate, seed, max_bins, sample

    def _prepared(self, frame: DataFrame) -> tuple[DataFrame, list[str]]:
        numbers = [c for c in feature_columns(frame) if c not in ("line_id", "station_id", "holiday_name")]
        may_miss = [c for c in numbers if c.startswith(("lag_", "mean_", "median_", "std_", "same_"))]
        out = frame.withColumns({f"{c}_missing": F.col(c).isNull().cast("double") for c in may_miss})
        out = out.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(SENTINEL)) for c in numbers})
        return out, [*numbers, *(f"{c}_missing" for c in may_miss)]

    def _trained(self, panel: DataFrame, value: str) -> PipelineModel:
        span = panel.agg(F.min("date").alias("a"), F.max("date").alias("b")).first()
        if span["a"] is None or (span["b"] - span["a"]).days + 1 < WARMUP + self.horizons + 30:
            raise ValueError("too little history to train on")
        horizons = list(range(1, self.horizons + 1))
        frame = supervised_frame(panel, horizons, value).filter(F.col("origin") >= F.add_months(F.lit(span["b"]), -12 * self.train_years))
        frame, numbers = self._prepared(frame)
        index = StringIndexer(inputCols=["line_id", "station_id", "holiday_name"], outputCols=["_line", "_station", "_holiday"], stringOrderType="alphabetAsc", handleInvalid="keep")
        gather = VectorAssembler(inputCols=[*numbers, "_line", "_station", "_holiday"], outputCol="features")
        trees = GBTRegressor(featuresCol="features", labelCol="target", predictionCol="prediction", lossType="squared", maxIter=self.trees, maxDepth=self.depth, stepSize=self.rate, maxBins=self.max_bins, subsamplingRate=self.sample, minInstancesPerNode=40, seed=self.seed)
        return Pipeline(stages=[index, gather, trees]).fit(frame)

    def fit(self, history: DataFrame, by: tuple[str, ...] = BY, value: str = "value") -> Boosted:
        """One model for all series of each fit; the columns of ``by`` before the series tell fits apart.

        Trees are grown in one job after another, so the few fits (one per fold) are a loop.
        """
        frame, types = by[:-1], dict(history.dtypes)
        keys = sorted(tuple(r) for r in history.select(*frame).distinct().collect()) if frame else [()]
        parts = []
        for key in keys:
            mine = history
            for column, v in zip(frame, key):
                mine = mine.filter(F.col(column) == F.lit(v))
            mine = mine.drop(*frame)
            parts.append((tuple(F.lit(v).cast(types[c]).alias(c) for c, v in zip(frame, key)), mine, self._trained(mine, value)))
        return Boosted(value, parts)

    def predict(self, params: Boosted, horizon: int, by: tuple[str, ...] = BY) -> DataFrame:
        """``by``, date, horizon and prediction (never negative) for the days after each fit's history."""
        if not 1 <= horizon <= self.horizons:
            raise ValueError(f"trained for 1 to {self.horizons} days ahead, asked for {horizon}")
        out = []
        for key, history, model in params.parts:
            frame, _ = self._prepared(prediction_frame(history, list(range(1, horizon + 1)), params.value))
            out.append(model.transform(frame).select(*key, "series_id", "date", F.col("horizon").cast("int").alias("horizon"), F.greatest("prediction", F.lit(0.0)).alias("prediction")))
        return reduce(DataFrame.unionByName, out)


@dataclass(frozen=True)
class Boosted:
    """Fitted models: of each the key of its fit, its history and its pipeline."""

    value: str
    parts: list[tuple[tuple[Column, ...], DataFrame, PipelineModel]]

    def save(self, path: str) -> None:
        """Write the pipeline of a single fit; ``PipelineModel.load`` reads it."""
        ((_, _, model),) = self.parts
        model.write().overwrite().save(path)

    def feature_importance(self, spark: SparkSession) -> DataFrame:
        ((_, _, model),) = self.parts
        gather, trees = model.stages[-2:]
        values = trees.featureImportances.toArray().tolist()
        return spark.createDataFrame(list(zip(gather.getInputCols(), values)), "feature string, importance double").orderBy(F.desc("importance"))
