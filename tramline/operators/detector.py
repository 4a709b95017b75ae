"""Robust anomaly detection: MAD scores, one-sided CUSUM, calibrated cut-offs."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written_once
from .features import median
from .forecast import BY, HierarchicalSeasonal
from .quantiles import pooled_quantiles

#: From MAD to a standard deviation, and cut-offs where nothing can be calibrated.
MAD_TO_SIGMA = 1.4826
DEFAULT_CUTOFF, DEFAULT_CUSUM_CUTOFF = 4.0, 8.0
EXTREME, SUSTAINED = "extreme day", "sustained shortfall"


def mad(df: DataFrame, value: str, by: tuple[str, ...]) -> DataFrame:
    """Median absolute deviation per group, nulls left out."""
    around = df.withColumn("_d", F.abs(F.col(value) - median(F.col(value)).over(Window.partitionBy(*by))))
    return around.groupBy(*by).agg(median(F.col("_d")).alias("mad"))


def cusum_plain(z: Column, by: tuple[str, ...], drift: float) -> Column:
    """S = min(0, S + z + drift) from 0, without a loop: the running sum less its running peak.

    A null step changes nothing.
    """
    w = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    total = F.sum(F.coalesce(z + drift, F.lit(0.0))).over(w)
    return total, w


def with_cusum(df: DataFrame, z: str = "z", by: tuple[str, ...] = BY, drift: float = 0.5, out: str = "cusum") -> DataFrame:
    total, w = cusum_plain(F.col(z), by, drift)
    return df.withColumn("_p", total).withColumn(out, F.col("_p") - F.greatest(F.lit(0.0), F.max("_p").over(w))).drop("_p")


def with_restart_cusum(df: DataFrame, reset: str, z: str = "z", by: tuple[str, ...] = BY, drift: float = 0.5, out: str = "cusum") -> DataFrame:
    """The CUSUM that starts again from 0 after a day on which it reached ``-reset``.

    The state is sequential: rows of a series stay in order in one partition and stream through
    a numpy loop, so nothing is gathered and the cost is linear in the days.
    """
    kept = df.columns
    schema = df.withColumn(out, F.lit(0.0)).schema
    ordered = df.repartition(*by).sortWithinPartitions(*by, "date")

    def run(batches):
        key, state = None, 0.0
        for b in batches:
            if not b.num_rows:
                continue
            keys = list(zip(*(b.column(c).to_pylist() for c in by)))
            steps, limits = b.column(z).to_pylist(), b.column(reset).to_pylist()
            result = np.empty(b.num_rows)
            for i, (k, x, limit) in enumerate(zip(keys, steps, limits)):
                if k != key:
                    key, state = k, 0.0
                if x is not None:
                    state = min(0.0, state + (x + drift))
                result[i] = state
                if limit is not None and state <= -limit:
                    state = 0.0
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(result)], names=[*kept, out])

    return ordered.mapInArrow(run, schema)


def restart_cusum_fold(df: DataFrame, reset: Column, z: str = "z", by: tuple[str, ...] = BY, drift: float = 0.5, out: str = "cusum") -> DataFrame:
    """The same in SQL functions alone, for series that their frame keeps short, such as a month."""
    rest = [c for c in df.columns if c not in (*by, "date")]
    days = F.array_sort(F.collect_list(F.struct("date", *rest)))
    steps = df.groupBy(*by).agg(days.alias("_days"), F.max(reset).alias("_limit"))
    before = "try_element_at(a, -1)"
    steps = steps.withColumn("_sums", F.expr(f"""aggregate(_days, cast(array() as array<double>), (a, x) ->
        array_append(a, least(0D, if({before} <= -_limit, 0D, coalesce({before}, 0D)) + coalesce(x.`{z}` + {drift}D, 0D))))"""))
    rows = steps.select(*by, F.explode(F.arrays_zip("_days", "_sums")).alias("_r"))
    return rows.select(*by, "_r._days.*", F.col("_r._sums").alias(out)).select(*df.columns, out)


@dataclass(frozen=True)
class Detector:
    """``by`` names a series, ``frame`` the columns in front of it that tell fits apart."""

    rates: tuple[float, ...] = (0.01,)
    calibration_days: int = 180
    drift: float = 0.5
    min_line_stations: int = 3
    min_scale: float = 1.0
    threshold: float | None = None
    cusum_threshold: float | None = None
    frame: tuple[str, ...] = ()

    @property
    def by(self) -> tuple[str, ...]:
        return (*self.frame, "series_id")

    def calibrated(self, operating: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
        """Parameters per series, and the calibration days with their scores and plain CUSUM.

        Both are computed here, like any fit, and written once for all that read them.
        """
        model = HierarchicalSeasonal()
        params = written_once(model.fit(operating, self.by, value), "params")
        ends = operating.groupBy(*self.frame).agg(F.max("date").alias("_end")) if self.frame else operating.agg(F.max("date").alias("_end"))
        recent = operating.join(ends, list(self.frame)) if self.frame else operating.crossJoin(F.broadcast(ends))
        recent = recent.filter(F.col("date") > F.date_sub("_end", self.calibration_days))
        residual = recent.join(params, list(self.by)).withColumn("_r", F.col(value) - model.expected())
        whole = Window.partitionBy(*self.by)
        residual = residual.withColumn("center", median(F.col("_r")).over(whole))
        residual = residual.withColumn("_sigma", median(F.abs(F.col("_r") - F.col("center"))).over(whole) * MAD_TO_SIGMA)
        residual = residual.withColumn("scale", F.when(F.col("_sigma") > self.min_scale, F.col("_sigma"))).withColumn("z", (F.col("_r") - F.col("center")) / F.col("scale"))
        scored = written_once(with_cusum(residual.select(*self.by, "date", "center", "scale", "z"), by=self.by, drift=self.drift), "scored")
        spread = scored.groupBy(*self.by).agg(F.first("center").alias("center"), F.first("scale").alias("scale"))
        return params.join(spread, list(self.by)), scored.drop("center", "scale")

    def cutoffs(self, scored: DataFrame) -> DataFrame:
        """Per fit and rate, both cut-offs: the pooled quantile, never under 1."""
        q = pooled_quantiles(scored, ("z", "cusum"), self.rates, self.frame)
        cut = lambda c, fixed, default: F.lit(fixed) if fixed is not None else F.coalesce(F.greatest(-F.col(c), F.when(F.col(c).isNotNull(), 1.0)), F.lit(default))
        return q.select(*self.frame, "rate", cut("z", self.threshold, DEFAULT_CUTOFF).alias("z_cutoff"), cut("cusum", self.cusum_threshold, DEFAULT_CUSUM_CUTOFF).alias("cusum_cutoff"))

    def set_false_alarm_rate(self, rate: float, scored: DataFrame) -> tuple[Detector, DataFrame]:
        """This detector at another rate, and its cut-offs from the scores that ``calibrated`` gave; nothing is fitted again."""
        if not 0 < rate < 1:
            raise ValueError(f"a false alarm rate lies between 0 and 1, not at {rate}")
        other = replace(self, rates=(rate,))
        return other, other.cutoffs(scored)

    def fit(self, operating: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
        params, scored = self.calibrated(operating, value)
        return params, self.cutoffs(scored)

    def detect(self, observed: DataFrame, params: DataFrame, cutoffs: DataFrame, value: str = "value", short: bool = False) -> DataFrame:
        """Observed rows with expected, z, cusum, both cut-offs, is_anomaly and reason, per rate.

        The CUSUM starts at 0 with the rows it is given. Cut-offs are one row per fit and rate.
        ``short`` says that the caller's frame bounds the rows of a series (a month, the serving
        days), which then stay in SQL functions; long series stream through a loop.
        """
        rows = observed.join(params.drop("last_date"), list(self.by)).withColumn("expected", HierarchicalSeasonal.expected())
        rows = rows.withColumn("z", (F.col(value) - F.col("expected") - F.col("center")) / F.col("scale"))
        rows = rows.drop("level", "weekday_factors", "month_factors", "center", "scale")
        rows = rows.join(cutoffs, list(self.frame)) if self.frame else rows.crossJoin(F.broadcast(cutoffs))
        series = (*self.by, "rate")
        rows = restart_cusum_fold(rows, F.col("cusum_cutoff"), by=series, drift=self.drift) if short else with_restart_cusum(rows, "cusum_cutoff", by=series, drift=self.drift)
        extreme = F.coalesce(F.col("z") <= -F.col("z_cutoff"), F.lit(False))
        drifted = F.col("cusum") <= -F.col("cusum_cutoff")
        return rows.withColumns({"is_anomaly": extreme | drifted, "reason": F.when(extreme, EXTREME).when(drifted, SUSTAINED).otherwise("")})

    def line_incidents(self, flagged: DataFrame) -> DataFrame:
        """Days on which enough stations of a line are flagged to blame the line."""
        by = flagged.groupBy(*self.frame, "rate", "date", "line_id").agg(F.count_if("is_anomaly").alias("n_flagged"))
        return by.filter(F.col("n_flagged") >= self.min_line_stations)
