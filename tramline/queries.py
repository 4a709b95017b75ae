"""Queries over the sample tables, one or more for each operator."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .functions import text
from .functions.calendar import FEATURES, calendar_columns
from .operators import canonical, contract, evaluation, features, islands
from .operators.boosting import GradientBoosting
from .operators.detector import Detector, mad, restart_cusum_fold, with_cusum, with_restart_cusum
from .operators.forecast import HierarchicalSeasonal, SeasonalNaive
from .operators.panel import to_wide
from .plans import build, serving
from .plans.panels import closed_panel, events_panel, events_rows, orders_panel, orders_status, shipments_panel, table
from .scratch import written_once
from .sources import catalog, geometry

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r(c: str, digits: int = 4):
    return F.round(c, digits).alias(c)


# Panels

@query
def panel_densify(spark, d):
    return orders_panel(spark, d).select("series_id", "date", "ridership")


@query
def panel_series_count(spark, d):
    return shipments_panel(spark, d).groupBy("series_id").agg(F.count("*").alias("n_days"), F.min("date").alias("first_date"), F.max("date").alias("last_date"), F.sum("value").alias("total"))


@query
def panel_rectangular(spark, d):
    return events_panel(spark, d).select("date", "line_id", "station_id", "station_name", "ridership", "status", "target")


@query
def panel_wide_month(spark, d):
    months = shipments_panel(spark, d).groupBy(F.trunc("date", "MM").alias("date"), F.col("line_id").alias("series_id")).agg(F.sum("value").alias("value"))
    return to_wide(months, "value", ["F", "O"]).select(F.col("date").alias("month"), F.col("F").alias("f_total"), F.col("O").alias("o_total"))


# Runs and status

@query
def runs_zero(spark, d):
    return islands.find_runs(orders_panel(spark, d), F.col("ridership") == 0, ["series_id"])


@query
def status_daily(spark, d):
    return orders_status(spark, d).select("series_id", "date", "status", "target")


@query
def status_summary(spark, d):
    return islands.summarize_status(orders_status(spark, d))


@query
def outage_dates(spark, d):
    return islands.network_outage_dates(orders_panel(spark, d))


@query
def interruptions(spark, d):
    return islands.interruptions(orders_status(spark, d))


@query
def network_events(spark, d):
    return islands.network_events(islands.interruptions(orders_status(spark, d)))


# Identities and quality

@query
def duplicate_keys(spark, d):
    rows = events_rows(spark, d).filter("is_duplicate")
    return rows.groupBy("date", "line_id", "station_id").agg(F.count("*").alias("copies"))


@query
def duplicate_report(spark, d):
    return canonical.duplicate_report(events_rows(spark, d)).select("n_rows", "n_dates", F.length("stations").cast("long").alias("stations_chars"), "first_date", "last_date")


@query
def registry(spark, d):
    rows = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    rows = rows.select(F.to_date("o_orderdate").alias("date"), F.col("o_orderpriority").alias("line_id"), F.col("o_orderstatus").alias("station_id"), F.col("c_mktsegment").alias("station_name"), F.col("c_name").alias("estacion"))
    return canonical.station_registry(rows)


@query
def contract_report(spark, d):
    rep = contract.report_frame(table(spark, d, "lineitem"), F.to_date("l_shipdate"), F.year("l_shipdate"), F.col("l_linestatus"), F.col("l_returnflag"), F.col("l_quantity"))
    return rep.select("n_rows", "date_min", "date_max", "n_raw_line_labels", "n_raw_station_labels", "n_zero_rows", "zero_share", F.to_json("per_year").alias("per_year"))


@query
def network_shape(spark, d):
    return canonical.network_shape(orders_panel(spark, d))


@query
def contract_validate(spark, d):
    rows = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("fecha"), F.year("o_orderdate").alias("anio"), F.date_format("o_orderdate", "MM").alias("mes"), F.col("o_orderpriority").alias("linea"), F.col("o_orderstatus").alias("estacion"), F.col("o_custkey").cast("long").alias("afluencia"))
    found = contract.validate(rows, min_rows=1)
    return spark.createDataFrame([(found.n_rows, found.date_min, found.date_max, found.n_raw_line_labels, found.n_raw_station_labels, found.n_zero_rows, year, n) for year, n in found.years.items()], "n_rows long, date_min date, date_max date, n_lines long, n_stations long, n_zero_rows long, year long, rows_of_year long")


# Text

@query
def text_strip_accents(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.strip_accents(F.col("text"))).alias("plain_md5"))


@query
def text_normalize_key(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.normalize_key(F.col("text"))).alias("key_md5"))


@query
def text_slug(spark, d):
    return table(spark, d, "documents").select("doc_id", F.md5(text.slugify_station(F.col("text"))).alias("slug_md5"))


@query
def text_mojibake_roundtrip(spark, d):
    docs = table(spark, d, "documents")
    broken = F.decode(F.encode("text", "UTF-8"), "ISO-8859-1")
    return docs.select("doc_id", F.md5(text.fix_mojibake(broken)).alias("text_md5"), (text.fix_mojibake(broken) == F.col("text")).alias("restored"))


@query
def line_code(spark, d):
    raw = F.concat(F.lit(" 0"), F.split("o_orderpriority", "-")[0], F.lit(" "))
    label = F.concat(F.lit("Línea  "), F.split("o_orderpriority", "-")[0])
    rows = table(spark, d, "orders").select("o_orderpriority").distinct()
    return rows.select(F.col("o_orderpriority").alias("label"), text.parse_line_code(raw).alias("line_code"), text.parse_line_id(label).alias("line_id"), text.line_sort_rank(text.parse_line_id(label)).cast("long").alias("line_rank"))


@query
def series_id_split(spark, d):
    rows = orders_panel(spark, d).select("series_id").distinct()
    line, station = text.split_series_id(F.col("series_id"))
    return rows.select("series_id", line.alias("line_id"), station.alias("station_id"))


# Calendar and features

@query
def calendar_features(spark, d):
    days = orders_panel(spark, d).select("date").distinct()
    rows = days.select("date", *(c.alias(n) for n, c in calendar_columns(F.col("date")).items()))
    return rows.select("date", *(F.col(c).cast("long").alias(c) if dict(rows.dtypes)[c] in ("int", "tinyint") else F.col(c) for c in FEATURES))


@query
def rolling_7_28_91(spark, d):
    rows = shipments_panel(spark, d).withColumns(features.rolling_columns())
    return rows.select("series_id", "date", *(r(c) for c in features.rolling_columns()))


@query
def rolling_level_56(spark, d):
    rows = HierarchicalSeasonal().decomposed(shipments_panel(spark, d))
    return rows.select("series_id", "date", r("level_at"))


@query
def lags_leads(spark, d):
    w = features.series_window(["series_id"])
    rows = shipments_panel(spark, d).withColumns(features.lag_columns() | {"lead_14": F.lead("value", 14).over(w)})
    return rows.select("series_id", "date", *features.lag_columns(), "lead_14")


@query
def same_weekday_lag(spark, d):
    frame = features.supervised_frame(shipments_panel(spark, d), [1, 6, 7, 8, 14])
    return frame.select("series_id", "origin", F.col("horizon").cast("long").alias("horizon"), F.col("same_weekday").cast("double").alias("same_weekday"))


def _frame(rows: DataFrame, target: bool) -> DataFrame:
    keep = ["lag_0", "lag_6", "lag_363", "median_28", "same_weekday"]
    extra = [F.col("target").cast("double").alias("target")] if target else []
    return rows.select("series_id", "origin", "date", F.col("horizon").cast("long").alias("horizon"), *(F.col(c).cast("double").alias(c) for c in keep), "is_holiday", "is_payday", F.col("effective_day_of_week").cast("long").alias("effective_day_of_week"), *extra)


@query
def supervised_frame(spark, d):
    return _frame(features.supervised_frame(shipments_panel(spark, d), list(range(1, 15))), True)


@query
def prediction_frame(spark, d):
    return _frame(features.prediction_frame(shipments_panel(spark, d), list(range(1, 15))), False)


# Forecasters

@query
def naive_phase_table(spark, d):
    m = SeasonalNaive()
    return m.phase_table(m.fit(shipments_panel(spark, d))).select("series_id", F.col("day_of_week").cast("long").alias("day_of_week"), "value")


@query
def naive_forecast(spark, d):
    m = SeasonalNaive()
    return m.predict(m.fit(shipments_panel(spark, d)), 14).select("series_id", "date", F.col("horizon").cast("long").alias("horizon"), "prediction")


def _factors(spark, d, column: str, name: str) -> DataFrame:
    params = HierarchicalSeasonal().fit(shipments_panel(spark, d))
    rows = params.select("series_id", F.explode(column).alias(name, "factor"))
    return rows.select("series_id", F.col(name).cast("long").alias(name), r("factor", 6))


@query
def weekday_factor(spark, d):
    return _factors(spark, d, "weekday_factors", "day_of_week")


@query
def month_factor(spark, d):
    return _factors(spark, d, "month_factors", "month")


@query
def current_level(spark, d):
    return HierarchicalSeasonal().fit(shipments_panel(spark, d)).select("series_id", "last_date", r("level"))


@query
def expected_demand(spark, d):
    panel = shipments_panel(spark, d)
    params = HierarchicalSeasonal().fit(panel)
    return panel.join(params, "series_id").withColumn("expected", HierarchicalSeasonal.expected()).select("series_id", "date", r("expected"))


@query
def seasonal_forecast(spark, d):
    m = HierarchicalSeasonal()
    return m.predict(m.fit(shipments_panel(spark, d)), 14).select("series_id", "date", F.col("horizon").cast("long").alias("horizon"), r("prediction"))


# Detector

@query
def mad_by_series(spark, d):
    return mad(shipments_panel(spark, d), "value", ("series_id",)).select("series_id", r("mad"))


@query
def mad_scale(spark, d):
    params, _ = Detector().calibrated(shipments_panel(spark, d))
    return params.select("series_id", r("center"), r("scale"))


@query
def zscore(spark, d):
    _, scored = Detector().calibrated(shipments_panel(spark, d))
    return scored.select("series_id", "date", r("z"))


@query
def cutoffs(spark, d):
    _, cuts = Detector(rates=RATES).fit(shipments_panel(spark, d))
    return cuts.select("rate", r("z_cutoff"), r("cusum_cutoff"))


RATES = (0.0005, 0.002, 0.01, 0.05)


def _standard(spark, d) -> DataFrame:
    """A cheap score for CUSUM queries: value against the mean and deviation of its series."""
    whole = Window.partitionBy("series_id")
    v = F.col("value")
    return shipments_panel(spark, d).withColumn("z", (v - F.avg(v).over(whole)) / F.stddev_samp(v).over(whole))


@query
def cusum_plain(spark, d):
    return with_cusum(_standard(spark, d)).select("series_id", "date", r("cusum"))


@query
def cusum_restart(spark, d):
    return with_restart_cusum(_standard(spark, d).withColumn("limit", F.lit(4.0)), "limit").select("series_id", "date", r("cusum"))


@query
def cusum_restart_month(spark, d):
    rows = _standard(spark, d).withColumns({"month": F.trunc("date", "MM"), "limit": F.lit(4.0)})
    return restart_cusum_fold(rows, F.col("limit"), by=("series_id", "month")).select("series_id", "date", r("cusum"))


SERVING_DAYS = 120


def _flagged(spark, d, rates: tuple[float, ...] = (0.01,)) -> DataFrame:
    panel = written_once(closed_panel(spark, d), "panel")
    detector = Detector(rates=rates)
    params, cuts = detector.fit(panel, "target")
    last = panel.agg(F.max("date").alias("_l"))
    recent = panel.crossJoin(F.broadcast(last)).filter(F.col("date") > F.date_sub("_l", SERVING_DAYS)).drop("_l")
    return detector.detect(recent, params, cuts, "ridership", short=True)


@query
def anomaly_flags(spark, d):
    return _flagged(spark, d).select("series_id", "date", "ridership", r("expected"), r("z"), r("cusum"), "is_anomaly")


@query
def anomaly_reasons(spark, d):
    return _flagged(spark, d).filter("is_anomaly").select("series_id", "date", "reason")


@query
def line_incidents(spark, d):
    return Detector().line_incidents(_flagged(spark, d)).select("date", "line_id", "n_flagged")


@query
def alarm_rate_curve(spark, d):
    flags = _flagged(spark, d, RATES)
    return flags.groupBy("rate").agg(F.count_if("is_anomaly").alias("n_flags"))


# Metrics, folds, backtests

def _scores(spark, d):
    panel = shipments_panel(spark, d)
    return evaluation.backtest(panel, evaluation.fold_frame(panel))


@query
def folds(spark, d):
    return evaluation.fold_frame(shipments_panel(spark, d)).withColumn("fold", F.col("fold").cast("long"))


@query
def metric_insample(spark, d):
    return evaluation.insample_mae(shipments_panel(spark, d), ("line_id",)).select("line_id", r("insample_mae", 6))


@query
def backtest_fold_scores(spark, d):
    per_fold, _, _ = _scores(spark, d)
    return per_fold.select(F.col("fold").cast("long").alias("fold"), "model", r("mae"), r("smape"), r("mase"), r("relative_mae"), "n_scored")


@query
def backtest_by_horizon(spark, d):
    _, per_horizon, _ = _scores(spark, d)
    return per_horizon.select(F.col("fold").cast("long").alias("fold"), F.col("horizon").cast("long").alias("horizon"), "model", r("mae"), r("relative_mae"))


@query
def backtest_summary(spark, d):
    per_fold, _, _ = _scores(spark, d)
    return evaluation.summarize(per_fold)


@query
def gate(spark, d):
    per_fold, _, _ = _scores(spark, d)
    out = evaluation.gate_frame(per_fold, "hierarchical", 0.95)
    return out.select(r("mean_relative_mae"), r("worst"), "n_folds", "passed")


# Detector evaluation

@query
def ground_truth(spark, d):
    rows = evaluation.ground_truth(closed_panel(spark, d))
    return rows.select("series_id", "date", "status", F.col("label").cast("long").alias("label"))


def _walked(spark, d) -> tuple[DataFrame, DataFrame]:
    panel = written_once(closed_panel(spark, d), "panel")
    flags = evaluation.walk_forward(panel, panel.select("series_id", "line_id", "date", F.col("target").alias("ridership")), RATES, value="ridership")
    return written_once(flags, "flags"), evaluation.ground_truth(panel)


@query
def walk_forward_flags(spark, d):
    flags, _ = _walked(spark, d)
    return flags.groupBy("rate", "month").agg(F.count("*").alias("n_rows"), F.count_if("is_anomaly").alias("n_flags"), F.round(F.first("z_cutoff"), 4).alias("z_cutoff"))


@query
def score_days(spark, d):
    out = evaluation.score_days(*_walked(spark, d))
    return out.select("rate", "n_days_scored", "n_positive_days", "true_positives", "false_positives", "false_negatives", r("precision"), r("recall"), r("f1"))


@query
def event_onsets(spark, d):
    return evaluation.event_onsets(*_walked(spark, d))


@query
def operating_curve(spark, d):
    out = evaluation.operating_curve(*_walked(spark, d))
    return out.select("rate", *(r(c) for c in out.columns if c != "rate"))


# Joins with references

@query
def reconcile_full_outer(spark, d):
    left = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("key"), "n_name")
    right = table(spark, d, "supplier").groupBy((F.col("s_nationkey") + 2).cast("long").alias("key")).agg(F.count("*").alias("n_suppliers"))
    return canonical.match_sides(left, right, ("key",)).select("key", "n_name", "n_suppliers", "side")


@query
def reconcile_left_only(spark, d):
    return reconcile_full_outer(spark, d).filter("side = 'left_only'").select("key", "n_name")


@query
def alias_apply(spark, d):
    nation = table(spark, d, "nation").select(F.col("n_regionkey").cast("string").alias("line_id"), F.col("n_name").alias("station_id"))
    aliases = table(spark, d, "region").select(F.col("r_regionkey").cast("string").alias("line_id"), F.lit("CHINA").alias("alias_station_id"), F.col("r_name").alias("canonical_station_id"))
    return canonical.apply_aliases(nation, aliases)


@query
def stations_with_coords(spark, d):
    key = lambda c: F.col(c).cast("string")
    stations = table(spark, d, "nation").select(key("n_nationkey").alias("series_id"), key("n_regionkey").alias("line_id"), F.col("n_name").alias("station_id"), F.lower("n_name").alias("station_name"))
    coords = table(spark, d, "customer").groupBy(key("c_nationkey").alias("series_id")).agg(F.min("c_acctbal").alias("longitude"), F.max("c_acctbal").alias("latitude"))
    return serving.Store(stations, stations, coords, stations).stations()


# Sources in the shape of records

@query
def kml_stations(spark, d):
    """Placemarks as the stations' archive has them, a document per region, through the parser."""
    cell = lambda name, c: F.concat(F.lit(f"<tr><td>{name}</td> <td>"), c, F.lit("</td></tr>"))
    mark = F.concat(F.lit("<Placemark><description><table>"), cell("NOMBRE", F.col("n_name")), cell("LINEA", F.concat(F.lit("0"), (F.col("n_regionkey") + 1).cast("string"))), F.lit("</table></description><Point><coordinates> -"), F.col("n_nationkey").cast("string"), F.lit(".5,"), F.col("n_nationkey").cast("string"), F.lit(".25,0</coordinates></Point></Placemark>"))
    kml = table(spark, d, "nation").groupBy("n_regionkey").agg(F.concat(F.lit("<kml><Document>"), F.array_join(F.collect_list(mark), "\n"), F.lit("</Document></kml>")).alias("kml"))
    return geometry.parse_stations(kml).select("line_id", "station_id", "station_name", "longitude", "latitude")


@query
def json_resources(spark, d):
    """The nations, 25 rows, as the resources of a package document, through the catalogue's reader."""
    text_of = lambda c: F.col(c).cast("string")
    each = F.struct(text_of("n_nationkey").alias("id"), F.col("n_name").alias("name"), F.concat(F.lit("https://data.example/"), text_of("n_nationkey")).alias("url"), F.lit("csv").alias("format"), F.lit("2020-01-01").alias("created"), F.when(F.col("n_nationkey") > 9, F.lit("2021-01-01")).alias("last_modified"))
    body = table(spark, d, "nation").agg(F.to_json(F.struct(F.lit(True).alias("success"), F.struct(F.collect_list(each).alias("resources")).alias("result"))).alias("b")).first()["b"]
    return catalog.list_resources(spark, body).select("id", "name", "url", "format", "last_modified")


# Serving

@query
def api_forecast_filter(spark, d):
    m = SeasonalNaive()
    panel = shipments_panel(spark, d)
    rows = m.predict(m.fit(panel), 14).withColumn("line_id", F.split("series_id", ":")[0])
    return serving.filter_forecast(rows, line="o", horizon=7).select("series_id", "date", F.col("horizon").cast("long").alias("horizon"), "prediction")


@query
def api_anomalies_latest(spark, d):
    rows = _flagged(spark, d).withColumn("score", F.col("z"))
    return serving.filter_anomalies(rows, flagged_only=True).select("series_id", "date", r("score"), "reason")


@query
def api_stations(spark, d):
    rows = orders_panel(spark, d).select("line_id", "station_id", "series_id").distinct()
    return serving.filter_stations(rows, line="1-urgent").orderBy("line_id", "station_id")


@query
def long_forecast(spark, d):
    m, panel = HierarchicalSeasonal(), shipments_panel(spark, d)
    names = build.station_names(panel.withColumn("station_name", F.concat(F.lit("station "), "station_id")))
    rows = build.long_forecast(m.predict(m.fit(panel), 14), names)
    return rows.withColumn("horizon", F.col("horizon").cast("long"))


@query
def gbt_forecast(spark, d):
    model = GradientBoosting()
    rows = model.predict(model.fit(shipments_panel(spark, d)), model.horizons)
    return rows.select("series_id", "date", F.col("horizon").cast("long").alias("horizon"), r("prediction"))
