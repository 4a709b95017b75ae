import random
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from tramline.errors import ArtifactsUnavailable, LeakageError, NotFound
from tramline.operators import evaluation, features
from tramline.operators.boosting import Boosted, GradientBoosting
from tramline.operators.detector import Detector, mad, restart_cusum_fold, with_cusum, with_restart_cusum
from tramline.operators.forecast import HierarchicalSeasonal, SeasonalNaive
from tramline.plans import serving
from tramline.plans.build import train

SHAPE = [1000, 1100, 1150, 1120, 1300, 700, 500]
MONDAY = date(2022, 1, 3)
SCHEMA = "date date, series_id string, line_id string, station_id string, value double"


def rows(days, series=("1:a", "1:b", "2:c"), noise=20, seed=4242, start=MONDAY):
    rng = random.Random(seed)
    return [(start + timedelta(days=i), s, *s.split(":"), max(0.0, SHAPE[i % 7] * (0.6 + 0.4 * k) + rng.gauss(0, noise))) for k, s in enumerate(series) for i in range(days)]


def frame(spark, data):
    return spark.createDataFrame(data, SCHEMA)


def forecast(model, df, n=14):
    return {(r.series_id, r.horizon): r.prediction for r in model.predict(model.fit(df), n).collect()}


def test_naive_repeats_the_week_and_skips_closures(spark):
    data = rows(90, ("1:a",), noise=0)
    got = forecast(SeasonalNaive(), frame(spark, data), 7)
    assert all(abs(got["1:a", h] - SHAPE[(90 - 1 + h) % 7] * 0.6) < 1e-9 for h in range(1, 8))
    gap = [(*r[:4], None if i >= 90 - 21 else r[4]) for i, r in enumerate(data)]
    assert forecast(SeasonalNaive(), frame(spark, gap), 7) == got
    gone = [(*r[:4], None if i >= 90 - 60 else r[4]) for i, r in enumerate(data)]
    assert set(forecast(SeasonalNaive(), frame(spark, gone), 7).values()) == {None}
    with pytest.raises(ValueError):
        forecast(SeasonalNaive(), frame(spark, data), 0)


def test_seasonal_model_recovers_the_shape(spark):
    got = forecast(HierarchicalSeasonal(), frame(spark, rows(180, ("1:a",), noise=0)), 7)
    assert all(abs(got["1:a", h] / (SHAPE[(180 - 1 + h) % 7] * 0.6) - 1) < 0.02 for h in range(1, 8))


@pytest.mark.parametrize("model", [SeasonalNaive(), HierarchicalSeasonal()])
def test_no_leakage(spark, model):
    data, cut = rows(500), MONDAY + timedelta(days=400)
    fit = lambda change: forecast(model, frame(spark, [change(r) for r in data]).filter(F.col("date") <= F.lit(cut)))
    clean = fit(lambda r: r)
    assert fit(lambda r: (*r[:4], r[4] * 9) if r[0] > cut else r) == clean
    assert fit(lambda r: (*r[:4], r[4] * 9) if r[0] > cut - timedelta(days=80) else r) != clean


def test_features_see_no_future(spark):
    data, origin = rows(420), MONDAY + timedelta(days=380)
    pick = lambda change: sorted(map(str, features.supervised_frame(frame(spark, [change(r) for r in data]), [1, 7, 14]).filter(F.col("origin") <= F.lit(origin)).drop("target").collect()))
    assert pick(lambda r: r) == pick(lambda r: (*r[:4], r[4] + 500) if r[0] > origin else r)
    assert pick(lambda r: r) != pick(lambda r: (*r[:4], r[4] + 500) if r[0] == origin else r)


def test_supervised_and_prediction_frames_agree(spark):
    data = rows(400)
    last = MONDAY + timedelta(days=385)
    serve = features.prediction_frame(frame(spark, [r for r in data if r[0] <= last]), list(range(1, 15)))
    learn = features.supervised_frame(frame(spark, data), list(range(1, 15))).filter(F.col("origin") == F.lit(last))
    assert serve.count() == 3 * 14
    key = ["series_id", "horizon"]
    assert [r.asDict() for r in serve.orderBy(*key).collect()] == [r.asDict() for r in learn.drop("target").orderBy(*key).select(serve.columns).collect()]
    assert set(features.feature_columns(learn)) == set(learn.columns) - {"target", "date", "origin", "series_id"}


def test_boosting_contract(spark, tmp_path):
    df = frame(spark, rows(440, seed=99))
    model = GradientBoosting(horizons=3, trees=3, depth=3, train_years=1)
    fitted = model.fit(df)
    got = model.predict(fitted, 3).collect()
    assert len(got) == 9 and all(r.prediction >= 0 for r in got)
    with pytest.raises(ValueError):
        model.predict(fitted, 4)
    with pytest.raises(ValueError):
        GradientBoosting().fit(frame(spark, rows(100)))
    assert fitted.feature_importance(spark).first().importance > 0
    fitted.save(f"{tmp_path}/model")
    ((key, history, _),) = fitted.parts
    read = Boosted(fitted.value, [(key, history, PipelineModel.load(f"{tmp_path}/model"))])
    assert sorted(model.predict(read, 3).collect()) == sorted(got)


def test_boosting_is_a_forecaster_of_backtest_and_gate(spark):
    """Scored beside the others, a model per fold; on the noisy weekly shape it beats the naive one."""
    panel = frame(spark, rows(470, noise=120, seed=99))
    folds = evaluation.fold_frame(panel, n_folds=2, horizon=3, min_train_days=420)
    models = {"gbm": GradientBoosting(horizons=3, trees=12, depth=5, train_years=1, rate=0.3)}
    per_fold, per_horizon, predictions = evaluation.backtest(panel, folds, models, horizon=3)
    scores = per_fold.collect()
    assert {(r.fold, r.model) for r in scores} == {(f, m) for f in (0, 1) for m in ("gbm", "seasonal_naive")}
    assert predictions.filter("model = 'gbm'").groupBy("fold", "horizon").count().filter("count <> 3").isEmpty()
    passed, told = evaluation.check_gate(per_fold, "gbm", 1.0)
    assert passed and "gbm" in told


@pytest.mark.parametrize(("x", "want"), [([1, 2, 3, 4, 5], 1.0), ([1, 2, 3, 4, 10000], 1.0), ([None, None], None)])
def test_mad(spark, x, want):
    df = spark.createDataFrame([("a", None if v is None else float(v)) for v in x], "k string, v double")
    assert mad(df, "v", ("k",)).first().mad == want


def loop(z, reset=None, drift=0.5):
    out, s = [], 0.0
    for x in z:
        s = s if x is None else min(0.0, s + x + drift)
        out.append(s)
        if reset is not None and s <= -reset:
            s = 0.0
    return out


RNG = random.Random(8)
WALK = [None if RNG.random() < 0.1 else RNG.gauss(-0.3, 1.5) for _ in range(300)]


@pytest.mark.parametrize("z", [[-2.0] * 10, [-3.0] * 5 + [0.0] * 30, [-8.0] * 60 + [0.0] * 30, [-3.0] * 5 + [None] * 3, WALK])
@pytest.mark.parametrize("reset", [None, 4.0, 50.0])
def test_cusum_equals_a_loop(spark, z, reset):
    df = spark.createDataFrame([("a", MONDAY + timedelta(days=i), x, reset) for i, x in enumerate(z)], "series_id string, date date, z double, lim double")
    outs = [with_cusum(df)] if reset is None else [with_restart_cusum(df, "lim"), restart_cusum_fold(df, F.col("lim"))]
    for out in outs:
        assert np.allclose([r.cusum for r in out.orderBy("date").collect()], loop(z, reset), atol=1e-9)


def detector_rows(change=None):
    data = rows(730, tuple(f"{1 + k // 6}:s{k:02d}" for k in range(12)), noise=40, seed=31415)
    return [change(r) for r in data] if change else data


def test_detector_finds_shortfalls_only(spark):
    hit = MONDAY + timedelta(days=725)

    def change(r):
        if r[0] == hit and r[2] == "1" and r[3] in ("s00", "s01", "s02"):
            return (*r[:4], 0.0)
        return (*r[:4], r[4] * 5) if r[0] == hit and r[2] == "2" else r

    clean, broken = frame(spark, detector_rows()), frame(spark, detector_rows(change))
    detector = Detector(rates=(0.0005, 0.01, 0.05))
    params, cuts = detector.fit(clean)
    limits = [(r.z_cutoff, r.cusum_cutoff) for r in cuts.orderBy("rate").collect()]
    assert limits == sorted(limits, reverse=True) and min(min(x) for x in limits) >= 1
    recent = broken.filter(F.col("date") > F.lit(MONDAY + timedelta(days=700)))
    flags = detector.detect(recent, params, cuts).cache()
    day = {(r.series_id, r.reason) for r in flags.filter((F.col("date") == F.lit(hit)) & (F.col("rate") == 0.01) & F.col("is_anomaly")).collect()}
    assert {(f"1:s0{k}", "extreme day") for k in range(3)} <= day and not any(s.startswith("2:") for s, _ in day)
    lines = {(r.date, r.line_id) for r in detector.line_incidents(flags).filter("rate = 0.01").collect()}
    assert (hit, "1") in lines
    pinned = Detector(threshold=3.0, cusum_threshold=9.0).fit(clean)[1].first()
    assert (pinned.z_cutoff, pinned.cusum_cutoff) == (3.0, 9.0)


def test_flat_series_is_never_scored(spark):
    flat = [(MONDAY + timedelta(days=i), "1:a", "1", "a", 100.0) for i in range(300)]
    params, cuts = Detector().fit(frame(spark, flat))
    assert params.first().scale is None and cuts.first().z_cutoff == 4.0


@pytest.mark.parametrize(
    ("data", "want"),
    [
        ([(100, 110, 120), (200, 200, 220), (100, 90, 120), (200, 180, 220)], dict(mae=10.0, relative_mae=0.5)),
        ([(100, 100, 100), (None, 5000, 1)], dict(mae=0.0, relative_mae=None, n_scored=1)),
        ([(100, 100, 90), (100, None, 90)], dict(mae=50.0)),
        ([(0, 0, 1), (100, 150, 1)], dict(smape=40.0)),
    ],
)
def test_metrics(spark, data, want):
    f = lambda v: None if v is None else float(v)
    truth = spark.createDataFrame([(0, "a", MONDAY + timedelta(days=i), f(y)) for i, (y, _, _) in enumerate(data)], "fold int, series_id string, date date, y double")
    pred = spark.createDataFrame([(0, "a", MONDAY + timedelta(days=i), m, f(v)) for i, (_, p, b) in enumerate(data) for m, v in (("m", p), (evaluation.BASELINE, b))], "fold int, series_id string, date date, model string, prediction double")
    got = {r.model: r for r in evaluation.score_forecasts(truth, pred, None, ("fold",)).collect()}
    assert {k: got["m"][k] for k in want} == want
    assert got[evaluation.BASELINE].relative_mae in (1.0, None)


def test_insample(spark):
    df = frame(spark, [(MONDAY + timedelta(days=i), "1:a", "1", "a", float(i)) for i in range(21)])
    assert evaluation.insample_mae(df).first().insample_mae == 7
    assert evaluation.insample_mae(df.filter(F.col("date") < F.lit(MONDAY + timedelta(days=7)))).first().insample_mae is None


def test_folds():
    first, last = date(2020, 1, 1), date(2024, 12, 31)
    found = evaluation.rolling_origin_folds(first, last, n_folds=4)
    assert [f.index for f in found] == [3, 2, 1, 0] and found[-1].test_end == last and all(f.horizon == 14 for f in found)
    assert all((b.test_start - a.test_end).days == 1 for a, b in zip(found, found[1:])) and all(f.train_start == first for f in found)
    with pytest.raises(ValueError):
        evaluation.rolling_origin_folds(first, last, min_train_days=3650)
    with pytest.raises(LeakageError):
        evaluation.Fold(0, first, last, last, last)
    with pytest.raises(ValueError):
        evaluation.Fold(0, last, first, last, last)


def test_backtest_and_gate(spark):
    df = frame(spark, rows(300, ("1:a",)))
    per_fold, per_horizon, _ = evaluation.backtest(df, evaluation.fold_frame(df, n_folds=2, horizon=7, min_train_days=200), horizon=7)
    got = {(r.fold, r.model): r for r in per_fold.collect()}
    assert len(got) == 4 and all(r.relative_mae == 1.0 for (_, m), r in got.items() if m == evaluation.BASELINE)
    assert per_horizon.count() == 2 * 7 * 2
    assert evaluation.check_gate(per_fold, "hierarchical", 10.0)[0] is True
    assert evaluation.check_gate(per_fold, "hierarchical", 0.0)[0] is False
    assert evaluation.check_gate(per_fold, "nobody")[0] is False
    assert evaluation.summarize(per_fold).count() == 2


def test_onsets_and_days(spark):
    label = [0, 1, 1, 1, 1, None, 1, 0]
    flag = [1, 0, 0, 0, 1, 1, 1, 0]
    truth = spark.createDataFrame([("a", MONDAY + timedelta(days=i), x) for i, x in enumerate(label)], "series_id string, date date, label int")
    flags = spark.createDataFrame([(0.01, "a", MONDAY + timedelta(days=i), bool(x)) for i, x in enumerate(flag)], "rate double, series_id string, date date, is_anomaly boolean")
    got = sorted((r.days, r.detected) for r in evaluation.event_onsets(flags, truth).collect())
    assert got == [(1, True), (4, False)]
    day = evaluation.score_days(flags, truth).first()
    assert (day.n_days_scored, day.true_positives, day.false_positives, day.false_negatives) == (7, 2, 1, 3)
    curve = evaluation.operating_curve(flags, truth).first()
    assert curve.alerts_per_day == 0.5 and curve.onset_recall_1d == 1 and curve.onset_recall_4d_plus == 0


def test_artifacts_and_serving(spark, tmp_path):
    data = [(r[0], r[2], r[3], f"Name {r[3]}", r[4], "operating", r[4]) for r in rows(400)]
    panel = spark.createDataFrame(data, "date date, line_id string, station_id string, station_name string, ridership double, status string, target double")
    with pytest.raises(ArtifactsUnavailable, match="forecast"):
        serving.load_store(spark, str(tmp_path / "none"))
    coords = spark.createDataFrame([("1", "a", -99.1, 19.4)], "line_id string, station_id string, longitude double, latitude double")
    meta = train(panel, HierarchicalSeasonal(), str(tmp_path), coordinates=coords, trained_at="now")
    store = serving.load_store(spark, str(tmp_path))
    assert meta["n_series"] == 3 and store.forecast.count() == 3 * 14 and store.anomalies.count() == 3 * 120
    assert serving.health(store).first().data_through == meta["data_through"]
    assert [(r.series_id, r.longitude) for r in store.stations().collect()] == [("1:a", -99.1), ("1:b", None), ("2:c", None)]
    assert serving.filter_forecast(store.forecast, line="1", horizon=2).count() == 2 and serving.filter_forecast(store.forecast, line="1").count() == 28
    assert serving.filter_forecast(store.forecast, line="Z").count() == 0
    assert serving.filter_anomalies(store.anomalies, station="a", date="1900-01-01", flagged_only=False).count() == 120
    flagged = serving.filter_anomalies(store.anomalies).collect()
    assert len(flagged) == meta["anomalies_flagged"] and flagged == sorted((r for r in flagged if r.is_anomaly), key=lambda r: (-r.date.toordinal(), r.score))
    seen = serving.filter_anomalies(store.anomalies, flagged_only=False).collect()
    assert [(r.date, r.series_id) for r in seen] == sorted((r.date, r.series_id) for r in seen)
    assert meta["has_coordinates"] and meta["n_panel_rows"] == panel.count() and serving.metadata(store).count() == 1
    for call in (lambda: serving.filter_forecast(store.forecast, station="q"), lambda: serving.filter_anomalies(store.anomalies, date="1900-01-01"), lambda: serving.filter_stations(store.stations(), "Z")):
        with pytest.raises(NotFound):
            call()
    with pytest.raises(ValueError):
        serving.filter_forecast(store.forecast, horizon=15)
    assert '"longitude":null' in serving.records(store.stations()).collect()[1].record


def test_boosted_query_is_the_whole_forecast(monkeypatch):
    from tramline import queries

    made = []

    class Recorded(queries.GradientBoosting):
        def fit(self, history, by=("series_id",), value="value"):
            made.append(self)

        def predict(self, params, horizon, by=("series_id",)):
            raise LookupError(horizon)

    monkeypatch.setattr(queries, "GradientBoosting", Recorded)
    monkeypatch.setattr(queries, "shipments_panel", lambda spark, d: None)
    with pytest.raises(LookupError, match="^14$"):
        queries.QUERIES["gbt_forecast"](None, "")
    assert (made[0].horizons, made[0].train_years) == (14, 3)


def test_onsets_query_keeps_short_runs(spark, monkeypatch):
    from tramline import queries

    days = [(date(2024, 1, i + 1), int(i in (2, 5, 6, 7, 8, 9))) for i in range(12)]
    flags = spark.createDataFrame([(0.01, "s", d, True) for d, _ in days], "rate double, series_id string, date date, is_anomaly boolean")
    truth = spark.createDataFrame([("s", d, y) for d, y in days], "series_id string, date date, label int")
    monkeypatch.setattr(queries, "_walked", lambda spark, d: (flags, truth))
    assert sorted(r.days for r in queries.QUERIES["event_onsets"](spark, "").collect()) == [1, 5]
