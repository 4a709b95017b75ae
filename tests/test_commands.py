import csv
import glob
from datetime import date, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from tramline.__main__ import main
from tramline.operators.detector import Detector
from tramline.operators.islands import CLOSED, OPERATING
from tramline.operators.quantiles import pooled_quantiles

START = date(2023, 1, 2)
SHAPE = [900, 950, 980, 990, 1100, 640, 410]
RATES = (0.0, 0.0005, 0.01, 0.3, 0.5, 0.999, 1.0)


@pytest.mark.parametrize("name", ["plain", "ties", "wide", "near", "one"])
def test_pooled_quantiles_equal_sorting(spark, name):
    rng = np.random.default_rng(17)
    values = {
        "plain": rng.normal(0, 5, 900),
        "ties": rng.choice([-3.0, -0.0, 0.0, 2.0], 900),
        "wide": rng.normal(0, 1, 900) * 10.0 ** rng.integers(-300, 300, 900),
        "near": -4 + rng.random(900) * 1e-9,
        "one": np.array([7.5]),
    }[name]
    df = spark.createDataFrame([("a", float(v)) for v in values] + [("a", None), ("b", None), ("c", float("nan")), ("c", 1.0)], "g string, v double")
    got = {(r.g, r.rate): r.v for r in pooled_quantiles(df, ("v",), RATES, ("g",)).collect()}
    assert len(got) == 3 * len(RATES)
    for q in RATES:
        assert got["a", q] == pytest.approx(float(np.quantile(values, q)), rel=1e-12)
        assert got["b", q] is None and got["c", q] == 1.0


def test_pooled_quantiles_without_rows(spark):
    none = spark.createDataFrame([], "g string, v double")
    assert pooled_quantiles(none, ("v",), (0.1,), ("g",)).count() == 0
    assert [tuple(r) for r in pooled_quantiles(none, ("v",), (0.1,)).collect()] == [(0.1, None)]


@pytest.fixture(scope="module")
def panel(spark, tmp_path_factory):
    rng = np.random.default_rng(5)
    rows = []
    for k, (line, station) in enumerate([("1", "alta"), ("1", "baja"), ("1", "cruz"), ("2", "dos")]):
        for i in range(500):
            shut = station == "baja" and 470 <= i < 478
            v = 0.0 if shut else float(round(SHAPE[i % 7] * (1 + 0.3 * k) + rng.normal(0, 15)))
            rows.append((START + timedelta(days=i), line, station, station.title(), v, CLOSED if shut else OPERATING, None if shut else v))
    path = str(tmp_path_factory.mktemp("panel") / "panel")
    spark.createDataFrame(rows, "date date, line_id string, station_id string, station_name string, ridership double, status string, target double").write.parquet(path)
    return path


def read(folder):
    return [r for f in glob.glob(f"{folder}/*.csv") for r in csv.DictReader(open(f, encoding="utf-8"))]


def test_rate_changes_without_a_fit(spark, panel):
    rows = spark.read.parquet(panel).withColumn("series_id", F.concat_ws(":", "line_id", "station_id"))
    detector = Detector(rates=(0.01,))
    _, scored = detector.calibrated(rows, "target")
    other, cuts = detector.set_false_alarm_rate(0.05, scored)
    assert other.rates == (0.05,) and detector.rates == (0.01,)
    assert cuts.collect() == Detector(rates=(0.05,)).fit(rows, "target")[1].collect()
    assert cuts.first().z_cutoff <= detector.cutoffs(scored).first().z_cutoff
    with pytest.raises(ValueError):
        detector.set_false_alarm_rate(1.5, scored)


def test_backtest_writes_scores_and_gates(spark, panel, tmp_path, capsys):
    args = ["backtest", panel, str(tmp_path), "--folds", "2", "--horizon", "7", "--min-train-days", "200", "--models", "hierarchical"]
    assert main(args, spark) == 0
    assert {(r["fold"], r["model"]) for r in read(tmp_path / "backtest_folds")} == {(f, m) for f in "01" for m in ("hierarchical", "seasonal_naive")}
    assert len(read(tmp_path / "backtest_horizons")) == 2 * 7 * 2
    assert main([*args, "--gate", "0.95"], spark) == 1  # the gated model has no scores
    assert "shut" in capsys.readouterr().out


def test_evaluate_writes_curve_events_and_days(spark, panel, tmp_path):
    assert main(["evaluate", panel, str(tmp_path), "--rates", "0.01", "0.05", "--warmup-months", "12"], spark) == 0
    assert sorted(float(r["rate"]) for r in read(tmp_path / "anomaly_curve")) == [0.01, 0.05]
    (event,) = read(tmp_path / "anomaly_events")
    assert (event["series_id"].endswith("baja"), event["days"], event["detected"]) == (True, "8", "true")
    assert [r["rate"] for r in read(tmp_path / "anomaly_days")] == ["0.01"]


def test_what_is_not_there_is_status_2(spark, tmp_path, capsys):
    assert main(["backtest", str(tmp_path / "none"), str(tmp_path)], spark) == 2
    assert "build it first" in capsys.readouterr().err
