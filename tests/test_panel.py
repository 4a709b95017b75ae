from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from tramline.errors import PanelError
from tramline.operators import islands, panel

DAY = date(2024, 1, 1)


def frame(spark, series: dict[str, list]):
    rows = [(DAY + timedelta(days=i), "1", s, None if v is None else float(v)) for s, values in series.items() for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "date date, line_id string, station_id string, ridership double")


def statuses(df, station="a", **how):
    rows = islands.service_status(df, **how).filter(F.col("station_id") == station).orderBy("date").collect()
    return [r.status for r in rows]


O, C, N, M = "operating", "closed", "not_yet_open", "not_measured"


@pytest.mark.parametrize(
    ("values", "how", "want"),
    [
        ([0, 0, 0, 0, 100, 110, 120], {}, [N] * 4 + [O] * 3),
        ([100, 110, 0, 0, 0, 0, 120], {}, [O, O, C, C, C, C, O]),
        ([0, 0, 100, 110, 120], {}, [O] * 5),
        ([100, 0, 0, 0, 120], {}, [O] * 5),
        ([100, 0, 0, 0, 0, 0, 100], {}, [O] + [C] * 5 + [O]),
        ([100, 0, 0, 100], {"min_closure_days": 2}, [O, C, C, O]),
        ([100, None, None, None, None, 100], {}, [O] * 6),
        ([0, 0, 5], {}, [O] * 3),
    ],
)
def test_status_of_runs(spark, values, how, want):
    assert statuses(frame(spark, {"a": values}), **how) == want


def test_outages_override_but_count(spark):
    both = frame(spark, {"a": [100, 0, 0, 120], "b": [200, 0, 0, 220]})
    assert statuses(both, min_network_size=2) == statuses(both, "b", min_network_size=2) == [O, M, M, O]
    mixed = frame(spark, {"a": [100, 0, 0, 0, 0, 100], "b": [200, 210, 0, 220, 230, 240]})
    assert statuses(mixed, min_network_size=2) == [O, C, M, C, C, O]
    assert statuses(both) == [O] * 4  # too small a network


def test_missing_columns(spark):
    with pytest.raises(PanelError):
        islands.service_status(spark.createDataFrame([(DAY,)], "date date"))


@pytest.mark.parametrize(("flags", "want"), [([0, 1, 1, 0, 1], [(1, 2), (4, 4)]), ([1, 0, 1], [(0, 0), (2, 2)]), ([], []), ([1, None, 1], [(0, 0), (2, 2)])])
def test_runs(spark, flags, want):
    df = spark.createDataFrame([("a", DAY + timedelta(days=i), None if f is None else bool(f)) for i, f in enumerate(flags)], "k string, date date, f boolean")
    got = sorted((r.start, r.end) for r in islands.find_runs(df, F.col("f"), ["k"]).collect())
    assert got == [(DAY + timedelta(days=a), DAY + timedelta(days=b)) for a, b in want]


def test_interruptions_of_touching_statuses_stay_apart(spark):
    rows = [(DAY + timedelta(days=i), "1", "a", s) for i, s in enumerate([N, N, C, C, M, O])]
    df = spark.createDataFrame(rows, "date date, line_id string, station_id string, status string")
    got = {(r.status, r.days) for r in islands.interruptions(df).collect()}
    assert got == {(N, 2), (C, 2), (M, 1)}


def test_events_join_stations_of_one_span(spark):
    closed = [100] + [0] * 8 + [100]
    found = islands.interruptions(islands.service_status(frame(spark, {"b": closed, "a": closed, "c": [100] * 2 + [0] * 7 + [100]})))
    rows = islands.network_events(found).collect()
    assert [(r.days, r.n_stations, r.stations) for r in rows] == [(8, 2, "a|b"), (7, 1, "c")]
    assert islands.network_events(found, min_days=9).collect() == []


def test_densify(spark):
    obs = spark.createDataFrame([(DAY + timedelta(days=d), "1", s, float(v)) for d, s, v in [(2, "a", 5), (4, "a", 6), (0, "b", 7), (5, "b", 8)]], "date date, line_id string, station_id string, value double")
    got = {(r.station_id, (r.date - DAY).days): r.value for r in panel.densify(obs).collect()}
    assert len(got) == 12 and {k: v for k, v in got.items() if v is not None} == {("a", 2): 5, ("a", 4): 6, ("b", 0): 7, ("b", 5): 8}
    panel.assert_rectangular(panel.densify(obs))
    with pytest.raises(PanelError):
        panel.assert_rectangular(obs)
    wide = panel.to_wide(panel.with_series(panel.densify(obs, fill=0.0)), series=["1:a", "1:b"])
    assert wide.columns == ["date", "1:a", "1:b"] and wide.count() == 6


def test_voided_duplicates_are_ambiguous(spark):
    rows = [(DAY, "1", "a", "A", 5, False), (DAY + timedelta(days=1), "1", "a", "A", 6, True), (DAY + timedelta(days=1), "1", "a", "B", 7, True), (DAY + timedelta(days=2), "1", "z", "Z", 1, True), (DAY + timedelta(days=2), "1", "a", "B", 2, False), (DAY + timedelta(days=3), "1", "a", "B", 2, False)]
    df = spark.createDataFrame(rows, "date date, line_id string, station_id string, station_name string, ridership long, is_duplicate boolean")
    out = islands.with_target(islands.service_status(panel.rectangular_panel(df))).orderBy("date").collect()
    assert [(r.ridership, r.status, r.target, r.station_name) for r in out] == [(5, O, 5, "B"), (None, "ambiguous_label", None, "B"), (2, O, 2, "B"), (2, O, 2, "B")]


@pytest.mark.parametrize(("h", "lag"), [(1, 6), (6, 1), (7, 0), (8, 6), (14, 0)])
def test_same_weekday_lag(h, lag):
    assert panel.same_weekday_lag(h) == lag
