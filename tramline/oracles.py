"""The queries again, as independent SQL for DuckDB over the same tables."""

from __future__ import annotations

_DAYS = "SELECT CAST(unnest(generate_series((SELECT min(date) FROM {0}), (SELECT max(date) FROM {0}), INTERVAL 1 DAY)) AS DATE) AS date"

_SP = f"""
sp_obs AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS line_id, o_orderstatus AS station_id, CAST(count(*) AS DOUBLE) AS n FROM orders GROUP BY ALL),
sp_days AS ({_DAYS.format("sp_obs")}),
sp AS (SELECT line_id || ':' || station_id AS series_id, line_id, station_id, date, coalesce(n, 0) AS ridership
       FROM (SELECT DISTINCT line_id, station_id FROM sp_obs) CROSS JOIN sp_days LEFT JOIN sp_obs USING (line_id, station_id, date))"""

_DP = f"""
dp_obs AS (SELECT CAST(l_shipdate AS DATE) AS date, l_linestatus AS line_id, l_returnflag AS station_id, sum(l_quantity) AS n FROM lineitem GROUP BY ALL),
dp_days AS ({_DAYS.format("dp_obs")}),
dp AS (SELECT line_id || ':' || station_id AS series_id, line_id, station_id, date, coalesce(n, 0) AS value
       FROM (SELECT DISTINCT line_id, station_id FROM dp_obs) CROSS JOIN dp_days LEFT JOIN dp_obs USING (line_id, station_id, date))"""

_DPX = _DP + """,
dpx AS (SELECT series_id, line_id, station_id, date,
        CASE WHEN series_id = 'O:A' AND date BETWEEN DATE '1999-03-01' AND DATE '1999-03-10' THEN 0.0
             WHEN series_id = 'F:R' AND date BETWEEN DATE '2000-06-05' AND DATE '2000-06-09' THEN 0.0
             WHEN series_id = 'O:N' AND date BETWEEN DATE '2001-09-01' AND DATE '2001-09-28' THEN 0.0
             WHEN line_id = 'O' AND date BETWEEN DATE '2001-10-10' AND DATE '2001-10-13' THEN 0.0
             ELSE value END AS ridership FROM dp)"""


def _islands(src: str, flag: str, out: str) -> str:
    """Rows of ``src`` with a number for the run of ``flag`` they are in."""
    return f"""{out}_c AS (SELECT *, {flag} AS flag, CASE WHEN {flag} IS DISTINCT FROM lag({flag}) OVER (PARTITION BY series_id ORDER BY date) THEN 1 ELSE 0 END AS turn FROM {src}),
{out} AS (SELECT *, sum(turn) OVER (PARTITION BY series_id ORDER BY date) AS island FROM {out}_c)"""


def _status(src: str, out: str) -> str:
    return f"""{_islands(src, "(ridership = 0)", out + "_i")},
{out}_out AS (SELECT date FROM {src} GROUP BY date HAVING count(*) FILTER (ridership = 0) = count(*) AND (SELECT count(DISTINCT series_id) FROM {src}) >= 10),
{out}_s AS (SELECT *, count(*) OVER (PARTITION BY series_id, island) AS run, min(date) OVER (PARTITION BY series_id, island) = min(date) OVER (PARTITION BY series_id) AS opens FROM {out}_i),
{out} AS (SELECT series_id, line_id, station_id, date, ridership,
  CASE WHEN ridership IS NULL THEN 'ambiguous_label' WHEN date IN (SELECT date FROM {out}_out) THEN 'not_measured'
       WHEN flag AND run >= 4 AND opens THEN 'not_yet_open' WHEN flag AND run >= 4 THEN 'closed' ELSE 'operating' END AS status FROM {out}_s)"""


_SPS = _SP + ",\n" + _status("sp", "sps")
_DPS = _DPX + ",\n" + _status("dpx", "dps0") + ",\ndps AS (SELECT *, CASE WHEN status = 'operating' THEN ridership END AS target FROM dps0)"


def _seasonal(src: str, by: str, value: str, out: str) -> str:
    """Level, weekday and month factors of the series ``by`` of ``src``."""
    return f"""{out}_l AS (SELECT *, CASE WHEN count({value}) OVER w >= 14 THEN quantile_cont({value}, 0.5) OVER w END AS level_at, isodow(date) - 1 AS dow, month(date) AS mon
  FROM {src} WINDOW w AS (PARTITION BY {by} ORDER BY date ROWS BETWEEN 55 PRECEDING AND CURRENT ROW)),
{out}_r AS (SELECT *, CASE WHEN level_at > 0 THEN {value} / level_at END AS ratio FROM {out}_l),
{out}_w AS (SELECT {by}, dow, CASE WHEN count(ratio) >= 8 THEN median(ratio) ELSE 1.0 END AS wf FROM {out}_r GROUP BY ALL),
{out}_m AS (SELECT {by}, mon, CASE WHEN count(rest) >= 8 THEN median(rest) ELSE 1.0 END AS mf FROM (SELECT r.*, ratio / nullif(wf, 0) AS rest FROM {out}_r r JOIN {out}_w USING ({by}, dow)) GROUP BY ALL),
{out}_c AS (SELECT {by}, arg_max(level_at, date) FILTER (level_at IS NOT NULL) AS level, max(date) AS last_date FROM {out}_l GROUP BY ALL)"""


def _expected(src: str, by: str, fit: str, out: str) -> str:
    return f"""{out} AS (SELECT s.*, level * coalesce(wf, 1.0) * coalesce(mf, 1.0) AS expected FROM {src} s JOIN {fit}_c USING ({by})
  LEFT JOIN {fit}_w ON {" AND ".join(f"s.{b.strip()} = {fit}_w.{b.strip()}" for b in by.split(","))} AND isodow(s.date) - 1 = {fit}_w.dow
  LEFT JOIN {fit}_m ON {" AND ".join(f"s.{b.strip()} = {fit}_m.{b.strip()}" for b in by.split(","))} AND month(s.date) = {fit}_m.mon)"""


def _detector(src: str, value: str, out: str, by: str = "series_id", frame: str = "") -> str:
    """Fit on ``src``: parameters ``out``_p and scored calibration days ``out``_z."""
    part = f"PARTITION BY {frame}" if frame else ""
    return f"""{_seasonal(src, by, value, out)},
{out}_k AS (SELECT * FROM (SELECT *, max(date) OVER ({part}) AS ends FROM {src}) WHERE date > ends - 180),
{_expected(out + "_k", by, out, out + "_e")},
{out}_q AS (SELECT *, {value} - expected AS res, median({value} - expected) OVER (PARTITION BY {by}) AS center FROM {out}_e),
{out}_p AS (SELECT {by}, any_value(center) AS center, CASE WHEN median(abs(res - center)) * 1.4826 > 1 THEN median(abs(res - center)) * 1.4826 END AS scale FROM {out}_q GROUP BY ALL),
{out}_y AS (SELECT q.* EXCLUDE (center), (res - p.center) / p.scale AS z FROM {out}_q q JOIN {out}_p p USING ({by})),
{out}_x AS (SELECT *, sum(coalesce(z + 0.5, 0)) OVER (PARTITION BY {by} ORDER BY date) AS total FROM {out}_y),
{out}_z AS (SELECT *, total - greatest(0, max(total) OVER (PARTITION BY {by} ORDER BY date)) AS cusum FROM {out}_x)"""


def _cut_each(fit: str, rates: list[str], out: str, frame: str = "") -> str:
    keys = f"{frame}, " if frame else ""
    one = "SELECT {k}CAST({r} AS DOUBLE) AS rate, CASE WHEN count(z) = 0 THEN 4.0 ELSE greatest(-quantile_cont(z, {r}), 1.0) END AS z_cutoff, CASE WHEN count(cusum) = 0 THEN 8.0 ELSE greatest(-quantile_cont(cusum, {r}), 1.0) END AS cusum_cutoff FROM {f}_z {g}"
    return f"{out} AS (" + " UNION ALL ".join(one.format(k=keys, r=x, f=fit, g=f"GROUP BY {frame}" if frame else "") for x in rates) + ")"


RATES = ["0.0005", "0.002", "0.01", "0.05"]


def _restart(src: str, by: str, limit: str, out: str) -> str:
    """The restarting CUSUM by recursion over the days of each series."""
    keys = ", ".join(f"r.{b.strip()}" for b in by.split(","))
    same = " AND ".join(f"r.{b.strip()} = n.{b.strip()}" for b in by.split(","))
    state = f"CASE WHEN r.cusum <= -r.{limit} THEN 0 ELSE r.cusum END"
    return f"""{out}_n AS (SELECT {by}, date, z, {limit}, row_number() OVER (PARTITION BY {by} ORDER BY date) AS n FROM {src}),
{out} AS (SELECT {by}, date, n, {limit}, CASE WHEN z IS NULL THEN 0.0 ELSE least(0.0, z + 0.5) END AS cusum FROM {out}_n WHERE n = 1
  UNION ALL SELECT {keys}, n.date, n.n, n.{limit}, CASE WHEN n.z IS NULL THEN {state} ELSE least(0.0, {state} + n.z + 0.5) END FROM {out} r JOIN {out}_n n ON {same} AND n.n = r.n + 1)"""


_FLAGS = _DPS + ",\n" + _detector("dps", "target", "d") + ",\n"
_RECENT = "rec0 AS (SELECT * FROM dps WHERE date > (SELECT max(date) FROM dps) - 120),\n" + _expected("rec0", "series_id", "d", "rec1")


def _flagged(rates: list[str]) -> str:
    return f"""{_FLAGS}{_RECENT},
{_cut_each("d", rates, "cut")},
rec AS (SELECT r.*, (ridership - expected - center) / scale AS z, rate, z_cutoff, cusum_cutoff FROM rec1 r JOIN d_p USING (series_id) CROSS JOIN cut),
{_restart("rec", "series_id, rate", "cusum_cutoff", "cs")},
flags AS (SELECT rec.*, cs.cusum, coalesce(z <= -z_cutoff, false) AS extreme, coalesce(cs.cusum <= -rec.cusum_cutoff, false) AS drifted FROM rec JOIN cs USING (series_id, rate, date))"""


_FOLDS = _DP + """,
folds AS (SELECT fold, first AS train_start, CAST(last - CAST(fold * 14 + 14 AS INTEGER) AS DATE) AS train_end, CAST(last - CAST(fold * 14 + 13 AS INTEGER) AS DATE) AS test_start, CAST(last - CAST(fold * 14 AS INTEGER) AS DATE) AS test_end
  FROM (SELECT min(date) AS first, max(date) AS last FROM dp) CROSS JOIN (SELECT unnest(range(12)) AS fold) WHERE last - fold * 14 - 14 - first + 1 >= 1095)""".replace("last - fold * 14 - 14 - first + 1", "(last - first) - fold * 14 - 14 + 1")

_BACKTEST = f"""{_FOLDS},
hist AS (SELECT fold, train_end, dp.* FROM dp JOIN folds ON date BETWEEN train_start AND train_end),
{_seasonal("hist", "fold, series_id", "value", "b")},
test AS (SELECT fold, series_id, date, CAST(date - train_end AS BIGINT) AS horizon, value AS y FROM dp JOIN folds ON date BETWEEN test_start AND test_end),
{_expected("test", "fold, series_id", "b", "be")},
naive AS (SELECT fold, series_id, isodow(date) - 1 AS dow, arg_max(value, date) AS prediction FROM hist WHERE date > train_end - 56 AND value IS NOT NULL GROUP BY ALL),
pred AS (SELECT fold, series_id, date, horizon, y, 'hierarchical' AS model, coalesce(expected, 0) AS p FROM be
  UNION ALL SELECT fold, t.series_id, date, horizon, y, 'seasonal_naive', coalesce(prediction, 0) FROM test t LEFT JOIN naive n USING (fold, series_id) WHERE n.dow IS NULL OR n.dow = isodow(t.date) - 1),
ins AS (SELECT fold, avg(abs(value - back)) AS insample FROM (SELECT fold, value, lag(value, 7) OVER (PARTITION BY fold, series_id ORDER BY date) AS back FROM hist) GROUP BY fold),
raw AS (SELECT fold, model, avg(abs(y - p)) AS mae, 100 * avg(CASE WHEN abs(y) + abs(p) > 0 THEN abs(y - p) / ((abs(y) + abs(p)) / 2) END) AS smape, count(*) AS n_scored FROM pred GROUP BY ALL),
scores AS (SELECT r.*, r.mae / nullif(insample, 0) AS mase, r.mae / nullif(n.mae, 0) AS relative_mae FROM raw r JOIN ins USING (fold) JOIN (SELECT fold, mae FROM raw WHERE model = 'seasonal_naive') n USING (fold))"""

_WALK = f"""{_DPS},
months AS (SELECT DISTINCT CAST(date_trunc('month', date) AS DATE) AS month FROM dps WHERE date_trunc('month', date) >= (SELECT date_trunc('month', min(date)) FROM dps) + INTERVAL 36 MONTH),
past AS (SELECT month, dps.* FROM months JOIN dps ON date < month AND date >= month - INTERVAL 36 MONTH),
{_detector("past", "target", "d", "month, series_id", "month")},
{_cut_each("d", RATES, "cut", "month")},
cur AS (SELECT CAST(date_trunc('month', date) AS DATE) AS month, * FROM dps),
{_expected("cur", "month, series_id", "d", "cur1")},
rec AS (SELECT c.*, (ridership - expected - center) / scale AS z, rate, z_cutoff, cusum_cutoff FROM cur1 c JOIN d_p USING (month, series_id) JOIN cut USING (month)),
{_restart("rec", "month, series_id, rate", "cusum_cutoff", "cs")},
truth AS (SELECT series_id, date, CASE WHEN status = 'closed' THEN 1 WHEN status = 'operating' AND ridership = 0 THEN 1 WHEN status = 'operating' THEN 0 END AS label FROM dps),
flags AS (SELECT rec.month, series_id, rate, date, rec.z_cutoff, coalesce(z <= -z_cutoff, false) OR coalesce(cs.cusum <= -rec.cusum_cutoff, false) AS is_anomaly, label FROM rec JOIN cs USING (month, series_id, rate, date) JOIN truth USING (series_id, date)),
conf AS (SELECT rate, count(label) AS n_days_scored, count(*) FILTER (label = 1) AS n_positive_days, count(*) FILTER (is_anomaly AND label = 1) AS true_positives, count(*) FILTER (is_anomaly AND label = 0) AS false_positives, count(*) FILTER (NOT is_anomaly AND label = 1) AS false_negatives FROM flags GROUP BY rate),
day AS (SELECT *, true_positives / nullif(true_positives + false_positives, 0) AS precision, true_positives / nullif(true_positives + false_negatives, 0) AS recall FROM conf),
ev0 AS (SELECT *, coalesce(label = 1, false) AS hit, CASE WHEN coalesce(label = 1, false) IS DISTINCT FROM lag(coalesce(label = 1, false)) OVER (PARTITION BY rate, series_id ORDER BY date) THEN 1 ELSE 0 END AS turn FROM flags),
ev1 AS (SELECT *, sum(turn) OVER (PARTITION BY rate, series_id ORDER BY date) AS island FROM ev0),
ev2 AS (SELECT *, row_number() OVER (PARTITION BY rate, series_id, island ORDER BY date) AS pos FROM ev1 WHERE hit),
onset AS (SELECT rate, series_id, min(date) AS start, max(date) AS "end", count(*) AS days, bool_or(is_anomaly AND pos <= 3) AS detected FROM ev2 GROUP BY rate, series_id, island)"""

_EASTER = """e0 AS (SELECT DISTINCT year(date) AS y FROM days), e1 AS (SELECT y, y % 19 AS a, y // 100 AS b, y % 100 AS c FROM e0),
e2 AS (SELECT *, (19 * a + b - b // 4 - (b - (b + 8) // 25 + 1) // 3 + 15) % 30 AS h FROM e1),
e3 AS (SELECT *, (32 + 2 * (b % 4) + 2 * (c // 4) - h - c % 4) % 7 AS l FROM e2),
e4 AS (SELECT *, h + l - 7 * ((a + 11 * h + 22 * l) // 451) + 114 AS s FROM e3),
easter AS (SELECT y, make_date(y, s // 31, s % 31 + 1) AS sunday FROM e4)"""


def _monday(month: int, n: int) -> str:
    """The n-th Monday of a month: the one among its days 7n-6 to 7n."""
    return f"(month(date) = {month} AND isodow(date) = 1 AND day(date) BETWEEN {7 * n - 6} AND {7 * n})"


_HOLIDAY = f"""CASE WHEN month(date) = 1 AND day(date) = 1 THEN 'Año Nuevo'
  WHEN CASE WHEN year(date) >= 2006 THEN {_monday(2, 1)} ELSE month(date) = 2 AND day(date) = 5 END THEN 'Día de la Constitución'
  WHEN CASE WHEN year(date) >= 2007 THEN {_monday(3, 3)} ELSE month(date) = 3 AND day(date) = 21 END THEN 'Natalicio de Benito Juárez'
  WHEN month(date) = 5 AND day(date) = 1 THEN 'Día del Trabajo' WHEN month(date) = 9 AND day(date) = 16 THEN 'Día de la Independencia'
  WHEN CASE WHEN year(date) >= 2006 THEN {_monday(11, 3)} ELSE month(date) = 11 AND day(date) = 20 END THEN 'Día de la Revolución'
  WHEN year(date) % 6 = 2 AND CASE WHEN year(date) >= 2024 THEN month(date) = 10 AND day(date) = 1 ELSE month(date) = 12 AND day(date) = 1 END THEN 'Transmisión del Poder Ejecutivo Federal'
  WHEN month(date) = 12 AND day(date) = 25 THEN 'Navidad' ELSE '' END"""

_SUPER = _DP + """,
f0 AS (SELECT *, row_number() OVER s - 1 AS pos, count(*) OVER (PARTITION BY series_id) AS days,
  value AS lag_0, lag(value, 6) OVER s AS lag_6, lag(value, 363) OVER s AS lag_363,
  CASE WHEN count(value) OVER w28 >= 7 THEN quantile_cont(value, 0.5) OVER w28 END AS median_28
  FROM dp WINDOW s AS (PARTITION BY series_id ORDER BY date), w28 AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN 27 PRECEDING AND CURRENT ROW)),
f1 AS (SELECT o.*, h AS horizon, CAST(o.date + CAST(h AS INTEGER) AS DATE) AS target_date, wd.value AS same_weekday, t.value AS target
  FROM f0 o CROSS JOIN (SELECT unnest(range(1, 15)) AS h) LEFT JOIN dp t ON t.series_id = o.series_id AND t.date = o.date + CAST(h AS INTEGER)
  LEFT JOIN dp wd ON wd.series_id = o.series_id AND wd.date = o.date + CAST(h - 7 * CAST(ceil(h / 7.0) AS INTEGER) AS INTEGER))"""

_FEATURES = f"""SELECT series_id, origin, date, horizon, lag_0, lag_6, lag_363, median_28, same_weekday, ({_HOLIDAY}) <> '' AS is_holiday, day(date) = 15 OR date = last_day(date) AS is_payday,
  CAST(CASE WHEN ({_HOLIDAY}) <> '' OR (month(date) = 12 AND day(date) >= 24) OR (month(date) = 1 AND day(date) = 1) THEN 6 ELSE isodow(date) - 1 END AS BIGINT) AS effective_day_of_week"""

_STANDARD = _DP + ",\nstd AS (SELECT *, (value - avg(value) OVER w) / stddev_samp(value) OVER w AS z, 4.0 AS lim FROM dp WINDOW w AS (PARTITION BY series_id))"


def _w(ctes: str, select: str) -> str:
    return f"WITH RECURSIVE {ctes.strip()}\n{select}"


_TEXT = r"trim(regexp_replace(lower(strip_accents(text)), '\s+', ' ', 'g'))"
_KEY = rf"regexp_replace({_TEXT}, ' ?/ ?', '/', 'g')"

_EP = """ep AS (SELECT CAST(ts AS DATE) AS date, event_type AS line_id, CAST(user_id AS VARCHAR) AS station_id, value, count(*) OVER (PARTITION BY CAST(ts AS DATE), event_type, user_id) AS copies FROM events)"""
_EPS = _EP + f""",
ep_days AS ({_DAYS.format("ep")}),
epp AS (SELECT p.line_id || ':' || p.station_id AS series_id, p.line_id, p.station_id, d.date, e.value AS ridership FROM (SELECT DISTINCT line_id, station_id FROM ep WHERE copies = 1) p CROSS JOIN ep_days d
  LEFT JOIN (SELECT * FROM ep WHERE copies = 1) e ON e.line_id = p.line_id AND e.station_id = p.station_id AND e.date = d.date),
""" + _status("epp", "eps")

_ROLL = ", ".join(f"round(CASE WHEN count(value) OVER w{n} >= {m} THEN avg(value) OVER w{n} END, 4) AS mean_{n}, round(CASE WHEN count(value) OVER w{n} >= {m} THEN quantile_cont(value, 0.5) OVER w{n} END, 4) AS median_{n}" for n, m in ((7, 3), (28, 7), (91, 22)))
_ROLL_W = ", ".join(f"w{n} AS (PARTITION BY series_id ORDER BY date ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)" for n in (7, 28, 91))

ORACLE_SQL: dict[str, str] = {
    "panel_densify": _w(_SP, "SELECT series_id, date, ridership FROM sp"),
    "panel_series_count": _w(_DP, "SELECT series_id, count(*) AS n_days, min(date) AS first_date, max(date) AS last_date, sum(value) AS total FROM dp GROUP BY 1"),
    "panel_rectangular": _w(_EPS, "SELECT date, line_id, station_id, 'user ' || station_id AS station_name, ridership, status, CASE WHEN status = 'operating' THEN ridership END AS target FROM eps"),
    "panel_wide_month": _w(_DP, "SELECT CAST(date_trunc('month', date) AS DATE) AS month, sum(value) FILTER (line_id = 'F') AS f_total, sum(value) FILTER (line_id = 'O') AS o_total FROM dp GROUP BY 1"),
    "runs_zero": _w(_SP + ",\n" + _islands("sp", "(ridership = 0)", "i"), 'SELECT series_id, min(date) AS start, max(date) AS "end", count(*) AS days FROM i WHERE flag GROUP BY series_id, island'),
    "status_daily": _w(_SPS, "SELECT series_id, date, status, CASE WHEN status = 'operating' THEN ridership END AS target FROM sps"),
    "status_summary": _w(_SPS, "SELECT status, count(*) AS n_rows, round(count(*) / (SELECT count(*) FROM sps), 4) AS share FROM sps GROUP BY 1"),
    "outage_dates": _w(_SPS, "SELECT date FROM sps_out"),
    "interruptions": _w(_SPS + ",\n" + _islands("sps", "status", "i"), "SELECT line_id, station_id, status, min(date) AS start, max(date) AS \"end\", count(*) AS days FROM i WHERE status IN ('closed', 'not_yet_open', 'not_measured') GROUP BY line_id, station_id, status, island"),
    "network_events": _w(_SPS + ",\n" + _islands("sps", "status", "i") + ",\nint AS (SELECT line_id, station_id, status, min(date) AS start, max(date) AS fin, count(*) AS days FROM i WHERE status IN ('closed', 'not_yet_open', 'not_measured') GROUP BY line_id, station_id, status, island)", "SELECT line_id, status, start, fin AS \"end\", days, count(DISTINCT station_id) AS n_stations, string_agg(DISTINCT station_id, '|' ORDER BY station_id) AS stations FROM int WHERE days >= 7 GROUP BY ALL"),
    "duplicate_keys": _w(_EP, "SELECT date, line_id, station_id, count(*) AS copies FROM ep WHERE copies > 1 GROUP BY ALL"),
    "duplicate_report": _w(_EP, "SELECT count(*) AS n_rows, count(DISTINCT date) AS n_dates, length(string_agg(DISTINCT station_id, '|')) AS stations_chars, min(date) AS first_date, max(date) AS last_date FROM ep WHERE copies > 1"),
    "registry": """WITH r AS (SELECT CAST(o_orderdate AS DATE) AS date, o_orderpriority AS line_id, o_orderstatus AS station_id, c_mktsegment AS name, c_name FROM orders JOIN customer ON o_custkey = c_custkey),
n AS (SELECT line_id, station_id, name, row_number() OVER (PARTITION BY line_id, station_id ORDER BY count(*) DESC, name) AS k FROM r GROUP BY line_id, station_id, name)
SELECT r.line_id, r.station_id, any_value(n.name) AS station_name, min(date) AS first_date, max(date) AS last_date, count(DISTINCT date) AS n_days, count(DISTINCT c_name) AS n_raw_labels FROM r JOIN n ON n.line_id = r.line_id AND n.station_id = r.station_id AND k = 1 GROUP BY 1, 2""",
    "contract_report": """WITH y AS (SELECT year(l_shipdate) AS y, count(*) AS n FROM lineitem GROUP BY 1)
SELECT count(*) AS n_rows, CAST(min(l_shipdate) AS DATE) AS date_min, CAST(max(l_shipdate) AS DATE) AS date_max, count(DISTINCT l_linestatus) AS n_raw_line_labels, count(DISTINCT l_returnflag) AS n_raw_station_labels, count(*) FILTER (l_quantity = 0) AS n_zero_rows, count(*) FILTER (l_quantity = 0) / count(*) AS zero_share,
  (SELECT '[' || string_agg('{"y":' || y || ',"n":' || n || '}', ',' ORDER BY y) || ']' FROM y) AS per_year FROM lineitem""",
    "contract_validate": "SELECT t.*, y.* FROM (SELECT count(*) AS n_rows, CAST(min(o_orderdate) AS DATE) AS date_min, CAST(max(o_orderdate) AS DATE) AS date_max, count(DISTINCT o_orderpriority) AS n_lines, count(DISTINCT o_orderstatus) AS n_stations, count(*) FILTER (o_custkey = 0) AS n_zero_rows FROM orders) t, (SELECT year(o_orderdate) AS year, count(*) AS rows_of_year FROM orders GROUP BY 1) y",
    "network_shape": "SELECT count(DISTINCT o_orderpriority) AS n_lines, count(DISTINCT o_orderstatus) AS n_stations, count(DISTINCT o_orderpriority || ':' || o_orderstatus) AS n_pairs FROM orders",
    "text_strip_accents": "SELECT doc_id, md5(strip_accents(text)) AS plain_md5 FROM documents",
    "text_normalize_key": f"SELECT doc_id, md5({_KEY}) AS key_md5 FROM documents",
    "text_slug": f"SELECT doc_id, md5(trim(regexp_replace({_KEY}, '[^a-z0-9]+', '-', 'g'), '-')) AS slug_md5 FROM documents",
    "text_mojibake_roundtrip": "SELECT doc_id, md5(text) AS text_md5, true AS restored FROM documents",
    "line_code": "SELECT DISTINCT o_orderpriority AS label, regexp_extract(o_orderpriority, '^\\d+') AS line_code, regexp_extract(o_orderpriority, '^\\d+') AS line_id, CAST(regexp_extract(o_orderpriority, '^\\d+') AS BIGINT) AS line_rank FROM orders",
    "series_id_split": "SELECT DISTINCT o_orderpriority || ':' || o_orderstatus AS series_id, o_orderpriority AS line_id, o_orderstatus AS station_id FROM orders",
    "calendar_features": _w(
        _SP + ",\ndays AS (SELECT date FROM sp_days),\n" + _EASTER,
        f"""SELECT date, isodow(date) - 1 AS day_of_week, day(date) AS day_of_month, month(date) AS month, year(date) AS year, week(date) AS week_of_year, isodow(date) >= 6 AS is_weekend, ({_HOLIDAY}) <> '' AS is_holiday, {_HOLIDAY} AS holiday_name,
  day(date) = 15 OR date = last_day(date) AS is_payday, day(date) = 16 OR day(date) = 1 AS is_day_after_payday, date BETWEEN sunday - 7 AND sunday AS is_holy_week,
  (month(date) = 12 AND day(date) >= 24) OR (month(date) = 1 AND day(date) = 1) AS is_year_end_break,
  CASE WHEN ({_HOLIDAY}) <> '' OR (month(date) = 12 AND day(date) >= 24) OR (month(date) = 1 AND day(date) = 1) THEN 6 ELSE isodow(date) - 1 END AS effective_day_of_week
FROM days JOIN easter ON y = year(date)""",
    ),
    "rolling_7_28_91": _w(_DP, f"SELECT series_id, date, {_ROLL}, round(CASE WHEN count(value) OVER w7 >= 3 THEN stddev_samp(value) OVER w7 END, 4) AS std_7 FROM dp WINDOW {_ROLL_W}"),
    "rolling_level_56": _w(_DP + ",\n" + _seasonal("dp", "series_id", "value", "s"), "SELECT series_id, date, round(level_at, 4) AS level_at FROM s_l"),
    "lags_leads": _w(_DP, "SELECT series_id, date, value AS lag_0, " + ", ".join(f"lag(value, {k}) OVER w AS lag_{k}" for k in (1, 2, 6, 13, 20, 27, 363)) + ", lead(value, 14) OVER w AS lead_14 FROM dp WINDOW w AS (PARTITION BY series_id ORDER BY date)"),
    "same_weekday_lag": _w(_SUPER, "SELECT series_id, date AS origin, horizon, same_weekday FROM f1 WHERE horizon IN (1, 6, 7, 8, 14) AND pos >= 363 AND pos < days - 14"),
    "supervised_frame": _w(_SUPER + ",\nf2 AS (SELECT * EXCLUDE (date), date AS origin, target_date AS date FROM f1 WHERE pos >= 363 AND pos < days - 14)", _FEATURES + ", target FROM f2"),
    "prediction_frame": _w(_SUPER + ",\nf2 AS (SELECT * EXCLUDE (date), date AS origin, target_date AS date FROM f1 WHERE pos = days - 1)", _FEATURES + " FROM f2"),
    "naive_phase_table": _w(_DP, "SELECT series_id, isodow(date) - 1 AS day_of_week, arg_max(value, date) AS value FROM dp WHERE date > (SELECT max(date) FROM dp) - 56 GROUP BY 1, 2"),
    "naive_forecast": _w(_DP + ",\nl AS (SELECT max(date) AS last FROM dp)", "SELECT f.series_id, CAST(last + CAST(h AS INTEGER) AS DATE) AS date, h AS horizon, f.value AS prediction FROM l CROSS JOIN (SELECT unnest(range(1, 15)) AS h) JOIN dp f ON f.date = last + CAST(h - 7 * CAST(ceil(h / 7.0) AS INTEGER) AS INTEGER)"),
    "weekday_factor": _w(_DP + ",\n" + _seasonal("dp", "series_id", "value", "s"), "SELECT series_id, dow AS day_of_week, round(wf, 6) AS factor FROM s_w"),
    "month_factor": _w(_DP + ",\n" + _seasonal("dp", "series_id", "value", "s"), "SELECT series_id, mon AS month, round(mf, 6) AS factor FROM s_m"),
    "current_level": _w(_DP + ",\n" + _seasonal("dp", "series_id", "value", "s"), "SELECT series_id, last_date, round(level, 4) AS level FROM s_c"),
    "expected_demand": _w(_DP + ",\n" + _seasonal("dp", "series_id", "value", "s") + ",\n" + _expected("dp", "series_id", "s", "x"), "SELECT series_id, date, round(expected, 4) AS expected FROM x"),
    "seasonal_forecast": _w(_DP + ",\n" + _seasonal("dp", "series_id", "value", "s") + ",\nfut AS (SELECT series_id, CAST(last_date + CAST(h AS INTEGER) AS DATE) AS date, h AS horizon FROM s_c CROSS JOIN (SELECT unnest(range(1, 15)) AS h)),\n" + _expected("fut", "series_id", "s", "x"), "SELECT series_id, date, horizon, round(expected, 4) AS prediction FROM x"),
    "mad_by_series": _w(_DP, "SELECT series_id, round(mad(value), 4) AS mad FROM dp GROUP BY 1"),
    "mad_scale": _w(_DP + ",\n" + _detector("dp", "value", "d"), "SELECT series_id, round(center, 4) AS center, round(scale, 4) AS scale FROM d_p"),
    "zscore": _w(_DP + ",\n" + _detector("dp", "value", "d"), "SELECT series_id, date, round(z, 4) AS z FROM d_z"),
    "cutoffs": _w(_DP + ",\n" + _detector("dp", "value", "d") + ",\n" + _cut_each("d", RATES, "cut"), "SELECT rate, round(z_cutoff, 4) AS z_cutoff, round(cusum_cutoff, 4) AS cusum_cutoff FROM cut"),
    "cusum_plain": _w(
        _STANDARD + """,
n AS (SELECT series_id, date, z, row_number() OVER (PARTITION BY series_id ORDER BY date) AS n FROM std),
c AS (SELECT series_id, date, n, least(0.0, coalesce(z + 0.5, 0)) AS cusum FROM n WHERE n = 1 UNION ALL SELECT c.series_id, n.date, n.n, least(0.0, c.cusum + coalesce(n.z + 0.5, 0)) FROM c JOIN n ON n.series_id = c.series_id AND n.n = c.n + 1)""",
        "SELECT series_id, date, round(cusum, 4) AS cusum FROM c",
    ),
    "cusum_restart": _w(_STANDARD + ",\n" + _restart("std", "series_id", "lim", "cs"), "SELECT series_id, date, round(cusum, 4) AS cusum FROM cs"),
    "cusum_restart_month": _w(_STANDARD + ",\nstm AS (SELECT *, date_trunc('month', date) AS month FROM std),\n" + _restart("stm", "series_id, month", "lim", "cs"), "SELECT series_id, date, round(cusum, 4) AS cusum FROM cs"),
    "anomaly_flags": _w(_flagged(["0.01"]), "SELECT series_id, date, ridership, round(expected, 4) AS expected, round(z, 4) AS z, round(cusum, 4) AS cusum, extreme OR drifted AS is_anomaly FROM flags"),
    "anomaly_reasons": _w(_flagged(["0.01"]), "SELECT series_id, date, CASE WHEN extreme THEN 'extreme day' ELSE 'sustained shortfall' END AS reason FROM flags WHERE extreme OR drifted"),
    "line_incidents": _w(_flagged(["0.01"]), "SELECT date, line_id, count(*) FILTER (extreme OR drifted) AS n_flagged FROM flags GROUP BY 1, 2 HAVING count(*) FILTER (extreme OR drifted) >= 3"),
    "alarm_rate_curve": _w(_flagged(RATES), "SELECT rate, count(*) FILTER (extreme OR drifted) AS n_flags FROM flags GROUP BY 1"),
    "folds": _w(_FOLDS, "SELECT fold, train_start, train_end, test_start, test_end FROM folds"),
    "metric_insample": _w(_DP, "SELECT line_id, round(avg(abs(value - back)), 6) AS insample_mae FROM (SELECT line_id, value, lag(value, 7) OVER (PARTITION BY series_id ORDER BY date) AS back FROM dp) GROUP BY 1"),
    "backtest_fold_scores": _w(_BACKTEST, "SELECT fold, model, round(mae, 4) AS mae, round(smape, 4) AS smape, round(mase, 4) AS mase, round(relative_mae, 4) AS relative_mae, n_scored FROM scores"),
    "backtest_by_horizon": _w(_BACKTEST + ",\nhz AS (SELECT fold, horizon, model, avg(abs(y - p)) AS mae FROM pred GROUP BY ALL)", "SELECT h.fold, h.horizon, h.model, round(h.mae, 4) AS mae, round(h.mae / nullif(n.mae, 0), 4) AS relative_mae FROM hz h JOIN hz n ON n.fold = h.fold AND n.horizon = h.horizon AND n.model = 'seasonal_naive'"),
    "backtest_summary": _w(_BACKTEST, "SELECT model, round(avg(mae), 4) AS mae, round(avg(smape), 4) AS smape, round(avg(mase), 4) AS mase, round(avg(relative_mae), 4) AS relative_mae FROM scores GROUP BY 1"),
    "gate": _w(_BACKTEST, "SELECT round(avg(relative_mae), 4) AS mean_relative_mae, round(max(relative_mae), 4) AS worst, count(*) AS n_folds, coalesce(avg(relative_mae) <= 0.95, false) AS passed FROM scores WHERE model = 'hierarchical'"),
    "ground_truth": _w(_DPS, "SELECT series_id, date, status, CAST(CASE WHEN status = 'closed' THEN 1 WHEN status = 'operating' AND ridership = 0 THEN 1 WHEN status = 'operating' THEN 0 END AS BIGINT) AS label FROM dps"),
    "walk_forward_flags": _w(_WALK, "SELECT rate, month, count(*) AS n_rows, count(*) FILTER (is_anomaly) AS n_flags, round(any_value(z_cutoff), 4) AS z_cutoff FROM flags GROUP BY 1, 2"),
    "score_days": _w(_WALK, "SELECT rate, n_days_scored, n_positive_days, true_positives, false_positives, false_negatives, round(precision, 4) AS precision, round(recall, 4) AS recall, round(2 * precision * recall / nullif(precision + recall, 0), 4) AS f1 FROM day"),
    "event_onsets": _w(_WALK, 'SELECT rate, series_id, start, "end", days, detected FROM onset'),
    "operating_curve": _w(
        _WALK + """,
daily AS (SELECT rate, count(*) FILTER (is_anomaly) / count(DISTINCT date) AS alerts FROM flags GROUP BY 1),
share AS (SELECT rate, avg(detected::INT) AS a, avg(detected::INT) FILTER (days >= 4) AS b, avg(detected::INT) FILTER (days = 1) AS c FROM onset GROUP BY 1)""",
        "SELECT rate, round(alerts, 4) AS alerts_per_day, round(precision, 4) AS precision, round(recall, 4) AS day_recall, round(2 * precision * recall / nullif(precision + recall, 0), 4) AS f1, round(a, 4) AS onset_recall_all, round(b, 4) AS onset_recall_4d_plus, round(c, 4) AS onset_recall_1d FROM daily JOIN day USING (rate) LEFT JOIN share USING (rate)",
    ),
    "reconcile_full_outer": """WITH s AS (SELECT CAST(s_nationkey + 2 AS BIGINT) AS key, count(*) AS n_suppliers FROM supplier GROUP BY 1), n AS (SELECT CAST(n_nationkey AS BIGINT) AS key, n_name FROM nation)
SELECT key, n_name, n_suppliers, CASE WHEN n_name IS NULL THEN 'right_only' WHEN n_suppliers IS NULL THEN 'left_only' ELSE 'both' END AS side FROM n FULL JOIN s USING (key)""",
    "reconcile_left_only": "SELECT CAST(n_nationkey AS BIGINT) AS key, n_name FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey + 2 FROM supplier)",
    "alias_apply": "SELECT CAST(n_regionkey AS VARCHAR) AS line_id, CASE WHEN n_name = 'CHINA' THEN r_name ELSE n_name END AS station_id FROM nation JOIN region ON r_regionkey = n_regionkey",
    "stations_with_coords": "SELECT CAST(n_nationkey AS VARCHAR) AS series_id, CAST(n_regionkey AS VARCHAR) AS line_id, n_name AS station_id, lower(n_name) AS station_name, min(c_acctbal) AS longitude, max(c_acctbal) AS latitude FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1, 2, 3, 4",
    "kml_stations": "SELECT CAST(n_regionkey + 1 AS VARCHAR) AS line_id, regexp_replace(lower(n_name), '[^a-z0-9]+', '-', 'g') AS station_id, n_name AS station_name, CAST('-' || n_nationkey || '.5' AS DOUBLE) AS longitude, n_nationkey + 0.25::DOUBLE AS latitude FROM nation",
    "json_resources": "SELECT CAST(n_nationkey AS VARCHAR) AS id, n_name AS name, 'https://data.example/' || n_nationkey AS url, 'CSV' AS format, CASE WHEN n_nationkey > 9 THEN '2021-01-01' ELSE '2020-01-01' END AS last_modified FROM nation",
    "api_forecast_filter": _w(_DP + ",\nl AS (SELECT max(date) AS last FROM dp)", "SELECT f.series_id, CAST(last + CAST(h AS INTEGER) AS DATE) AS date, h AS horizon, f.value AS prediction FROM l CROSS JOIN (SELECT 7 AS h) JOIN dp f ON f.date = last + CAST(h - 7 AS INTEGER) WHERE f.line_id = 'O'"),
    "api_anomalies_latest": _w(_flagged(["0.01"]), "SELECT series_id, date, round(z, 4) AS score, CASE WHEN extreme THEN 'extreme day' ELSE 'sustained shortfall' END AS reason FROM flags WHERE extreme OR drifted"),
    "api_stations": "SELECT DISTINCT o_orderpriority AS line_id, o_orderstatus AS station_id, o_orderpriority || ':' || o_orderstatus AS series_id FROM orders WHERE o_orderpriority = '1-URGENT'",
    "long_forecast": _w(_DP + ",\n" + _seasonal("dp", "series_id", "value", "s") + ",\nfut AS (SELECT series_id, CAST(last_date + CAST(h AS INTEGER) AS DATE) AS date, h AS horizon FROM s_c CROSS JOIN (SELECT unnest(range(1, 15)) AS h)),\n" + _expected("fut", "series_id", "s", "x"), "SELECT date, horizon, series_id, split_part(series_id, ':', 1) AS line_id, split_part(series_id, ':', 2) AS station_id, 'station ' || split_part(series_id, ':', 2) AS station_name, CAST(round_even(expected, 0) AS BIGINT) AS prediction FROM x"),
}
