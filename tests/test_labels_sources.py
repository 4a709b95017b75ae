import io
import json
import zipfile
from datetime import date

import pytest
from pyspark.sql import functions as F

from tramline.config import NetworkShape
from tramline.errors import CanonicalizationError, CatalogError, ContractError, DownloadError, GeometryError, PanelError
from tramline.functions import text
from tramline.functions.calendar import calendar_columns, easter
from tramline.operators import canonical, contract
from tramline.plans.build import build_panel
from tramline.sources import catalog, geometry, ridership


def apply(spark, f, values):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r.o for r in df.select("i", f(F.col("s")).alias("o")).orderBy("i").collect()]


def test_mojibake(spark):
    words = ["Línea", "Niños Héroes", "plain", "", "price €", "Ã", "\x81é"]
    broken = [w.encode().decode("latin-1") for w in words]
    assert apply(spark, text.fix_mojibake, broken) == words
    assert apply(spark, text.fix_mojibake, words) == words
    assert apply(spark, text.fix_mojibake, [None]) == [None]


def test_keys_and_slugs(spark):
    same = ["Niños  Héroes / Poder", " ninos heroes/poder ", "NIÑOS HÉROES /PODER", "Niños Héroes/ Poder".encode().decode("latin-1")]
    assert len(set(apply(spark, text.normalize_key, same))) == 1
    assert apply(spark, text.slugify_station, ["Niños Héroes/Poder", "  -La Raza- ", "!!"]) == ["ninos-heroes-poder", "la-raza", ""]
    assert apply(spark, text.parse_line_id, ["Línea 1", "linea  12", "LÍNEA a", "Linea 123", "x"]) == ["1", "12", "A", "", ""]
    assert apply(spark, text.parse_line_code, ["01", " 12 ", "a", "00"]) == ["1", "12", "A", "00"]
    assert apply(spark, text.line_sort_rank, ["12", "A", "1"]) == [12, 165, 1]
    assert apply(spark, lambda c: text.split_series_id(c)[1], ["1:a:b", "1"]) == ["a:b", None]


@pytest.mark.parametrize(("day", "want"), [
    ("2024-02-29", dict(is_payday=True, is_holiday=False)),
    ("2024-03-01", dict(is_day_after_payday=True)),
    ("2024-03-31", dict(is_holy_week=True, effective_day_of_week=6, day_of_week=6)),
    ("2024-03-25", dict(is_holy_week=True, effective_day_of_week=0)),
    ("2024-03-18", dict(holiday_name="Natalicio de Benito Juárez", effective_day_of_week=6)),
    ("2024-10-01", dict(is_holiday=True)),
    ("2018-12-01", dict(is_holiday=True)),
    ("2019-12-01", dict(is_holiday=False)),
    ("1999-02-05", dict(is_holiday=True)),
    ("2010-02-05", dict(is_holiday=False)),
    ("2010-02-01", dict(is_holiday=True)),
    ("2023-12-24", dict(is_year_end_break=True, effective_day_of_week=6)),
    ("2024-01-01", dict(is_year_end_break=True, is_holiday=True, day_of_week=0, week_of_year=1)),
])
def test_calendar(spark, day, want):
    row = spark.sql(f"select date'{day}' as date").select(*(c.alias(n) for n, c in calendar_columns(F.col("date")).items())).first()
    assert {k: row[k] for k in want} == want


def test_easter(spark):
    days = spark.range(1990, 2051).select(F.make_date(F.col("id").cast("int"), F.lit(6), F.lit(1)).alias("d")).select(easter(F.col("d")).alias("e"))
    got = {r.e.year: r.e for r in days.collect()}
    assert got[2024] == date(2024, 3, 31) and got[2000] == date(2000, 4, 23) and got[2038] == date(2038, 4, 25)
    assert all(d.weekday() == 6 for d in got.values())


RAW = "fecha string, anio int, mes string, linea string, estacion string, afluencia bigint"


def raw(spark, change=None, n=12):
    rows = [[f"2024-01-{i + 1:02d}", 2024, "Enero", "Línea 1", "Balderas", 1000 + i] for i in range(n)]
    if change:
        change(rows)
    return spark.createDataFrame([tuple(r) for r in rows], RAW)


def test_contract(spark):
    report = contract.validate(raw(spark), min_rows=10)
    assert (report.n_rows, report.n_raw_line_labels, report.n_zero_rows, report.years) == (12, 1, 0, {2024: 12})
    assert report.zero_share == 0 and "12 rows" in report.summary()

    def put(column, value):
        def change(rows):
            rows[3][column] = value
        return change

    for change, words in [(put(0, None), "null"), (put(0, "2024-1-5"), "parsed"), (put(5, -1), "negative"), (put(1, 2023), "anio")]:
        with pytest.raises(ContractError, match=words):
            contract.validate(raw(spark, change), min_rows=10)
    with pytest.raises(ContractError, match="rows"):
        contract.validate(raw(spark))
    with pytest.raises(ContractError, match="columns"):
        contract.validate(raw(spark).drop("mes"), min_rows=1)
    with pytest.raises(ContractError, match="integer"):
        contract.validate(raw(spark).withColumn("afluencia", F.lit(1.5)), min_rows=1)


def test_canonical_registry_and_panel(spark):
    rows = [("2024-01-01", 2024, "E", "Línea 1", "Pino Suárez", 5), ("2024-01-01", 2024, "E", "LÃ\xadnea 2", "Pino SuÃ¡rez", 6), ("2024-01-02", 2024, "E", "linea 1", "pino suarez", 7), ("2024-01-03", 2024, "E", "Línea 1", "Pino Suárez", 0)]
    panel, registry = build_panel(spark.createDataFrame(rows, RAW), NetworkShape(2, 1, 2))
    reg = registry.collect()
    assert [(r.line_id, r.station_id, r.station_name, r.n_days, r.n_raw_labels) for r in reg] == [("1", "pino-suarez", "Pino Suárez", 3, 2), ("2", "pino-suarez", "Pino Suárez", 1, 1)]
    assert panel.count() == 6 and panel.filter("line_id = '2' and status = 'ambiguous_label'").count() == 2
    with pytest.raises(CanonicalizationError, match="n_lines"):
        canonical.assert_network(canonical.canonicalize(spark.createDataFrame(rows, RAW)), NetworkShape(3, 1, 2))
    with pytest.raises(CanonicalizationError):
        canonical.canonicalize(spark.createDataFrame([("2024-01-01", 2024, "E", "Ruta 1", "x", 5)], RAW))


def mark(name, line, x=-99.1, y=19.4):
    return f"<Placemark><td>NOMBRE</td> <td>{name}</td><td>LINEA</td>\n<td>{line}</td><coordinates> {x},{y},0</coordinates></Placemark>"


def archive(kml, member="x/STC_Metro_estaciones.kmz"):
    inner, outer = io.BytesIO(), io.BytesIO()
    with zipfile.ZipFile(inner, "w") as z:
        z.writestr("doc.kml", kml)
    with zipfile.ZipFile(outer, "w") as z:
        z.writestr(member, inner.getvalue())
    return outer.getvalue()


def test_geometry(spark, tmp_path):
    (tmp_path / "a.kmz").write_bytes(archive(mark("Niños Héroes", "03") + mark("Zapata", "12") + "<Placemark>nothing</Placemark>"))
    registry = spark.createDataFrame([("3", "ninos", "Niños"), ("12", "zapata", "Zapata")], "line_id string, station_id string, station_name string")
    (tmp_path / "alias.csv").write_text("source,line_id,alias_station_id,canonical_station_id,note\ngeometry,3,ninos-heroes,ninos,x\nother,12,zapata,z,x\n")
    aliases = geometry.load_aliases(spark, str(tmp_path / "alias.csv"), "geometry")
    out = {r.station_id: (r.longitude, r.latitude) for r in geometry.station_coordinates(spark, str(tmp_path / "a.kmz"), registry, aliases).collect()}
    assert out == {"ninos": (-99.1, 19.4), "zapata": (-99.1, 19.4)}
    assert geometry.load_aliases(spark, str(tmp_path / "none.csv"), "geometry").count() == 0
    for rows, words in [([("3", "ninos", -99.1, 19.4)], "zapata"), ([("3", "ninos", -99.1, 19.4), ("12", "zapata", -99.1, 19.4), ("9", "new", -99.1, 19.4)], "new"), ([("3", "ninos", 19.4, -99.1), ("12", "zapata", -99.1, 19.4)], "outside")]:
        with pytest.raises(GeometryError, match=words):
            canonical.reconcile(registry, spark.createDataFrame(rows, "line_id string, station_id string, longitude double, latitude double"))
    with pytest.raises(GeometryError):
        geometry.kml_of(archive("x", "other.kmz"))
    with pytest.raises(GeometryError):
        geometry.parse_stations(spark.createDataFrame([("<kml/>",)], "kml string"))


def test_catalogue(spark):
    body = json.dumps({"success": True, "result": {"resources": [{"id": "1", "name": "Afluencia  DIARIA", "url": "u", "format": "csv", "size": 5, "created": "2024"}, {"id": "2", "name": "otra", "url": "v", "format": "pdf", "last_modified": "2025"}]}})
    rows = catalog.list_resources(spark, catalog.fetch_package("d", "http://x", lambda url: body.encode()))
    found = catalog.resolve_resource(rows, "afluencia diaria")
    assert (found["id"], found["format"], found["last_modified"]) == ("1", "CSV", "2024")
    with pytest.raises(CatalogError, match="otra"):
        catalog.resolve_resource(rows, "missing")
    with pytest.raises(CatalogError):
        catalog.fetch_package("d", "http://x", lambda url: b'{"success": false}')


def test_download_and_ingest(spark, tmp_path):
    digest, size = ridership.save_stream([b"a,b\n", b"1,2\n"], str(tmp_path / "f.csv"), 8)
    assert len(digest) == 64 and size == 8
    with pytest.raises(DownloadError, match="web page"):
        ridership.save_stream([b"<!DOCTYPE html><html>"], str(tmp_path / "g.csv"))
    with pytest.raises(DownloadError, match="announced"):
        ridership.save_stream([b"x"], str(tmp_path / "g.csv"), 10 << 20)
    assert not (tmp_path / "g.csv").exists()
    csv = "fecha,anio,mes,linea,estacion,afluencia\n" + "".join(f"2024-01-{i:02d},2024,Enero,Línea 1,Zócalo,{i}\n" for i in range(1, 13))
    resource = {"id": "1", "url": "u", "last_modified": "2024-02", "size": len(csv.encode())}
    stream = lambda url: [csv.encode()]
    result, fresh = ridership.ingest(spark, resource, str(tmp_path / "i"), min_rows=10, stream=stream)
    assert fresh and result.report["n_rows"] == 12
    assert ridership.ingest(spark, resource, str(tmp_path / "i"), min_rows=10, stream=stream)[1] is False
    assert ridership.ingest(spark, resource | {"last_modified": "2024-03"}, str(tmp_path / "i"), min_rows=10, stream=stream)[1] is True
    found = ridership.file_digests(spark, str(tmp_path / "f.csv")).first()
    assert found.sha256 == digest and found.is_web_page is False
    with pytest.raises(PanelError):
        ridership.load_panel(spark, str(tmp_path / "nothing"))


def test_ingest_report_survives_its_sidecar(spark, tmp_path):
    csv = "fecha,anio,mes,linea,estacion,afluencia\n" + "".join(f"{y}-01-{i:02d},{y},Enero,Línea 1,Zócalo,{i - 1}\n" for y in (2023, 2024) for i in range(1, 7))
    resource = {"id": "1", "url": "u", "last_modified": "2024-02", "size": len(csv.encode())}
    new, fresh = ridership.ingest(spark, resource, str(tmp_path), min_rows=10, stream=lambda url: [csv.encode()])
    assert fresh and new.report == {"n_rows": 12, "date_min": "2023-01-01", "date_max": "2024-01-06", "n_raw_line_labels": 1, "n_raw_station_labels": 1, "n_zero_rows": 2, "rows_per_year": {"2023": 6, "2024": 6}}
    old, fresh = ridership.ingest(spark, resource, str(tmp_path), min_rows=10, stream=lambda url: [])
    assert not fresh and old == new
