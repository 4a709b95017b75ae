import os
import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent
SF = "/root/testdata/sf0.001"
QUICK = ["panel_densify", "runs_zero", "status_summary", "network_events", "duplicate_report", "registry", "contract_report", "text_normalize_key", "calendar_features", "rolling_level_56", "lags_leads", "naive_forecast", "weekday_factor", "cusum_restart_month", "folds", "ground_truth", "reconcile_full_outer", "reconcile_left_only", "stations_with_coords", "kml_stations", "json_resources", "contract_validate", "network_shape", "panel_wide_month", "api_stations", "long_forecast", "event_onsets"]


def rows_of(frame):
    import numpy as np
    import pandas as pd

    out = []
    for row in frame[sorted(frame.columns)].itertuples(index=False):
        out.append(tuple(None if pd.isna(v) else str(v)[:10] if hasattr(v, "year") else round(float(v), 3) if isinstance(v, (int, float, np.number)) and not isinstance(v, (bool, np.bool_)) else str(v) for v in row))
    return sorted(out, key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables aren't here")
@pytest.mark.parametrize("name", QUICK)
def test_query_equals_its_oracle(spark, name):
    import duckdb

    from tramline import oracles, queries

    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents pages".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want, got = con.execute(oracles.ORACLE_SQL[name]).df(), queries.QUERIES[name](spark, SF).toPandas()
    assert sorted(want.columns) == sorted(got.columns)
    assert rows_of(got) == rows_of(want)


def test_every_query_but_the_learned_one_has_an_oracle():
    from tramline import oracles, queries

    assert set(queries.QUERIES) - set(oracles.ORACLE_SQL) == {"gbt_forecast"}


@pytest.mark.parametrize("pipeline", [True, False])
def test_entry_works_without_the_optional_parts(tmp_path, pipeline):
    """The entry point imports where the optional folders aren't there, with the pipeline's file and without it."""
    for p in ROOT.iterdir():
        if p.name not in ("tramline", "tests", ".git") and (pipeline or p.name != "corpus_pipeline.py"):
            (tmp_path / p.name).symlink_to(p)
    (tmp_path / "tramline").mkdir()
    for p in (ROOT / "tramline").iterdir():
        if p.name != "llm":
            (tmp_path / "tramline" / p.name).symlink_to(p)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'status_daily' in q and not any(n[:2] == 'op' and n[2].isdigit() or n == 'pipeline' for n in q); assert e.oracle_sql()"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env=env, check=True)


@pytest.mark.skipif(not os.path.isdir(SF), reason="sample tables aren't here")
def test_joins_with_references_read_whole_tables(spark):
    from tramline import queries

    rows = queries.QUERIES["reconcile_full_outer"](spark, SF).collect()
    assert sum(r.n_suppliers or 0 for r in rows) == spark.read.parquet(f"{SF}/supplier.parquet").count()
    homes = {r[0] for r in spark.read.parquet(f"{SF}/customer.parquet").select("c_nationkey").distinct().collect()}
    stations = queries.QUERIES["stations_with_coords"](spark, SF).collect()
    assert {int(r.series_id) for r in stations if r.longitude is not None} == homes & {int(r.series_id) for r in stations}
