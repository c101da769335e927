"""Every query that SQL can express against DuckDB, on the smallest tables; streams against tables."""

from __future__ import annotations

import os
import shutil
import subprocess
import sys

import duckdb
import pytest

from barline.plans import registry
from barline.streaming import bars as stream_bars

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no test tables here")


@pytest.fixture(scope="module")
def database():
    c = duckdb.connect()
    for t in ("lineitem", "part", "events"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def rows(df) -> list[list[str]]:
    df = df[sorted(df.columns)].astype(str).replace({"None": "-", "nan": "-", "<NA>": "-"})
    return sorted(df.values.tolist())


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_sql(spark, database, name):
    assert rows(registry.QUERIES[name](spark, SF).toPandas()) == rows(database.sql(registry.ORACLES[name]).df())
    spark.catalog.clearCache()


def test_a_stream_makes_the_bars_of_the_table(spark, tmp_path):
    os.makedirs(tmp_path / "events")
    shutil.copy(f"{SF}/events.parquet", tmp_path / "events/part.parquet")
    stream_bars.run_hourly(spark, str(tmp_path / "events"), str(tmp_path / "checkpoint"), "hours")
    streamed = {(r["hour"], r["ticker"]): (r["open"], r["close"], r["volume"]) for r in spark.table("hours").collect()}
    table = {(r["hour"], r["ticker"]): (r["open"], r["close"], r["volume"]) for r in stream_bars.hourly_bars(spark.read.parquet(f"{SF}/events.parquet")).collect()}
    assert streamed and all(table[k] == v for k, v in streamed.items()) and len(streamed) >= 0.95 * len(table)


def test_the_entry_works_without_the_training_data_subpackage(tmp_path):
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    for p in ("barline", "__spark_entry__.py"):
        (shutil.copytree if os.path.isdir(f"{root}/{p}") else shutil.copy)(f"{root}/{p}", tmp_path / p)
    shutil.rmtree(tmp_path / "barline/llm", ignore_errors=True)
    out = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries(), len(e.oracle_sql()))"], cwd=tmp_path, capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path)}, check=True)
    n, pipeline, sql = out.stdout.split()
    assert int(n) == len(registry.QUERIES) and pipeline == "False" and int(sql) == len(registry.ORACLES)
