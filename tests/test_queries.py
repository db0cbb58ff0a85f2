import glob
import os
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as e
from tidemark.plans import queries as engine
from tidemark.streaming import queries as streams

ROOT = Path(__file__).resolve().parent.parent
AT = "/root/testdata/sf0.001"
ALL = engine.QUERIES | streams.QUERIES
SQL = engine.ORACLE_SQL | streams.ORACLE_SQL


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{AT}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def rows(frame, columns):
    return sorted(map(repr, (tuple(r) for r in frame[columns].astype(object).astype(str).values.tolist())))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, con, name):
    got = ALL[name](spark, AT)
    columns = sorted(got.columns)
    want = con.execute(SQL[name]).fetchdf()
    assert sorted(want.columns) == columns
    assert rows(got.toPandas(), columns) == rows(want, columns)


def test_entry(spark):
    assert e.entry(spark).count() == 12


def test_registered_without_llm():
    code = "import sys; sys.modules['tidemark.llm'] = None; import __spark_entry__ as e; print(*e.queries())"
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True)
    assert out.stdout.split() == list(ALL)


def test_other_import_faults_show():
    code = "import sys; sys.modules['numpy'] = None; import __spark_entry__"
    assert "numpy" in subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True).stderr
