"""Every registered query against its SQL on the smallest tables."""

import math
import os
from pathlib import Path

import duckdb
import pytest

from featlab import oracles, queries

DATA = Path(os.environ.get("FEATLAB_DATA", "/root/testdata/sf0.001"))
pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return c


def canon(frame):
    frame = frame[sorted(frame.columns)]

    def cell(v):
        if v is None or (isinstance(v, float) and math.isnan(v)):
            return None
        return round(float(v), 5) + 0.0 if isinstance(v, float) else str(v)

    return sorted((tuple(cell(v) for v in row) for row in frame.astype(object).itertuples(index=False)), key=str)


@pytest.mark.parametrize("name", sorted(oracles.ORACLES))
def test_equals_sql(spark, con, name):
    got, want = queries.QUERIES[name](spark, str(DATA)).toPandas(), con.sql(oracles.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert canon(got) == canon(want)


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(oracles.ORACLES)))
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, str(DATA)).count() > 0


def test_entry_module(spark):
    import __spark_entry__ as e

    assert set(queries.QUERIES) <= set(e.queries()) and set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 10
