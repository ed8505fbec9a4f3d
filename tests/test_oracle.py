"""Every query with comparison SQL, at the smallest scale, against DuckDB."""

from __future__ import annotations

import math

import duckdb
import pytest

import __spark_entry__ as entry
from gleaner.plans.inputs import TABLES

SF_DIR = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    shaped = [tuple("nan" if isinstance(r[i], float) and math.isnan(r[i]) else r[i] for i in order) for r in rows]
    return sorted(cols), sorted(shaped, key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = entry.queries()[name](spark, SF_DIR)
    cursor = duck.execute(ORACLES[name])
    expected = _rows([d[0] for d in cursor.description], cursor.fetchall())
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == expected


def test_flagship_runs(spark):
    assert entry.entry(spark).count() > 0


def test_oracles_belong_to_queries():
    assert set(ORACLES) <= set(entry.queries())
