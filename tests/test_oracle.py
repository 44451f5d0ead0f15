"""Every query with an SQL text gives the same rows in Spark and in DuckDB; the others run and give rows."""

from __future__ import annotations

import math

import pytest

from meterlake.plans import catalog
from tests.conftest import FOLDER

catalog.load_all()


def plain(value):
    return "nan" if isinstance(value, float) and math.isnan(value) else value


def sorted_rows(columns, rows):
    place = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(([plain(r[i]) for i in place] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.SQL_TEXT))
def test_same_rows(spark, duck, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    got = duck.execute(catalog.SQL_TEXT[name])
    columns = [d[0] for d in got.description]
    assert sorted(columns) == sorted(df.columns)
    assert sorted_rows(df.columns, df.collect()) == sorted_rows(columns, got.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL_TEXT)))
def test_runs(spark, name):
    df = catalog.QUERIES[name](spark, FOLDER)
    rows = df.collect()
    assert rows or name in {"i13_changepoints", "l5_stream_changepoints", "i4_isotonic_calibration"}


def test_entry_names_exist():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
