"""The driver contract: every query runs, and its SQL agrees, on the smallest tables."""

from __future__ import annotations

import datetime
from collections import Counter
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

from .conftest import SF


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["ad_id", "impressions", "clicked", "ctr"]
    assert df.count() > 0


def test_every_query_has_sql():
    assert set(entry.QUERIES) == set(entry.ORACLE)


@pytest.mark.parametrize("name", sorted(entry.QUERIES))
def test_query_matches_sql(spark, name):
    con = duckdb.connect()
    for file in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)

    def plain(v):
        return v.astimezone(datetime.timezone.utc).replace(tzinfo=None) if isinstance(v, datetime.datetime) and v.tzinfo else v

    got = Counter(tuple(plain(row[c]) for c in columns) for row in df.collect())
    result = con.execute(entry.oracle_sql()[name])
    order = [d[0] for d in result.description]
    want = Counter(tuple(row[order.index(c)] for c in columns) for row in result.fetchall())
    assert got == want
