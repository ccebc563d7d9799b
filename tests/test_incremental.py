"""Daily counts by deltas against one pass, and pages over sorted files against pages over the whole table."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from clickloom.operators import incremental, paging
from clickloom.sources import sorted_files

from .conftest import rows

START = dt.datetime(2026, 9, 1)
NTZ = "TIMESTAMP_NTZ"
COLUMNS = ("day", "ad_id", "impressions", "clicked_impressions")


def made(spark, late, seed=3, n=250):
    """Impressions and clicks that arrive up to ``late`` hours after they occur."""
    rng = random.Random(seed)
    shown, acted = [], []
    for k in range(n):
        at = START + dt.timedelta(minutes=rng.randrange(6 * 24 * 60))
        shown.append((f"i{k}", f"a{rng.randrange(4)}", at, at + dt.timedelta(minutes=rng.randrange(60 * late + 1))))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            click = at + dt.timedelta(minutes=rng.choice([-5, 0, 30, 600, 1439, 1440, 2000]))
            acted.append((f"i{k}" if rng.random() < 0.9 else "nobody", click, click + dt.timedelta(minutes=rng.randrange(60 * late + 1))))
    return (
        spark.createDataFrame(shown, f"id STRING, ad_id STRING, occurred_at {NTZ}, received_at {NTZ}"),
        spark.createDataFrame(acted, f"impression_id STRING, occurred_at {NTZ}, received_at {NTZ}"),
    )


@pytest.mark.parametrize(("late", "lateness"), [(1, 1), (80, None)])
def test_merged_days_equal_one_pass(spark, late, lateness):
    shown, acted = (df.persist() for df in made(spark, late))
    cuts = [START - dt.timedelta(days=1), *(START + dt.timedelta(days=d, hours=d % 3) for d in (1, 2, 3, 4, 5, 8, 12))]
    counts = spark.createDataFrame([], "day date, ad_id string, impressions long, clicked_impressions long")
    flips = 0
    for since, until in zip(cuts, cuts[1:]):
        delta = incremental.daily_delta(shown, acted, since, until, lateness_hours=lateness)
        flips += sum(r["clicked_impressions"] > r["impressions"] for r in delta.collect())
        counts = spark.createDataFrame(incremental.add_counts(counts, delta).collect(), counts.schema)
        assert rows(counts, *COLUMNS) == rows(incremental.daily_counts_as_of(shown, acted, until), *COLUMNS), until
    # Late clicks turned labels of days that were counted before.
    assert (flips > 0) == (lateness is None)


def test_a_retraction_is_a_negative_delta(spark):
    shown, acted = made(spark, 30)
    until = START + dt.timedelta(days=9)
    gone, stay = shown.where("ad_id = 'a1' OR id < 'i12'"), shown.where("NOT (ad_id = 'a1' OR id < 'i12')")
    minus = incremental.retraction(gone, acted, until)
    assert all(r["impressions"] < 0 for r in minus.collect())
    left = incremental.add_counts(incremental.daily_counts_as_of(shown, acted, until), minus)
    assert rows(left, *COLUMNS) == rows(incremental.daily_counts_as_of(stay, acted, until), *COLUMNS)


def test_nothing_arrived(spark):
    shown, acted = made(spark, 1, n=20)
    late = START + dt.timedelta(days=40)
    assert rows(incremental.daily_delta(shown, acted, late, late + dt.timedelta(days=1))) == []
    none = incremental.daily_delta(shown.limit(0), acted.limit(0), START, late)
    assert rows(none) == []


def table(spark, n):
    return spark.range(n).select(F.format_string("k%05d", F.pmod(F.col("id") * 7919, F.lit(n))).alias("key"), "id")


def test_pages_over_sorted_files(spark, tmp_path):
    df = table(spark, 500)
    sorted_files.write_sorted(df, "key", f"{tmp_path}/t", file_rows=60)
    sorted_files.check_manifest(spark, f"{tmp_path}/t")
    after, seen = None, []
    while True:
        got = sorted_files.page(spark, f"{tmp_path}/t", "key", after, 100)
        assert len(set(got.inputFiles())) <= 4
        found = got.orderBy("key").collect()
        assert found == paging.keyset_page(df, "key", after, 100).orderBy("key").collect()
        seen += [r["key"] for r in found]
        after = found[0]["next_after"]
        if after is None:
            break
    assert seen == sorted(r["key"] for r in df.collect())
    assert len(set(spark.read.parquet(f"{tmp_path}/t/rows").inputFiles())) >= 6


def test_pages_larger_than_files_and_beyond_the_end(spark, tmp_path):
    df = table(spark, 300)
    sorted_files.write_sorted(df, "key", f"{tmp_path}/t", file_rows=10)
    for after, size in ((None, 250), ("k00290", 50), ("z", 5)):
        assert rows(sorted_files.page(spark, f"{tmp_path}/t", "key", after, size)) == rows(paging.keyset_page(df, "key", after, size))


def test_empty_tables_and_null_keys(spark, tmp_path):
    sorted_files.write_sorted(table(spark, 10).limit(0), "key", f"{tmp_path}/t")
    assert rows(sorted_files.page(spark, f"{tmp_path}/t", "key")) == []
    with pytest.raises(Exception, match="without key"):
        sorted_files.write_sorted(spark.createDataFrame([("a",), (None,)], "key string"), "key", f"{tmp_path}/u")
    with pytest.raises(ValueError):
        sorted_files.page(spark, f"{tmp_path}/t", "key", None, 5001)
