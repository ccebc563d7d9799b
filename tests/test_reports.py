"""Golden rows of the cohort, lookup, window, as-of and scan operators."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from clickloom.operators import asof, attribution, experiments, lookup, search, windows
from clickloom.operators.quality import ContractError, multiset_equal
from clickloom.sources import tables

from . import fixtures as fx
from .conftest import rows

CTR = [("A1", 2, 1, 0.5), ("A2", 1, 1, 1.0), ("A3", 1, 0, 0.0)]


def test_ctr_counts_each_impression_once(spark):
    i, c = fx.impressions(spark), fx.clicks(spark)
    report = attribution.clicked_impression_ctr(i, c, day=fx.DAY, cutoff=fx.CUTOFF)
    assert rows(report, "ad_id", "impressions", "clicked", "ctr") == CTR
    text = attribution.clicked_impression_ctr_sql(i, c, day=fx.DAY, cutoff=fx.CUTOFF)
    assert rows(text, "ad_id", "impressions", "clicked", "ctr") == CTR


@pytest.mark.parametrize("n", [1, 3, 7])
def test_ctr_does_not_depend_on_partitions(spark, n):
    report = attribution.clicked_impression_ctr(
        fx.impressions(spark).repartition(n), fx.clicks(spark).repartition(n), day=fx.DAY, cutoff=fx.CUTOFF
    )
    assert rows(report, "ad_id", "impressions", "clicked", "ctr") == CTR


def test_lookup_keeps_facts(spark):
    facts = attribution.eligible_impressions(fx.impressions(spark), fx.DAY, fx.CUTOFF)
    expected = [("i1", "TECH", 100), ("i2", "TECH", 200), ("i3", "HOME", 300), ("i4", "UNKNOWN", 400)]
    for bound in (1000, 0):
        joined = lookup.lookup_join(facts, fx.lookup(spark), "ad_id", unknown={"category": "UNKNOWN"}, broadcast_rows=bound)
        assert rows(joined, "impression_id", "category", "cost_cents") == expected


def test_lookup_rejects_bad_keys(spark):
    facts, dim = fx.impressions(spark), fx.lookup(spark)
    doubled = dim.unionByName(dim.where("ad_id = 'A1'"))
    null = dim.unionByName(tables.typed_rows(spark, "ad_id STRING, category STRING", [(None, "BROKEN")]))
    for bad in (doubled, null):
        for join in (lookup.lookup_join, lookup.salted_lookup_join):
            with pytest.raises(ContractError):
                join(facts, bad, "ad_id")


def test_top_three(spark):
    assert rows(windows.top_ads_per_category(fx.ranking(spark)), "category", "ad_id", "rank") == [
        ("HOME", "A6", 1), ("TECH", "A1", 1), ("TECH", "A2", 2), ("TECH", "A3", 3)
    ]


def test_latest_version_then_tombstone(spark):
    assert rows(windows.latest_versions(fx.versions(spark), fx.CUTOFF), "event_id", "version", "value") == [
        ("E1", 2, 12), ("E3", 3, 30), ("E4", 1, 40)
    ]


def test_rolling_calendar(spark):
    rolled = windows.rolling_ctr(fx.rolling(spark), "2026-09-01", "2026-09-08")
    assert rolled.count() == 8
    last = rolled.where("day >= DATE '2026-09-07'").withColumn("day", F.col("day").cast("string"))
    assert rows(last, "ad_id", "day", "impressions_7d", "clicked_7d", "ctr_7d") == [
        ("A1", "2026-09-07", 200, 30, 0.15), ("A1", "2026-09-08", 200, 50, 0.25)
    ]


def test_salted_join_is_the_plain_join(spark):
    facts, dim = fx.skewed(spark), fx.lookup(spark)
    salted = lookup.salted_lookup_join(facts, dim, "ad_id", unknown={"category": "UNKNOWN"}, share=0.2, min_rows=1)
    plain = facts.join(dim, "ad_id", "left").withColumn("category", F.coalesce("category", F.lit("UNKNOWN")))
    assert multiset_equal(salted, plain)
    assert rows(salted.agg(F.count(F.lit(1)), F.sum("cost_cents"))) == [(10, 100)]


@pytest.mark.parametrize("n", [2, 3])
def test_pooled_counts(spark, n):
    pooled = attribution.pooled_ctr(fx.batches(spark).repartition(n))
    assert rows(pooled, "ad_id", "clicked", "impressions", "ctr") == [
        ("A1", 60, 1100, round(60 / 1100, 10)), ("A2", 0, 0, None), ("A3", 4, 20, 0.2)
    ]


def test_pooled_counts_overflow_is_an_error(spark):
    huge = tables.typed_rows(spark, "ad_id STRING, impressions BIGINT, clicked BIGINT", [("A", 2**63 - 1, 0), ("A", 1, 0)])
    with pytest.raises(Exception, match="ARITHMETIC_OVERFLOW"):
        attribution.pooled_ctr(huge).collect()


def test_assigned_user_conversion(spark):
    report = experiments.assigned_user_conversion(fx.assignments(spark), fx.conversions(spark), fx.CUTOFF)
    assert rows(report, "arm", "assigned_users", "converted_users", "conversion_rate") == [("A", 2, 1, 0.5), ("B", 2, 2, 1.0)]


def test_point_in_time(spark):
    found = asof.asof_join(
        fx.predictions(spark), fx.features(spark), ["user_id"], left_ts="prediction_ts",
        clocks=["event_ts", "available_ts"], order=["event_ts", "available_ts", "feature_record_id"], values=["feature_value"],
    )
    assert rows(found, "prediction_id", "user_id", "feature_value") == [("p1", "uA", 3.0), ("p2", "uB", None)]


def test_parquet_day_scan(spark, tmp_path):
    path = str(tmp_path / "by-day")
    tables.write_new(fx.impressions(spark).withColumn("day", F.to_date("impression_ts")), path, partition_by="day")
    day = tables.read_day(spark, path, fx.DAY)
    expected = [("i1", "A1", 100), ("i2", "A1", 200), ("i3", "A2", 300), ("i4", "A3", 400), ("i6", "A1", 600)]
    assert rows(day, "impression_id", "ad_id", "cost_cents") == expected
    reusable = day.where("cost_cents >= 200").persist()
    try:
        assert reusable.count() == 4
        assert rows(tables.cost_by_ad(reusable)) == [("A1", 800), ("A2", 300), ("A3", 400)]
    finally:
        reusable.unpersist()
    assert rows(day.repartition(3, "ad_id")) == expected
    assert rows(day.coalesce(1)) == expected
    with pytest.raises(Exception, match="(?i)exists"):
        tables.write_new(fx.impressions(spark), path)


def test_hourly_sketches_merge_within_their_error(spark):
    at = F.timestamp_seconds(F.lit(1_790_000_000) + F.col("id"))
    score = F.when(F.col("id") % 1000 == 0, F.lit(None)).when(F.col("id") % 1000 == 1, F.lit(float("nan"))).otherwise(F.pmod(F.col("id") * 7919, F.lit(50_021)) / 7.0)
    shown = spark.range(50_000, numPartitions=4).select(F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("p"), at.alias("at"), score.alias("score"))
    hours = search.hourly_sketches(shown, "score", "at", ["p"])
    assert hours.select("hour").distinct().count() >= 13
    found = search.merged_quantiles(hours, ["p"])
    finite = shown.where("score IS NOT NULL AND NOT isnan(score)")
    got = search.quantiles_hold(finite, found, "score", ["p"]).collect()
    assert len(got) == 6 and all(r["within"] for r in got)
    assert {r["p"]: r["n"] for r in got} == {r["p"]: r["count"] for r in finite.groupBy("p").count().collect()}
    shifted = found.withColumn("value", F.col("value") * 0.9)
    assert not any(r["within"] for r in search.quantiles_hold(finite, shifted, "score", ["p"]).collect())
    assert search.hourly_sketches(shown.limit(0), "score", "at", ["p"]).isEmpty()
