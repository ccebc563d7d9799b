"""Physical plans: what is pushed down, what moves, and what happens to a hot key."""

from __future__ import annotations

import itertools
import re
from contextlib import contextmanager

import pytest
from pyspark.sql import functions as F

from clickloom.operators import asof, attribution, evaluation, events, lookup, quality, skew, training, windows
from clickloom.plans import views
from clickloom.plans.inspect import final_plan, formatted_plan
from clickloom.sources import bucketed, tables

from .conftest import SF, rows


@contextmanager
def settings(spark, **values):
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


# Tiny thresholds, so that a test table has partitions that count as skewed.
SKEW = {
    "spark__sql__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__autoBroadcastJoinThreshold": "-1",
    "spark__sql__adaptive__skewJoin__skewedPartitionFactor": "1.5",
    "spark__sql__adaptive__skewJoin__skewedPartitionThresholdInBytes": "2000",
    "spark__sql__adaptive__advisoryPartitionSizeInBytes": "2000",
    "spark__sql__adaptive__coalescePartitions__enabled": "false",
    "spark__sql__shuffle__partitions": "8",
}


@pytest.fixture(scope="module")
def hot(spark):
    """A third of the starts belong to one key and one day."""
    n = 60_000
    ids = spark.range(n, numPartitions=8)
    key = F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 5000)
    base = F.lit("2026-01-01").cast("timestamp_ntz")
    return ids.select(
        "id", key.alias("k"), (base + F.make_dt_interval(secs=(F.col("id") % 80_000).cast("decimal(18,6)"))).alias("t")
    )


def test_existence_splits_hot_starts(spark, hot):
    acts = hot.select("k", F.col("t").alias("u"))
    with settings(spark, **SKEW):
        found = attribution.occurs_within(hot, acts, ["k"], start_ts="t", event_ts="u")
        assert "skew=true" in final_plan(found)
        assert found.where("clicked = 0").isEmpty()
        assert found.count() == 60_000


def test_asof_splits_hot_predictions(spark, hot):
    # All rows of the hot key ask at the same instant.
    asked = hot.withColumn("t", F.when(F.col("k") == -1, F.lit("2026-01-01 12:00:00").cast("timestamp_ntz")).otherwise(F.col("t")))
    history = hot.select("k", F.col("t").alias("e"), F.col("t").alias("a"), F.col("id").alias("rec"))
    with settings(spark, **SKEW):
        found = asof.asof_join(asked, history, ["k"], left_ts="t", clocks=["e", "a"], order=["e", "a", "rec"], values=["rec"])
        assert "skew=true" in final_plan(found)
        assert found.count() == 60_000
        assert found.where("k = -1").select("rec").distinct().count() == 1


def test_retry_storm_is_split(spark, hot):
    base = F.lit("2026-01-01 00:00:00").cast("timestamp_ntz")
    deliveries = hot.select(
        F.col("id").alias("delivery_id"), F.col("k").cast("string").alias("id"), F.concat(F.lit("i"), F.floor(F.col("id") / 1_000_000).cast("string")).alias("impression_id"),
        base.alias("occurred_at"), (base + F.make_dt_interval(secs=(F.col("id") % 3000).cast("decimal(18,6)"))).alias("received_at"),
    )
    shown = spark.range(50).select(F.concat(F.lit("i"), F.col("id").cast("string")).alias("id"), base.alias("occurred_at"), base.alias("received_at"))
    with settings(spark, **SKEW):
        classified = events.classify_clicks(deliveries, shown)
        assert final_plan(classified).count("skew=true") >= 2
        counts = {r["outcome"]: r["count"] for r in classified.groupBy("outcome").count().collect()}
        ids = deliveries.select("id").distinct().count()
        assert counts == {"accepted": ids, "replay": 60_000 - ids}


def test_hot_keys_are_few_and_found(spark, hot):
    found = skew.hot_keys(hot, ["k"], share=0.01, min_rows=100).collect()
    assert len(found) == 1
    assert found[0]["_salts"] == pytest.approx(34, abs=1)


def test_salted_join_spreads_one_key(spark, hot):
    dim = hot.select("k").distinct().withColumn("name", F.concat(F.lit("n"), F.col("k").cast("string")))
    salted = lookup.salted_lookup_join(hot, dim, "k", share=0.01, min_rows=100)
    assert quality.multiset_equal(salted, hot.join(dim, "k", "left"))
    plan = formatted_plan(salted)
    assert "SortMergeJoin" in plan and "approx_top_k" in plan


def test_day_filter_reaches_the_scan(spark):
    cohort = attribution.eligible_impressions(
        spark.read.parquet(f"{SF}/events.parquet").select(F.col("ts").alias("impression_ts"), F.col("ts").alias("received_ts"), "user_id"),
        "2024-01-10", "2024-01-12 00:00:00",
    )
    plan = formatted_plan(cohort)
    pushed = re.search(r"PushedFilters: \[(.*)\]", plan).group(1)
    assert "GreaterThanOrEqual(ts" in pushed and "LessThan(ts" in pushed
    assert re.search(r"ReadSchema: struct<ts:timestamp_ntz,user_id:bigint>", plan)


def test_day_partition_is_pruned(spark, tmp_path):
    path = str(tmp_path / "by-day")
    rows_by_day = views.impressions(spark, SF).withColumn("day", F.to_date("impression_ts"))
    tables.write_new(rows_by_day, path, partition_by="day")
    plan = formatted_plan(tables.read_day(spark, path, "2024-01-10"))
    assert re.search(r"PartitionFilters: \[.*day.*2024-01-10", plan)
    assert "ReadSchema: struct<impression_id:bigint,ad_id:bigint,cost_cents:bigint>" in plan


def test_small_lookup_does_not_move_the_facts(spark):
    facts = views.impressions(spark, SF)
    dim = views.table(spark, SF, "part").select(F.col("p_partkey").alias("ad_id"), "p_type")
    plan = formatted_plan(lookup.lookup_join(facts, dim, "ad_id"))
    assert "BroadcastHashJoin" in plan and not re.search(r"\n\(\d+\) Exchange", plan)


def test_limits_and_sums_run_before_the_shuffle(spark):
    daily = views.table(spark, SF, "part").selectExpr("p_type AS category", "p_partkey AS ad_id", "1000L AS impressions", "1L AS clicked")
    plan = formatted_plan(windows.top_ads_per_category(daily))
    assert plan.count("WindowGroupLimit") >= 2
    pooled = formatted_plan(attribution.pooled_ctr(daily))
    assert "partial_sum" in pooled and len(re.findall(r"\n\(\d+\) Exchange", pooled)) == 1


def test_unique_starts_move_once(spark):
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1"):
        shown, acted = views.served_impressions(spark, SF), views.served_clicks(spark, SF)
        written = {}
        for name, df in (("i", shown), ("c", acted)):
            written[name] = df
        labelled = attribution.mature_impressions(written["i"], written["c"], "2024-01-29 00:00:00")
        plan = formatted_plan(labelled)
        assert re.search(r"SortMergeJoin LeftOuter", plan), plan[:2000]
        # The labels hang on the join itself: nothing is shuffled above it.
        assert "Exchange" not in plan[: plan.index("SortMergeJoin LeftOuter")] and "CartesianProduct" not in plan


def test_star_join_over_buckets_moves_nothing(spark, tmp_path):
    plain = [views.served_impressions(spark, SF), views.search_requests(spark, SF), views.search_results(spark, SF)]
    stored = [
        bucketed.write_bucketed(df, key, name, str(tmp_path / name), buckets=4)
        for df, key, name in zip(plain, ("request_id", "id", "request_id"), ("impressions", "requests", "results"))
    ]
    with settings(spark, spark__sql__autoBroadcastJoinThreshold="-1", spark__sql__adaptive__autoBroadcastJoinThreshold="-1"):
        joined = training.captured_impressions(*stored)
        assert formatted_plan(joined, "simple").count("SortMergeJoin") == 2 and "Exchange" not in final_plan(joined)
        # Labels come after: the joined impressions move once, by id.
        clicks, as_of = views.served_clicks(spark, SF), "2026-01-01 00:00:00"
        examples = training.training_examples_by_request(stored[0], clicks, *stored[1:], as_of)
        lines = formatted_plan(examples, "simple").splitlines()
        top = next(i for i, line in enumerate(lines) if "SortMergeJoin [request_id" in line)
        depth = lines[top].index("SortMergeJoin")
        below = lines[top:top + 1] + list(itertools.takewhile(lambda line: re.search(r"[A-Z]", line).start() > depth, lines[top + 1 :]))
        assert sum("SortMergeJoin" in x for x in below) == 2 and sum("FileScan" in x for x in below) == 3
        assert not any("Exchange" in x for x in below)
        assert "Exchange" in lines[top - 2]
        expected = training.training_examples(plain[0], clicks, *plain[1:], as_of)
        assert rows(examples, *expected.columns) == rows(expected)


def test_area_under_roc_is_a_plan(spark):
    """No job while it is built, no window over the whole table, and the area of a plain count over pairs."""
    scored = spark.range(3000).select(
        F.when(F.col("id") % 50 > 0, F.round(F.pmod(F.xxhash64("id"), F.lit(400)) / 400, 4)).alias("p"),
        F.when(F.col("id") % 70 > 0, (F.pmod(F.xxhash64("id", F.lit(1)), F.lit(5)) == 0).cast("int")).alias("label"),
    )
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("area", "area")
    area = evaluation.area_under_roc(scored)
    assert not tracker.getJobIdsForGroup("area")
    windows_of = [line for line in formatted_plan(area, "simple").splitlines() if re.search(r"\bWindow \[", line)]
    assert windows_of and all(re.search(r"windowspecdefinition\(_range#", line) for line in windows_of)
    kept = scored.where("p IS NOT NULL AND label IS NOT NULL").collect()
    hits, rest = [r["p"] for r in kept if r["label"]], [r["p"] for r in kept if not r["label"]]
    wins = sum((a > b) + 0.5 * (a == b) for a in hits for b in rest)
    assert area.first()["auc"] == pytest.approx(wins / len(hits) / len(rest), abs=1e-12)
    assert evaluation.area_under_roc(scored.where("label = 0")).first()["auc"] is None
    assert evaluation.area_under_roc(scored.where("false")).first()["auc"] is None


def test_no_operator_uses_python_or_rdds_or_nested_loops(spark):
    from clickloom.plans.queries import QUERIES

    for name in ("clicked_impression_ctr", "point_in_time", "lexical_search", "policy_resolution", "impression_outcomes"):
        plan = formatted_plan(QUERIES[name](spark, SF))
        for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "PythonUDF", "ArrowEvalPython", "BatchEvalPython"):
            assert bad not in plan, (name, bad)

