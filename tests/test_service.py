"""The serving tables end to end: labels, exports, snapshots, policies, experiments."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from clickloom.functions import hashing
from clickloom.operators import attribution, evaluation, events, experiments, quality, search, training
from clickloom.plans import search_run
from clickloom.schemas import FEATURES, TABLES
from clickloom.sources import tables

from .conftest import rows

START = dt.datetime(2026, 9, 1, 12)
HOUR = dt.timedelta(hours=1)


def ntz(ddl):
    return ddl.replace("TIMESTAMP", "TIMESTAMP_NTZ")


def make(spark, table, *records, extra=""):
    return spark.createDataFrame(list(records), ntz(TABLES[table] + extra))


@pytest.fixture()
def ads(spark):
    return make(spark, "ads", ("ad-1", "Camera Alpha", "Cameras", START), ("ad-2", "Camera Beta", "Cameras", START))


@pytest.fixture()
def snapshot(spark):
    return make(spark, "feature_snapshots", ("snap", "click-v1", START - 30 * 24 * HOUR, START, START, "fixture", "h"))


@pytest.fixture()
def ad_features(spark):
    return make(spark, "ad_features", ("snap", "ad-1", 100, 30))


def model(version="model-a", loss=0.4, scale=1.0):
    return (
        version, "click-v1", list(FEATURES), [0.0] * 3, [scale, 1.0, 1.0], [1.0, 1.0, 0.1], -1.0, START - 240 * HOUR,
        START - 120 * HOUR, START - dt.timedelta(seconds=1), 100, 50, 50, loss, 0.6, 0.4, 0.6, 0.2, "fixture",
    )


REQUEST = "id STRING, user_id STRING, query STRING, created_at TIMESTAMP_NTZ, limit INT, experiment_id STRING"


def resolve(spark, snapshot, *, user="user", at=START, experiment=None, deployed=("model-a", 100), models=(model(),), active=True):
    requests = spark.createDataFrame([("r", user, "camera", at, 10, experiment)], REQUEST)
    config = make(spark, "experiments", ("ranking-test", "fixed-salt", "model-a", 50, active, START))
    deployments = make(spark, "deployments", (0, None, 0, START - 10 * HOUR), (1, *deployed, START - HOUR))
    return search.resolve_policy(requests, config, deployments, snapshot, make(spark, "models", *models))


def user_for(spark, treatment):
    users = spark.range(1000).select(F.concat(F.lit("u-"), F.col("id").cast("string")).alias("u"))
    hit = hashing.bucket(F.lit("ranking-test"), F.lit("fixed-salt"), F.col("u")) < 5000
    return users.where(hit if treatment else ~hit).orderBy(F.length("u"), "u").first()["u"]


def outcome(df):
    row = df.first()
    return row["policy"], row["model_version"], row["fallback_reason"]


def test_policy_precedence(spark, snapshot):
    none = snapshot.limit(0)
    control, treatment = user_for(spark, False), user_for(spark, True)
    assert outcome(resolve(spark, snapshot)) == ("model", "model-a", None)
    assert outcome(resolve(spark, snapshot, deployed=(None, 0))) == ("baseline", None, "baseline_selected")
    assert outcome(resolve(spark, none)) == ("baseline", None, "missing_features")
    assert outcome(resolve(spark, none, deployed=(None, 0))) == ("baseline", None, "baseline_selected")
    assert outcome(resolve(spark, snapshot, at=START + 24 * HOUR)) == ("model", "model-a", None)
    assert outcome(resolve(spark, snapshot, at=START + 25 * HOUR)) == ("baseline", None, "stale_features")
    assert outcome(resolve(spark, snapshot, at=START + 25 * HOUR, deployed=(None, 0))) == ("baseline", None, "stale_features")
    assert outcome(resolve(spark, snapshot, deployed=("other", 100))) == ("baseline", None, "missing_model")
    assert outcome(resolve(spark, snapshot, models=(model(scale=0.0),))) == ("baseline", None, "invalid_model")
    assert outcome(resolve(spark, snapshot, user=control, experiment="ranking-test")) == ("baseline", None, "baseline_selected")
    assert outcome(resolve(spark, snapshot, user=treatment, experiment="ranking-test")) == ("model", "model-a", None)
    stopped = resolve(spark, snapshot, user=treatment, experiment="ranking-test", active=False)
    assert outcome(stopped) == ("baseline", None, "experiment_stopped")
    assert stopped.first()["experiment_id"] is None
    assert outcome(resolve(spark, snapshot, experiment="nowhere")) == (None, None, "unknown_experiment")


def test_snapshot_visibility(spark, snapshot):
    at = spark.createDataFrame([(0, START - dt.timedelta(seconds=1)), (1, START)], "id INT, created_at TIMESTAMP_NTZ")
    assert rows(search.snapshot_as_of(at, snapshot), "id", "snapshot_id") == [(0, None), (1, "snap")]


def test_search_run_log_and_order(spark, ads, snapshot, ad_features, tmp_path):
    requests = spark.createDataFrame(
        [("r1", "user", "camera", START, 10, None), ("r2", "user", "camera beta", START, 1, None), ("r3", "user", "x", START, 51, None),
         ("r4", "other", "camera", START, 1, None), ("r5", "other", "nothing", START, 5, None)],
        REQUEST,
    )
    source = search_run.SearchTables(
        ads=ads, experiments=make(spark, "experiments", ("e", "s", "model-a", 50, True, START)),
        deployments=make(spark, "deployments", (1, "model-a", 100, START - HOUR)), snapshots=snapshot,
        ad_features=ad_features, models=make(spark, "models", model()),
    )
    refused = search_run.run(requests, source, str(tmp_path))
    assert rows(refused, "id") == [("r3",)]
    log = spark.read.parquet(f"{tmp_path}/search_requests")
    assert rows(log, "id", "policy") == [(r, "model") for r in ("r1", "r2", "r4", "r5")]
    results = spark.read.parquet(f"{tmp_path}/search_results")
    assert rows(results, "request_id", "position", "ad_id") == [
        ("r1", 1, "ad-1"), ("r1", 2, "ad-2"), ("r2", 1, "ad-2"), ("r4", 1, "ad-1")
    ]
    first = results.where("request_id = 'r1' AND ad_id = 'ad-1'").first()
    assert first["smoothed_ctr"] == pytest.approx(31 / 120) and 0 < first["score"] < 1
    cold = results.where("request_id = 'r1' AND ad_id = 'ad-2'").first()
    assert (cold["smoothed_ctr"], cold["log_impressions"]) == (0.05, 0.0)


def test_one_invalid_score_moves_the_request_to_the_baseline(spark, ads, snapshot):
    broken = make(spark, "ad_features", ("snap", "ad-1", 3, 4))
    resolved = resolve(spark, snapshot)
    candidates = search.lexical_candidates(resolved.select("query"), ads)
    served = search.serve(resolved, candidates, broken, make(spark, "models", model()))
    assert rows(search.request_log(served), "policy", "model_version", "fallback_reason") == [("baseline", None, "invalid_score")]
    for r in search.result_rows(served).collect():
        assert r["score"] == pytest.approx(r["text_relevance"] + 0.25 * r["smoothed_ctr"])


@pytest.fixture()
def interactions(spark):
    """One request that returned both ads, the deliveries of its exposures and clicks."""
    requests = make(spark, "search_requests", ("q", "user", "camera", START, "model", "model-a", "snap", None, None, None))
    results = make(
        spark, "search_results", ("q", "ad-1", 1, 0.6, 0.1, 0.25, 4.6), ("q", "ad-2", 2, 0.4, 0.1, 0.05, 0.0)
    )
    shown = spark.createDataFrame(
        [
            (1, "i1", "q", "ad-1", START, START), (2, "i1", "q", "ad-1", START, START), (3, "i1", "q", "ad-2", START, START),
            (4, "i9", "q", "ad-1", START, START), (5, "i2", "q", "ad-2", START, START), (6, "i1", "q", "ad-1", START, START + 26 * HOUR),
            (7, "i7", "q", "ad-1", START + dt.timedelta(seconds=1), START),
        ],
        "delivery_id INT, id STRING, request_id STRING, ad_id STRING, occurred_at TIMESTAMP_NTZ, received_at TIMESTAMP_NTZ",
    )
    acted = spark.createDataFrame(
        [
            (1, "c1", "i1", START, START), (2, "c1", "i1", START, START), (3, "c2", "i1", START, START), (4, "c0", "i0", START, START),
            (5, "c4", "i1", START + 24 * HOUR, START + 24 * HOUR), (6, "c5", "i1", START, START + 24 * HOUR),
        ],
        "delivery_id INT, id STRING, impression_id STRING, occurred_at TIMESTAMP_NTZ, received_at TIMESTAMP_NTZ",
    )
    impressions = events.classify_impressions(shown, requests, results)
    clicks = events.classify_clicks(acted, events.accepted(impressions))
    return requests, results, impressions, clicks


def test_deliveries(interactions):
    _, _, impressions, clicks = interactions
    assert [o for _, o in rows(impressions, "delivery_id", "outcome")] == [
        "accepted", "replay", "conflict", "conflict", "accepted", "replay", "rejected"
    ]
    assert rows(clicks, "delivery_id", "outcome", "reason") == [
        (1, "accepted", None), (2, "replay", None), (3, "accepted", None), (4, "conflict", "impression_not_arrived"),
        (5, "rejected", "attribution_window"), (6, "rejected", "clock"),
    ]
    rollup = events.ingest_rollup(impressions, clicks)
    assert rollup.agg(F.sum("deliveries")).first()[0] == 13


def test_labels_mature_once(interactions):
    requests, results, impressions, clicks = interactions
    shown, acted = events.accepted(impressions), events.accepted(clicks)
    early = training.training_examples(shown, acted, requests, results, START + 24 * HOUR)
    assert early.count() == 0
    late = START + 26 * HOUR
    examples = training.training_examples(shown, acted, requests, results, late)
    assert rows(examples, "impressionId", "label") == [("i1", 1.0), ("i2", 0.0)]
    report = attribution.mature_ctr_report(shown, acted, START, START + dt.timedelta(seconds=1), late)
    assert rows(report, "ad_id", "impressions", "clicked_impressions", "ctr") == [("ad-1", 1, 1, 1.0), ("ad-2", 1, 0, 0.0)]
    exact = attribution.mature_ctr_report(shown, acted, START, START + HOUR, START + 25 * HOUR)
    assert exact.count() == 2
    quality_rows = evaluation.model_quality(shown, acted, requests, results, START, START + HOUR, late)
    assert rows(quality_rows, "model_version", "impressions", "ctr") == [("model-a", 2, 0.5)]


def test_frozen_export(spark, interactions, tmp_path):
    requests, results, impressions, clicks = interactions
    late = START + 26 * HOUR
    examples = training.training_examples(events.accepted(impressions), events.accepted(clicks), requests, results, late)
    assert tables.freeze_export(examples, str(tmp_path), "x1", late) == "created"
    assert tables.freeze_export(examples.limit(0), str(tmp_path), "x1", late) == "replay"
    with pytest.raises(quality.ContractError):
        tables.freeze_export(examples, str(tmp_path), "x1", START)
    with pytest.raises(quality.ContractError):
        tables.freeze_export(examples, str(tmp_path), "x2", late, now=START)
    # An attempt that died before its header leaves rows that no later read takes.
    tables.write_new(examples.limit(1), f"{tmp_path}/rows/export_id=x3/attempt=dead")
    assert tables.freeze_export(examples, str(tmp_path), "x3", late) == "created"
    for name in ("x1", "x3"):
        folder = tables.read_export(spark, str(tmp_path), name).first()["rows"]
        assert spark.read.parquet(folder).count() == 2
    thawed = training.thaw_payloads(spark.read.parquet(folder))
    assert rows(thawed, "impressionId", "label") == [("i1", 1.0), ("i2", 0.0)]


def test_lengths_in_utf16_units_and_rounded_multisets(spark):
    long, short = "\U0001F4F7" * 65, "\U0001F4F7" * 64
    df = spark.createDataFrame([(long,), (short,), ("a" * 128,)], "s STRING")
    assert [r[0] for r in df.select(quality.source_id_invalid(F.col("s"))).collect()] == [True, False, False]
    a, b = (spark.createDataFrame([(x, "k")], "x DOUBLE, k STRING") for x in (0.1 + 0.2, 0.3))
    assert quality.multiset_equal(a, b) and not quality.multiset_equal(a, b.union(b)) and not quality.multiset_equal(a, b, 17)


def test_publications(spark, ads, ad_features):
    stored = spark.createDataFrame([("a", "1"), ("b", "1")], "id STRING, content_hash STRING")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("c", "1")], "id STRING, content_hash STRING")
    assert rows(quality.classify_publication(new, stored), "id", "publication") == [("a", "replay"), ("b", "conflict"), ("c", "created")]
    more = make(
        spark, "ad_features", ("s1", "ad-1", 1, 1), ("s2", "nowhere", 1, 1), ("s3", "ad-1", 1, 2), ("s4", "ad-1", 1, 0), ("s4", "ad-1", 1, 0)
    )
    assert rows(quality.snapshot_row_violations(ad_features.unionByName(more), ads)) == [
        ("s2", "unknown_ad"), ("s3", "counts"), ("s4", "repeated_ad")
    ]


def test_experiment_counts_unexposed_users(spark, snapshot):
    control, treated = user_for(spark, False), user_for(spark, True)
    config = make(spark, "experiments", ("ranking-test", "fixed-salt", "model-a", 50, True, START))
    requests = make(
        spark, "search_requests",
        ("q1", control, "camera", START, "baseline", None, None, "ranking-test", "control", None),
        ("q2", treated, "camera", START, "model", "model-a", "snap", "ranking-test", "treatment", None),
    )
    assigned = experiments.assign(requests, config)
    assert rows(assigned, "user_id", "arm") == sorted([(control, "control"), (treated, "treatment")])
    assert experiments.assign(requests, config, assigned).count() == 0
    assert experiments.assign(requests, config.withColumn("active", F.lit(False))).count() == 0
    shown = make(spark, "impressions", ("i", "q2", "ad-1", START, START))
    acted = make(spark, "clicks", ("c", "i", START, START))
    report = experiments.experiment_report(config, assigned, requests, shown, acted, START + 26 * HOUR).first()
    assert [report[c] for c in ("control_users", "control_converted", "treatment_users", "treatment_converted")] == [1, 0, 1, 1]
    assert report["small_sample"]
    early = experiments.experiment_report(config, assigned, requests, shown, acted, START + 24 * HOUR).first()
    assert early["control_users"] == 0 and early["absolute_lift"] is None


def test_active_deployment(spark):
    history = make(spark, "deployments", (0, None, 0, START), (2, "b", 100, START + HOUR), (1, "a", 5, START + 2 * HOUR))
    assert search.active_deployment(history).first()["model_version"] == "b"
