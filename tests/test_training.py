"""Training contract, split, fit, evaluation and the artifacts of a run."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from clickloom.operators import evaluation, quality, search, training
from clickloom.plans import training_run
from clickloom.schemas import TRAINING_EXAMPLE
from clickloom.sources import provenance, tables

from . import synthetic
from .conftest import rows

AS_OF = dt.datetime(2026, 9, 21, 12)


@pytest.fixture(scope="module")
def examples(spark):
    made = synthetic.synthetic_examples(synthetic.default_catalog(spark), AS_OF)
    cast = made.withColumns({c: F.col(c).cast("timestamp") for c in ("predictionTime", "impressionTime", "labelAvailableAt")})
    return cast.persist()


def test_synthetic_shape(spark, examples):
    assert examples.count() == 6400
    assert examples.select("impressionId").distinct().count() == 6400
    assert examples.select("requestId").distinct().count() == 800
    again = synthetic.synthetic_examples(synthetic.default_catalog(spark).repartition(5), AS_OF)
    cast = again.withColumns({c: F.col(c).cast("timestamp") for c in ("predictionTime", "impressionTime", "labelAvailableAt")})
    assert quality.multiset_equal(examples, cast)
    with pytest.raises(ValueError):
        synthetic.synthetic_examples(synthetic.default_catalog(spark, 1), AS_OF)


def test_valid_examples_pass(examples):
    assert quality.validate_training(examples, AS_OF) == 6400


@pytest.mark.parametrize(
    ("column", "expression", "rule"),
    [
        ("adId", "NULL", "null_field"),
        ("requestId", "'not-a-uuid'", "bad_uuid_requestId"),
        ("impressionId", "concat(impressionId, '\n')", "bad_uuid_impressionId"),
        ("schemaVersion", "'click-v0'", "schema_version"),
        ("label", "0.5D", "label"),
        ("predictionTime", "impressionTime + INTERVAL 1 SECOND", "prediction_after_impression"),
        ("labelAvailableAt", "impressionTime + INTERVAL 24 HOURS", "label_too_early"),
        ("labelAvailableAt", "TIMESTAMP '2026-09-21 12:00:01'", "label_in_future"),
        ("textRelevance", "DOUBLE('NaN')", "range_textRelevance"),
        ("smoothedCtr", "-0.1D", "range_smoothedCtr"),
        ("logImpressions", "28.0D", "range_logImpressions"),
    ],
)
def test_one_fault_one_rule(examples, column, expression, rule):
    one = examples.orderBy("impressionId").limit(1).withColumn(column, F.expr(expression))
    assert quality.with_violations(one, quality.training_rules(AS_OF)).first()["violations"] == [rule]
    with pytest.raises(quality.ContractError):
        quality.validate_training(one, AS_OF)


def test_set_contracts(examples):
    with pytest.raises(quality.ContractError, match="No mature"):
        quality.validate_training(examples.limit(0), AS_OF)
    with pytest.raises(quality.ContractError, match="duplicate_key"):
        quality.validate_training(examples.unionByName(examples.limit(1)), AS_OF)
    first = F.col("impressionId") == examples.agg(F.min("impressionId")).first()[0]
    moved = examples.withColumn(
        "predictionTime", F.when(first, F.col("predictionTime") - F.expr("INTERVAL 1 SECOND")).otherwise(F.col("predictionTime"))
    )
    with pytest.raises(quality.ContractError, match="predictionTime"):
        quality.validate_training(moved, AS_OF)


def test_split_purges_across_boundaries(spark):
    start = dt.datetime(2026, 9, 1)
    times = {"train": 0, "edge": 23 * 60 - 1, "purged": 24 * 60, "validation": 48 * 60, "test": 96 * 60}
    df = spark.createDataFrame(
        [(n, start + dt.timedelta(minutes=m), start + dt.timedelta(minutes=m + 1500), 0.0) for n, m in times.items()],
        "name STRING, predictionTime TIMESTAMP_NTZ, labelAvailableAt TIMESTAMP_NTZ, label DOUBLE",
    )
    split = training.with_split(df, start + dt.timedelta(days=2), start + dt.timedelta(days=4), start + dt.timedelta(days=6))
    assert {r["name"]: r["split"] for r in split.collect()} == {
        "train": "train", "edge": "purged" if times["edge"] + 1500 > 2880 else "train", "purged": "purged",
        "validation": "validation", "test": "test",
    }


def test_run_writes_and_verifies(spark, examples, tmp_path):
    out = str(tmp_path / "run")
    result = training_run.run(examples, out, version="ctr-v1", snapshot_id="snap-1", as_of=AS_OF, synthetic=True, now=AS_OF)
    m = result.metrics
    # The published sizes of the reference run: 3184 / 1352 / 912 rows, 952 purged.
    assert (m["train_rows"], m["validation_rows"], m["test_rows"], m["purged_rows"]) == (3184, 1352, 912, 952)
    assert m["test_log_loss"] < m["baseline_test_log_loss"]
    assert m["model_ndcg_at_10"] > m["baseline_ndcg_at_10"]
    assert 0.7 < m["test_auc"] < 0.9
    assert m["max_parity_error"] <= 1e-9
    assert training_run.verify(spark, out).isEmpty()
    model = training_run.read_model(spark, out)
    assert quality.with_violations(model, evaluation.model_rules()).first()["violations"] == []
    assert model.where(evaluation.promotion_eligible()).count() == 1
    daily = spark.read.parquet(f"{out}/daily_features")
    features = spark.read.parquet(f"{out}/ad_features")
    assert daily.agg(F.sum("impressions")).first()[0] == features.agg(F.sum("impressions")).first()[0] == 6400
    from pyspark.ml import PipelineModel

    reloaded = training.with_probability(PipelineModel.load(f"{out}/pipeline"), examples)
    assert evaluation.max_parity_error(reloaded, result.parameters) <= 1e-9
    with pytest.raises(Exception, match="(?i)exists"):
        training_run.run(examples, out, version="ctr-v1", snapshot_id="snap-1", as_of=AS_OF, now=AS_OF)
    # The published snapshot is the one that requests from then on are served with.
    asked = spark.createDataFrame([(1, AS_OF), (2, AS_OF - dt.timedelta(seconds=1))], "id INT, created_at TIMESTAMP")
    served = search.snapshot_as_of(asked, spark.read.parquet(f"{out}/feature_snapshot"))
    assert {r["id"]: r["snapshot_id"] for r in served.collect()} == {1: "snap-1", 2: None}
    with pytest.raises(quality.ContractError):
        training_run.run(examples, out, version="ctr-v1", snapshot_id="snap-1", as_of=AS_OF, now=AS_OF - dt.timedelta(days=1))
    recorded = spark.read.schema("version STRING, source_id STRING, model_sha256 STRING, snapshot_sha256 STRING").json(f"{out}/manifest")
    changed = model.withColumn("intercept", F.col("intercept") + 1)
    assert rows(provenance.manifest_mismatches(recorded, changed, features).select("artifact")) == [("model",)]


def test_run_boundaries():
    day = dt.timedelta(days=1)
    quality.check_run_boundaries(AS_OF - 30 * day, AS_OF - 8 * day, AS_OF - 4 * day, AS_OF)
    for bad in ((AS_OF - 91 * day, AS_OF - 8 * day, AS_OF - 4 * day), (AS_OF - 30 * day, AS_OF - 4 * day, AS_OF - 4 * day), (AS_OF, AS_OF - 8 * day, AS_OF - 4 * day)):
        with pytest.raises(quality.ContractError):
            quality.check_run_boundaries(*bad, AS_OF)
    quality.check_report_range(AS_OF - day, AS_OF, AS_OF)
    for bad in ((AS_OF, AS_OF, AS_OF), (AS_OF - 32 * day, AS_OF, AS_OF), (AS_OF - day, AS_OF + day, AS_OF)):
        with pytest.raises(quality.ContractError):
            quality.check_report_range(*bad)
    with pytest.raises(quality.ContractError):
        quality.check_report_range(AS_OF - day, AS_OF, AS_OF, now=AS_OF - day)


def test_small_split_is_refused(examples):
    early = examples.where(F.col("predictionTime") < F.lit(AS_OF - dt.timedelta(days=8)))
    with pytest.raises(quality.ContractError, match="too few mature rows"):
        training_run.fit_and_evaluate(early, AS_OF - dt.timedelta(days=8), AS_OF - dt.timedelta(days=4), AS_OF)


def test_constant_feature_weighs_nothing(spark, examples):
    flat = examples.withColumn("smoothedCtr", F.lit(0.5))
    fitted = training.fit_click_model(flat, 0.01)
    parameters = training.model_parameters(fitted)
    assert parameters["scales"][1] == 1.0 and parameters["coefficients"][1] == 0.0
    assert evaluation.max_parity_error(training.with_probability(fitted, flat), parameters) <= 1e-9


def test_jsonl_fails_fast(spark, examples, tmp_path):
    path = str(tmp_path / "rows")
    examples.limit(30).write.json(path)
    back = tables.read_training_jsonl(spark, path)
    assert quality.multiset_equal(back, examples.limit(30).select(*back.columns)) or back.count() == 30
    bad = tmp_path / "bad.jsonl"
    bad.write_text('{"impressionId": "x", "label": "no number"}\n')
    with pytest.raises(Exception, match="(?i)malformed|FAILFAST|CANNOT_PARSE"):
        tables.read_training_jsonl(spark, str(bad)).collect()


def test_catalog_ids_skip_blank_lines(spark, tmp_path):
    file = tmp_path / "catalog.jsonl"
    file.write_text('{"id": "a", "title": "T"}\n\n{"id": "b", "title": "U"}\n')
    assert rows(tables.read_catalog_ids(spark, str(file))) == [("a",), ("b",)]


def test_metrics_by_hand(spark):
    y, p = [1, 0, 1, 0, 1], [0.9, 0.9, 0.4, 0.2, 1.0]
    scored = spark.createDataFrame(
        [("r1" if i < 3 else "r2", f"a{i}", float(a), b) for i, (a, b) in enumerate(zip(y, p))],
        "requestId STRING, adId STRING, label DOUBLE, p DOUBLE",
    )
    clamp = [min(max(v, 1e-15), 1 - 1e-15) for v in p]
    loss = evaluation.probability_losses(scored).first()
    assert loss["log_loss"] == pytest.approx(-sum(a * math.log(v) + (1 - a) * math.log(1 - v) for a, v in zip(y, clamp)) / 5)
    assert loss["brier"] == pytest.approx(sum((v - a) ** 2 for a, v in zip(y, p)) / 5)
    wins = sum((p[i] > p[j]) + 0.5 * (p[i] == p[j]) for i in range(5) for j in range(5) if y[i] > y[j])
    assert evaluation.area_under_roc(scored).first()["auc"] == pytest.approx(wins / 6)
    # r1 ranks a0 (clicked), a1, a2 (clicked); r2 ranks a4 (clicked), a3.
    expected = ((1 + 1 / math.log2(4)) / (1 + 1 / math.log2(3)) + 1) / 2
    assert evaluation.ndcg_at(scored, "p").first()["ndcg"] == pytest.approx(expected)
    assert evaluation.ndcg_at(scored.where("label = 0"), "p").first()["ndcg"] == 0
    bins = rows(evaluation.calibration(scored), "bin", "n", "observedRate")
    assert bins == [(2, 1, 0.0), (4, 1, 1.0), (9, 3, round(2 / 3, 10))]


def test_model_rules_name_the_fault(spark, examples):
    good = {
        "version": "model-a", "schema_version": "click-v1", "feature_names": ["textRelevance", "smoothedCtr", "logImpressions"],
        "means": [0.0, 0.0, 0.0], "scales": [1.0, 1.0, 1.0], "coefficients": [1.0, 1.0, 0.1], "intercept": -1.0,
        "trained_through": AS_OF - dt.timedelta(days=10), "validation_through": AS_OF - dt.timedelta(days=5), "evaluation_as_of": AS_OF,
        "training_rows": 100, "validation_rows": 50, "test_rows": 50, "validation_log_loss": 0.4,
        "baseline_validation_log_loss": 0.6, "test_log_loss": 0.4, "baseline_test_log_loss": 0.6, "test_brier": 0.2, "source_id": "fixture",
    }
    from clickloom.schemas import TABLES

    schema = TABLES["models"]
    names = [f.split()[0] for f in schema.split(", ")]

    def broken(**changes):
        row = good | changes
        df = spark.createDataFrame([tuple(row[n] for n in names)], schema)
        return quality.with_violations(df, evaluation.model_rules(F.lit(AS_OF))).first()["violations"]

    assert broken() == []
    assert broken(schema_version="unknown") == ["schema"]
    assert broken(feature_names=["smoothedCtr", "textRelevance", "logImpressions"]) == ["schema"]
    assert broken(scales=[1.0, 1e-13, 1.0]) == ["scales"]
    assert broken(coefficients=[1.0, float("nan"), 0.0]) == ["coefficients"]
    assert broken(means=[0.0, 0.0]) == ["means"]
    assert broken(intercept=1e7) == ["intercept"]
    assert broken(validation_log_loss=None) == ["validation_log_loss"]
    assert broken(test_brier=1.5) == ["brier_above_one"]
    assert broken(training_rows=1) == ["sample_sizes"]
    assert broken(validation_through=AS_OF) == ["boundaries"]
    assert broken(source_id=" ") == ["source_id"]
    assert broken(evaluation_as_of=AS_OF + dt.timedelta(days=1)) == ["evaluated_in_future"]


def test_declared_schema_names():
    assert [f.split()[0] for f in TRAINING_EXAMPLE.split(", ")][-1] == "label"


def test_native_scorer_equals_an_arrow_twin(spark, examples):
    parameters = {"means": [0.2, 0.3, 5.0], "scales": [0.1, 0.2, 1.5], "coefficients": [1.0, -2.0, 0.5], "intercept": -0.3}
    m, s, c = (np.array(parameters[k]) for k in ("means", "scales", "coefficients"))

    @F.pandas_udf("double")
    def twin(a: pd.Series, b: pd.Series, d: pd.Series) -> pd.Series:
        z = parameters["intercept"] + ((np.column_stack([a, b, d]) - m) / s) @ c
        return pd.Series(1 / (1 + np.exp(-z)))

    scored = examples.withColumn("p", twin("textRelevance", "smoothedCtr", "logImpressions"))
    assert evaluation.max_parity_error(scored, parameters) <= 1e-12
    with pytest.raises(ValueError, match="differ"):
        evaluation.max_parity_error(scored.withColumn("p", F.col("p") + 1e-6), parameters)


def test_digests_ignore_order_and_files(spark, examples, tmp_path):
    one = provenance.rows_sha256(examples.repartition(1)).first()["sha256"]
    assert one == provenance.rows_sha256(examples.repartition(7, "adId")).first()["sha256"]
    assert one != provenance.rows_sha256(examples.limit(6399)).first()["sha256"]
    assert one != provenance.rows_sha256(examples.unionByName(examples.limit(1))).first()["sha256"]
    for name in ("a", "b"):
        (tmp_path / name).mkdir()
        for i, text in enumerate(["x", "y"] if name == "a" else ["y", "x"]):
            (tmp_path / name / f"part-{i}").write_text(text)
    digests = {provenance.files_sha256(spark, str(tmp_path / name)).first()["sha256"] for name in ("a", "b")}
    assert len(digests) == 1
    assert provenance.source_id("ab") == "sha256:ab" and provenance.source_id("ab", synthetic=True) == "synthetic:ab"


def test_ad_snapshot_from_json_array(spark):
    df = spark.createDataFrame([("s", '[{"adId":"a","impressions":3,"clickedImpressions":1}]'), ("t", "[]")], "id STRING, rows STRING")
    assert rows(tables.json_array_rows(df, "rows", "adId STRING, impressions BIGINT, clickedImpressions BIGINT")) == [("s", "a", 3, 1)]
