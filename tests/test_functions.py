"""Pure values: buckets, features, scorer, statistics, text."""

from __future__ import annotations

import hashlib
import math
import uuid

import pytest
from pyspark.sql import functions as F

from clickloom.functions import click_model, columns, hashing, stats, text
from clickloom.operators import quality
from clickloom.operators.experiments import compare_arms


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first()["v"]


def bucket_of(*parts):
    key = "".join(f"{len(p)}:{p}" for p in parts)
    return int(hashlib.sha256(key.encode()).hexdigest()[:8], 16) % 10_000


def test_bucket(spark):
    assert value(spark, hashing.bucket(F.lit("exp"), F.lit("salt"), F.lit("user"))) == 5810
    a = value(spark, hashing.bucket(F.lit("a"), F.lit("bc")))
    assert a == bucket_of("a", "bc") != value(spark, hashing.bucket(F.lit("ab"), F.lit("c")))
    users = spark.range(10_000).select(hashing.bucket(F.lit("exp"), F.lit("salt"), F.concat(F.lit("user-"), F.col("id").cast("string"))).alias("b"))
    assert 4700 < users.where("b < 5000").count() < 5300


def test_rollout_is_monotone(spark):
    users = spark.range(2000).select(F.col("id").cast("string").alias("u"))
    at = [users.where(hashing.in_rollout(F.lit("m"), F.col("u"), F.lit(p))) for p in (5, 25, 100)]
    assert at[0].exceptAll(at[1]).isEmpty() and at[1].exceptAll(at[2]).isEmpty()
    assert at[2].count() == 2000


def test_features(spark):
    def of(i, c):
        return value(spark, F.array(click_model.smoothed_ctr(F.lit(i), F.lit(c)), click_model.log_impressions(F.lit(i))))

    assert of(0, 0) == [0.05, 0.0]
    assert of(100, 59)[0] == 0.5
    for relevance, i, c, ok in ((0.2, 0, 0, True), (0.0, 3, 4, False), (2.0, 0, 0, False), (float("nan"), 1, 0, False)):
        assert value(spark, click_model.valid_inputs(F.lit(relevance), F.lit(i), F.lit(c))) is ok


def scored(spark, x, means, scales, coefficients, intercept=0.0):
    def array(values):
        return F.array(*[F.lit(float(v)) for v in values])

    df = spark.createDataFrame([tuple(map(float, x))], "a DOUBLE, b DOUBLE, c DOUBLE")
    return click_model.with_probability(
        df, "p", ["a", "b", "c"], array(means), array(scales), array(coefficients), F.lit(intercept)
    ).first()["p"]


def test_scorer(spark):
    assert scored(spark, [3, 0, 0], [1, 0, 0], [2, 1, 1], [2, 0, 0]) == pytest.approx(1 / (1 + math.exp(-2)), abs=1e-15)
    assert value(spark, click_model.sigmoid(F.lit(-1000.0))) == 0.0
    assert value(spark, click_model.sigmoid(F.lit(1000.0))) == 1.0
    for bad in (float("nan"), float("inf")):
        assert scored(spark, [bad, 0, 0], [0, 0, 0], [1, 1, 1], [0, 1, 1]) is None


def compare(spark, *counts):
    df = spark.createDataFrame(
        [counts], "control_users BIGINT, control_converted BIGINT, treatment_users BIGINT, treatment_converted BIGINT, treatment_percent INT"
    )
    return compare_arms(df).first()


def test_comparison(spark):
    r = compare(spark, 1000, 100, 1000, 130, 50)
    assert r["absolute_lift"] == pytest.approx(0.03)
    assert r["lift_lower95"] < 0.03 < r["lift_upper95"]
    assert not r["sample_ratio_mismatch"] and not r["small_sample"]
    empty = compare(spark, 0, 0, 0, 0, 50)
    assert empty["absolute_lift"] is None and empty["small_sample"] and empty["allocation_chi_square"] == 0
    tiny = compare(spark, 1, 0, 1, 1, 50)
    assert tiny["small_sample"] and tiny["lift_lower95"] < 0
    assert compare(spark, 900, 100, 100, 10, 50)["sample_ratio_mismatch"]
    assert not compare(spark, 900, 100, 100, 10, 10)["sample_ratio_mismatch"]
    edge = compare(spark, 100, 0, 100, 100, 50)
    assert edge["control_lower95"] == 0 and edge["treatment_upper95"] == 1
    for bad in ((1, 2, 1, 0, 50), (1, 0, 1, 0, 95)):
        with pytest.raises(Exception, match="must (lie|be)"):
            compare(spark, *bad)
    assert stats.Z95 == 1.95996398454


@pytest.mark.parametrize(
    ("title", "category", "stripped", "broken"),
    [
        ("  Camera  ", "Cameras", "Camera", ""),
        ("x" * 200, "c" * 64, "x" * 200, ""),
        ("📷" * 200, "c", "📷" * 200, ""),
        ("📷" * 201, "c", "📷" * 201, "title_length"),
        ("x" * 201, "c" * 65, "x" * 201, "title_length,category_length"),
        (None, "c", None, "title_length"),
        ("", "c", "", "title_length"),
        (" \t ", "c", "", "title_length"),
        ("a\u0007b", "c", "a\u0007b", "title_control"),
        ("a\u0085b", "c", "a\u0085b", "title_control"),
        (" a ", "c", "a ", ""),
        ("a\n", "c", "a", ""),
    ],
)
def test_catalog(spark, title, category, stripped, broken):
    df = spark.createDataFrame([("1", title, category)], "id STRING, title STRING, category STRING")
    row = quality.normalise_catalog(df).first()
    assert (row["title"], ",".join(row["violations"])) == (stripped, broken)


@pytest.mark.parametrize(
    ("query", "user", "limit", "experiment", "broken"),
    [
        ("camera", "user-1", 10, None, []),
        ("camera", "user-1", 51, None, ["limit"]),
        (" ", "user", 10, None, ["query"]),
        ("x" * 121, "user", 1, "exp", ["query"]),
        ("a\u0000", "user", 1, "exp", ["query"]),
        ("camera", "user@example.com", 10, None, ["user_id"]),
        ("camera", "user\n", 10, "exp/1", ["user_id", "experiment_id"]),
    ],
)
def test_search_input(spark, query, user, limit, experiment, broken):
    df = spark.createDataFrame([(query, user, limit, experiment)], "query STRING, user_id STRING, limit INT, experiment_id STRING")
    assert quality.with_violations(df, quality.request_rules()).first()["violations"] == broken


def test_name_uuid(spark):
    raw = bytearray(hashlib.md5(b"synthetic-ad-0").digest())
    raw[6], raw[8] = raw[6] & 0x0F | 0x30, raw[8] & 0x3F | 0x80
    assert value(spark, columns.name_uuid(F.lit("synthetic-ad-0"))) == str(uuid.UUID(bytes=bytes(raw)))


def test_tokens(spark):
    assert value(spark, text.tokens(F.lit("  Hello, wörld-42! hello"))) == ["hello", "wörld", "42", "hello"]
