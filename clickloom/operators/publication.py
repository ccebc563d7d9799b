"""Publishing feature snapshots, registering models, and checking deployments, for whole tables of requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions import text
from clickloom.functions.columns import instant
from clickloom.operators.evaluation import model_rules, promotion_eligible
from clickloom.operators.quality import classify_publication, snapshot_row_violations, snapshot_rules, with_violations

MODEL_CONTENT = (
    "schema_version", "feature_names", "means", "scales", "coefficients", "intercept", "trained_through", "validation_through",
    "evaluation_as_of", "training_rows", "validation_rows", "test_rows", "validation_log_loss", "baseline_validation_log_loss",
    "test_log_loss", "baseline_test_log_loss", "test_brier", "source_id",
)


def _content(*names: str) -> Column:
    return F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256)


def _rows_digest(features: DataFrame) -> DataFrame:
    """snapshot_id, _rows: a digest of each snapshot's counts as a set; nothing is gathered by snapshot."""
    row = F.xxhash64("ad_id", "impressions", "clicked_impressions")
    other = F.xxhash64("clicked_impressions", "impressions", "ad_id")
    sums = [F.sum(h.cast("decimal(38,0)")).cast("string") for h in (row, other)]
    return features.groupBy("snapshot_id").agg(F.concat_ws(":", *sums, F.count(F.lit(1)).cast("string")).alias("_rows"))


def publish_snapshots(requests: DataFrame, features: DataFrame, ads: DataFrame, existing: DataFrame, now) -> DataFrame:
    """``requests`` with ``publication``, ``reason``, ``content_hash`` and ``available_at``.

    requests: unique id, schema_version, window_start, cutoff, source_id; features: their snapshot_id,
    ad_id, impressions, clicked_impressions; existing: id, content_hash, available_at. A snapshot that
    breaks a rule is ``refused`` with the first reason; a known id is a ``replay`` or a ``conflict``, by
    content; the rest is ``created`` and available from ``now`` on, a replay since it was created.
    """
    checked = with_violations(requests, snapshot_rules(now))
    faults = snapshot_row_violations(features, ads)
    worst = faults.groupBy(F.col("snapshot_id").alias("id")).agg(F.min("problem").alias("_fault"))
    digests = _rows_digest(features).withColumnRenamed("snapshot_id", "id")
    joined = checked.join(worst, "id", "left").join(digests, "id", "left").withColumn(
        "content_hash", _content("id", "schema_version", "window_start", "cutoff", "source_id", "_rows")
    )
    classed = classify_publication(joined, existing).join(existing.select("id", F.col("available_at").alias("_since")), "id", "left")
    # Counts and repeats are faults of the request itself; whether ads exist is asked of new snapshots only.
    own = F.when(F.size("violations") > 0, F.col("violations")[0]).when(F.col("_fault").isin("counts", "repeated_ad"), F.col("_fault"))
    reason = F.coalesce(own, F.when(F.col("publication") == "created", F.col("_fault")))
    outcome = F.when(reason.isNotNull(), "refused").otherwise(F.col("publication"))
    return classed.select(
        *requests.columns, outcome.alias("publication"), reason.alias("reason"), "content_hash",
        F.when(outcome == "created", instant(now)).when(outcome == "replay", F.col("_since")).alias("available_at"),
    )


def register_models(models: DataFrame, existing: DataFrame, now) -> DataFrame:
    """version, publication, reason, content_hash, registered_at of each model with a unique version.

    existing: version, content_hash, registered_at. Rules first, with that against evaluations of the
    future; then created, replay or conflict by content.
    """
    checked = with_violations(models, model_rules(instant(now))).withColumn("content_hash", _content("version", *MODEL_CONTENT))
    classed = classify_publication(checked, existing, "version").join(
        existing.select("version", F.col("registered_at").alias("_since")), "version", "left"
    )
    reason = F.when(F.size("violations") > 0, F.col("violations")[0])
    outcome = F.when(reason.isNotNull(), "refused").otherwise(F.col("publication"))
    return classed.select(
        "version", outcome.alias("publication"), reason.alias("reason"), "content_hash",
        F.when(outcome == "created", instant(now)).when(outcome == "replay", F.col("_since")).alias("registered_at"),
    )


def deployment_violations(deployments: DataFrame, models: DataFrame) -> DataFrame:
    """``deployments`` with ``violations``: revision, percent, a percent without a model, a name that is no
    identifier, an unknown model, a model that did not beat its baseline."""
    known = models.select(F.col("version").alias("model_version"), promotion_eligible().alias("_eligible"))
    percent, model = F.col("rollout_percent"), F.col("model_version")
    rules = {
        "revision": F.col("revision").isNull() | (F.col("revision") < 0),
        "percent": percent.isNull() | ~percent.between(0, 100),
        "percent_without_model": model.isNull() & (percent != 0),
        "model_name": ~text.matches(model, text.IDENTIFIER),
        "unknown_model": model.isNotNull() & F.col("_eligible").isNull(),
        "gate": ~F.col("_eligible"),
    }
    return with_violations(deployments.join(known, "model_version", "left"), rules).select(*deployments.columns, "violations")
