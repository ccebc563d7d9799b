"""Assignment and intent-to-treat reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.functions import hashing, stats
from clickloom.functions.columns import instant, matured, ratio, visible
from clickloom.operators.attribution import occurs_within
from clickloom.operators.lookup import lookup_join
from clickloom.operators.quality import ContractError, require_unique
from clickloom.schemas import ATTRIBUTION_HOURS, MATURITY_HOURS


def assign(requests: DataFrame, experiments: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """New assignments: the first request of a user in an active experiment, never a second one.

    ``requests`` has experiment_id, user_id, created_at.
    """
    first = (
        requests.where(F.col("experiment_id").isNotNull())
        .groupBy("experiment_id", "user_id")
        .agg(F.min("created_at").alias("assigned_at"))
    )
    if existing is not None:
        first = first.join(existing.select("experiment_id", "user_id"), ["experiment_id", "user_id"], "left_anti")
    active = experiments.where("active").select(
        F.col("id").alias("experiment_id"), "salt", "treatment_percent"
    )
    return (
        lookup_join(first, active, "experiment_id")
        .where(F.col("salt").isNotNull())
        .select(
            "experiment_id",
            "user_id",
            hashing.arm(F.col("experiment_id"), F.col("salt"), F.col("user_id"), F.col("treatment_percent")).alias("arm"),
            "assigned_at",
        )
    )


def assigned_user_conversion(assignments: DataFrame, conversions: DataFrame, cutoff: str) -> DataFrame:
    """Unique users per arm with a complete 24-hour follow-up, and how many converted in it."""
    require_unique(assignments, "user_id")
    users = assignments.where(matured("assigned_ts", cutoff, ATTRIBUTION_HOURS))
    observed = conversions.where(visible("received_ts", cutoff, inclusive=False))
    flagged = occurs_within(
        users, observed, ["user_id"], start_ts="assigned_ts", event_ts="event_ts", unique=True, name="converted"
    )
    return (
        flagged.groupBy("arm")
        .agg(F.count(F.lit(1)).alias("assigned_users"), F.sum("converted").alias("converted_users"))
        .withColumn("conversion_rate", ratio("converted_users", "assigned_users"))
    )


def experiment_conversions(
    assignments: DataFrame, requests: DataFrame, impressions: DataFrame, clicks: DataFrame, as_of
) -> DataFrame:
    """Mature assigned users, each once, with ``converted`` 0 or 1.

    A click counts for the experiment and user of the request behind its impression.
    """
    cutoff = instant(as_of)
    tagged = (
        requests.where(F.col("experiment_id").isNotNull())
        .select(F.col("id").alias("request_id"), "experiment_id", "user_id")
    )
    exposures = (
        impressions.where(F.col("received_at") <= cutoff)
        .select(F.col("id").alias("impression_id"), "request_id")
        .join(tagged, "request_id")
    )
    acted = (
        clicks.where(F.col("received_at") <= cutoff)
        # Distinct first: one impression may carry a large share of the clicks.
        .select("impression_id", F.col("occurred_at").alias("click_at"))
        .distinct()
        .join(exposures, "impression_id")
        .select("experiment_id", "user_id", "click_at")
    )
    mature = assignments.where(matured("assigned_at", as_of, MATURITY_HOURS))
    return occurs_within(
        mature, acted, ["experiment_id", "user_id"], start_ts="assigned_at", event_ts="click_at",
        unique=True, name="converted",
    )


def experiment_report(
    experiments: DataFrame,
    assignments: DataFrame,
    requests: DataFrame,
    impressions: DataFrame,
    clicks: DataFrame,
    as_of,
    *,
    now=None,
) -> DataFrame:
    """One row per experiment: counts, rates, intervals, allocation check. All assigned users
    are in the denominator, seen or not."""
    if now is not None and as_of > now:
        raise ContractError("The cutoff lies in the future")
    flagged = experiment_conversions(assignments, requests, impressions, clicks, as_of)
    counts = flagged.groupBy(F.col("experiment_id").alias("id")).agg(
        *[
            F.sum(((F.col("arm") == arm) & keep).cast("long")).alias(f"{arm}_{what}")
            for arm in ("control", "treatment")
            for what, keep in (("users", F.lit(True)), ("converted", F.col("converted") == 1))
        ]
    )
    return compare_arms(experiments.join(counts, "id", "left").na.fill(0, [
        "control_users", "control_converted", "treatment_users", "treatment_converted"
    ]))


def compare_arms(arms: DataFrame) -> DataFrame:
    """Adds the interval estimates and checks to one row per experiment."""
    return arms.withColumns(
        stats.comparison(
            F.col("control_users"), F.col("control_converted"),
            F.col("treatment_users"), F.col("treatment_converted"), F.col("treatment_percent"),
        )
    )
