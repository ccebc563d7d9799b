"""Daily counts of mature impressions kept up to date by what a period brought, instead of relabelling all history.

An impression counts from the moment at which it has arrived and its follow-up is over. A period ``(since,
until]`` changes the counts in two ways: impressions begin to count in it, with the label known at its end, and
clicks that arrive in it turn labels of impressions that counted before. Both are rows of a delta, which is
added to the counts by day and ad. Deltas of consecutive periods add up to the counts of one pass; retracted
impressions are a delta with the signs turned round, so a delta may be negative.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions.columns import hours, instant
from clickloom.operators.attribution import mature_impressions, occurs_within
from clickloom.schemas import ATTRIBUTION_HOURS, MATURITY_HOURS

KEY = ["id"]


def _counts(labelled: DataFrame) -> DataFrame:
    return labelled.groupBy(F.to_date("occurred_at").alias("day"), "ad_id").agg(
        F.count(F.lit(1)).alias("impressions"), F.sum("label").cast("long").alias("clicked_impressions")
    )


def counted_at() -> Column:
    """When an impression begins to count."""
    return F.greatest(F.col("received_at"), F.col("occurred_at") + hours(MATURITY_HOURS))


def daily_counts_as_of(impressions: DataFrame, clicks: DataFrame, as_of) -> DataFrame:
    """``day, ad_id, impressions, clicked_impressions`` in one pass. impressions: id (unique), ad_id, occurred_at,
    received_at; clicks: impression_id, occurred_at, received_at."""
    return _counts(mature_impressions(impressions, clicks, as_of))


def _clicked(impressions: DataFrame, clicks: DataFrame, until, name: str) -> DataFrame:
    seen = clicks.where(F.col("received_at") <= instant(until)).select(
        F.col("impression_id").alias("id"), F.col("occurred_at").alias("_click_at")
    )
    return occurs_within(impressions, seen, KEY, start_ts="occurred_at", event_ts="_click_at", unique=True, name=name)


def daily_delta(impressions: DataFrame, clicks: DataFrame, since, until, *, lateness_hours: int | None = None) -> DataFrame:
    """What ``(since, until]`` adds to the counts by day and ad; same columns as the counts.

    ``lateness_hours``: where events are accepted only if they arrive within so many hours and not before they
    occur, as the event contract has it. Then nothing received before the follow-up of ``since`` can matter,
    and a table partitioned by the day of receipt is read from there on. Without it late clicks may belong to
    any impression: those are found by the clicks that arrived, and read back to the first of them only.
    """
    lower = instant(since) - hours(MATURITY_HOURS) if lateness_hours is not None else None
    if lower is not None:
        impressions, clicks = impressions.where(F.col("received_at") > lower), clicks.where(F.col("received_at") > lower)
    begun = counted_at()
    fresh = impressions.where((begun > instant(since)) & (begun <= instant(until)))
    delta = _counts(_clicked(fresh, clicks, until, "label"))
    if lateness_hours is not None and lateness_hours <= MATURITY_HOURS - ATTRIBUTION_HOURS:
        # A click on an impression that counts already would have come after its lateness.
        return delta
    arrived = clicks.where((F.col("received_at") > instant(since)) & (F.col("received_at") <= instant(until)))
    first = arrived.agg(F.min("occurred_at")).first()[0]
    if first is None:
        return delta
    touched = impressions.where(
        (begun <= instant(since)) & (F.col("occurred_at") > F.lit(first) - hours(ATTRIBUTION_HOURS))
    ).join(arrived.select(F.col("impression_id").alias("id")), "id", "left_semi")
    turned = _clicked(_clicked(touched, clicks, since, "_before"), clicks, until, "_after").where("_before < _after")
    flips = turned.groupBy(F.to_date("occurred_at").alias("day"), "ad_id").agg(
        F.lit(0).cast("long").alias("impressions"), F.count(F.lit(1)).alias("clicked_impressions")
    )
    return add_counts(delta, flips)


def retraction(impressions: DataFrame, clicks: DataFrame, until) -> DataFrame:
    """The delta that takes ``impressions``, which no longer hold, out of counts as of ``until``."""
    taken = daily_counts_as_of(impressions, clicks, until)
    return taken.withColumns({c: -F.col(c) for c in ("impressions", "clicked_impressions")})


def add_counts(counts: DataFrame, delta: DataFrame) -> DataFrame:
    """Counts and delta added by day and ad; what adds up to nothing is left out."""
    return (
        counts.unionByName(delta).groupBy("day", "ad_id")
        .agg(F.sum("impressions").alias("impressions"), F.sum("clicked_impressions").alias("clicked_impressions"))
        .where("impressions <> 0 OR clicked_impressions <> 0")
    )
