"""Clicked-impression attribution and the reports on top of it.

An attributed event is an existence test over ``[start, start + window)``, never a join that
multiplies rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.functions.columns import between, epoch_micros, hours, matured, ratio, visible
from clickloom.operators.quality import check_report_range
from clickloom.schemas import ATTRIBUTION_HOURS, MATURITY_HOURS


def occurs_within(
    starts: DataFrame,
    events: DataFrame,
    on: Sequence[str],
    *,
    start_ts: str,
    event_ts: str,
    window_hours: int = ATTRIBUTION_HOURS,
    unique: bool = False,
    name: str = "clicked",
) -> DataFrame:
    """Adds to every row of ``starts`` whether an event of the same key falls into its window.

    Time is cut into slots as wide as the window. A window that begins in slot b can only hold
    events of slot b (then the last one there is at or after the start) or of slot b + 1 (then
    the first one there is before the end). So two extremes per key and slot decide exactly:
    events are reduced on the map side, no pair of a start and an event is ever formed, and the
    output has the rows of ``starts``. Extremes are grouped by the slot before and joined by that
    plus one, so that both sides of the join are shuffled for it and adaptive execution can split
    the hot keys of ``starts``. ``unique`` says that ``starts`` has one row per key; then the
    grouping is the partitioning of the join and the extremes move only once.
    """
    width = window_hours * 3_600_000_000
    keys = list(on)

    def slot(ts: str):
        return F.floor(epoch_micros(ts) / F.lit(width)).cast("long")

    shift = 0 if unique else 1
    own = F.col("_own") - shift
    moments = events.select(*keys, F.col(event_ts).alias("_ts"), slot(event_ts).alias("_own")).select(
        *keys,
        F.inline(
            F.array(
                F.struct(own.alias("_group"), F.col("_ts").alias("_same"), F.lit(None).alias("_next")),
                F.struct((own - 1).alias("_group"), F.lit(None).alias("_same"), F.col("_ts").alias("_next")),
            )
        ),
    )
    reduced = moments.groupBy(*keys, "_group").agg(
        F.max("_same").alias("_last_same"), F.min("_next").alias("_first_next")
    )
    extremes = reduced.withColumn("_slot", F.col("_group") + shift if shift else F.col("_group")).drop("_group")
    joined = starts.withColumn("_slot", slot(start_ts)).join(extremes, [*keys, "_slot"], "left")
    hit = F.coalesce(F.col("_last_same") >= F.col(start_ts), F.lit(False)) | F.coalesce(
        F.col("_first_next") < F.col(start_ts) + hours(window_hours), F.lit(False)
    )
    return joined.select(*[F.col(c) for c in starts.columns], hit.cast("int").alias(name))


def eligible_impressions(impressions: DataFrame, day: str, cutoff: str, last_day: str | None = None) -> DataFrame:
    """Impressions of a day (or of days up to ``last_day``) received before the cutoff."""
    date = F.to_date("impression_ts")
    return impressions.where(
        date.between(F.lit(day).cast("date"), F.lit(last_day or day).cast("date"))
        & visible("received_ts", cutoff, inclusive=False)
    )


def clicked_impression_ctr(
    impressions: DataFrame,
    clicks: DataFrame,
    *,
    day: str,
    cutoff: str,
    last_day: str | None = None,
    on: Sequence[str] = ("impression_id",),
) -> DataFrame:
    """Per ad: eligible impressions, those with an attributed click, and their ratio."""
    cohort = eligible_impressions(impressions, day, cutoff, last_day)
    observed = clicks.where(visible("received_ts", cutoff, inclusive=False))
    flagged = occurs_within(
        cohort, observed, on, start_ts="impression_ts", event_ts="click_ts",
        unique=tuple(on) == ("impression_id",),
    )
    totals = flagged.groupBy("ad_id").agg(
        F.count(F.lit(1)).alias("impressions"), F.sum("clicked").alias("clicked")
    )
    return totals.withColumn("ctr", ratio("clicked", "impressions"))


CTR_SQL = """
WITH cohort AS (
  SELECT * FROM {impressions}
  WHERE CAST(impression_ts AS DATE) BETWEEN CAST(:day AS DATE) AND CAST(:last_day AS DATE)
    AND received_ts < CAST(:cutoff AS TIMESTAMP_NTZ)
), days AS (
  SELECT {on}, CAST(click_ts AS DATE) AS day, min(click_ts) AS first, max(click_ts) AS last
  FROM {clicks} WHERE received_ts < CAST(:cutoff AS TIMESTAMP_NTZ)
  GROUP BY {on}, CAST(click_ts AS DATE)
), flagged AS (
  SELECT ad_id, EXISTS (
      SELECT 1 FROM days c
      WHERE c.{on} = i.{on}
        AND (c.day = CAST(i.impression_ts AS DATE) AND c.last >= i.impression_ts
          OR c.day = date_add(CAST(i.impression_ts AS DATE), 1) AND c.first < i.impression_ts + INTERVAL 24 HOURS)) AS hit
  FROM cohort i
)
SELECT ad_id, count(*) AS impressions, count_if(hit) AS clicked,
       CAST(count_if(hit) AS DOUBLE) / count(*) AS ctr
FROM flagged GROUP BY ad_id
"""


def clicked_impression_ctr_sql(
    impressions: DataFrame,
    clicks: DataFrame,
    *,
    day: str,
    cutoff: str,
    last_day: str | None = None,
    on: str = "impression_id",
) -> DataFrame:
    """The same report as SQL text; ``EXISTS`` becomes an existence join on the click identifiers.

    Of an impression's clicks a row per day is left before the join: its last click decides for the
    impression's own day, the first one for the day after. So a flood of clicks on one impression stays
    with the tasks that read it.
    Use it where impressions are unique by ``on``; the DataFrame form also bears hot keys.
    """
    return impressions.sparkSession.sql(
        CTR_SQL.replace("{on}", on),
        args={"day": day, "last_day": last_day or day, "cutoff": cutoff},
        impressions=impressions,
        clicks=clicks,
    )


def mature_impressions(
    impressions: DataFrame,
    clicks: DataFrame,
    as_of,
    *,
    on: Sequence[tuple[str, str]] = (("id", "impression_id"),),
    unique: bool = True,
) -> DataFrame:
    """Impressions whose label is final at ``as_of``, each once, with ``label`` 0 or 1."""
    mature = impressions.where(
        visible("received_at", as_of, inclusive=True) & matured("occurred_at", as_of, MATURITY_HOURS)
    )
    seen = clicks.where(visible("received_at", as_of, inclusive=True)).select(
        *[F.col(theirs).alias(ours) for ours, theirs in on], F.col("occurred_at").alias("_click_at")
    )
    return occurs_within(
        mature, seen, [ours for ours, _ in on], start_ts="occurred_at", event_ts="_click_at",
        unique=unique, name="label",
    )


def mature_ctr_report(
    impressions: DataFrame, clicks: DataFrame, start: datetime, end: datetime, as_of: datetime,
    *, now: datetime | None = None,
) -> DataFrame:
    """Per ad over mature impressions in ``[start, end)``, ordered by ad."""
    check_report_range(start, end, as_of, now)
    in_range = impressions.where(between("occurred_at", start, end))
    return (
        mature_impressions(in_range, clicks, as_of)
        .groupBy("ad_id")
        .agg(F.count(F.lit(1)).alias("impressions"), F.sum("label").alias("clicked_impressions"))
        .withColumn("ctr", ratio("clicked_impressions", "impressions"))
        .orderBy("ad_id")
    )


def pooled_ctr(batches: DataFrame) -> DataFrame:
    """Counts are summed before dividing; overflow is an error under ANSI arithmetic."""
    return (
        batches.groupBy("ad_id")
        .agg(F.sum("clicked").alias("clicked"), F.sum("impressions").alias("impressions"))
        .withColumn("ctr", ratio("clicked", "impressions"))
    )


def window_counts(examples: DataFrame, start=None, cutoff=None) -> DataFrame:
    """Per ad: impressions and clicked impressions with an impression time in ``[start, cutoff)``."""
    rows = examples if start is None else examples.where(between("impressionTime", start, cutoff))
    return rows.groupBy("adId").agg(
        F.count(F.lit(1)).alias("impressions"), F.sum("label").cast("long").alias("clickedImpressions")
    )


def daily_counts(examples: DataFrame, start=None, cutoff=None) -> DataFrame:
    rows = examples if start is None else examples.where(between("impressionTime", start, cutoff))
    return rows.groupBy(F.to_date("impressionTime").alias("eventDate"), "adId").agg(
        F.count(F.lit(1)).alias("impressions"), F.sum("label").cast("long").alias("clickedImpressions")
    )
