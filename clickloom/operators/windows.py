"""Rankings, latest versions and rolling calendar windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.functions.columns import ratio, visible


def top_per_group(df: DataFrame, group: Sequence[str], order: Sequence[Column], n: int, name: str = "rank") -> DataFrame:
    """First ``n`` rows per group. The limit is applied before the shuffle as well, so a group
    of any size sends at most ``n`` rows per map task."""
    w = Window.partitionBy(*group).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= n)


def top_ads_per_category(daily: DataFrame, *, n: int = 3, minimum: int = 1000) -> DataFrame:
    """The volume threshold comes before the ranking; ties go to the lower ad id."""
    eligible = daily.where(F.col("impressions") >= minimum).withColumn("ctr", ratio("clicked", "impressions"))
    return top_per_group(eligible, ["category"], [F.desc("ctr"), F.asc("ad_id")], n)


def latest_versions(events: DataFrame, cutoff: str, key: Sequence[str] = ("event_id",)) -> DataFrame:
    """Latest version per key among those received before the cutoff; deleted keys vanish.

    The tombstone is applied after the pick, or an older version would come back.
    """
    seen = events.where(visible("received_ts", cutoff, inclusive=False))
    order = [F.desc("version"), F.desc("received_ts"), F.desc("delivery_id")]
    return top_per_group(seen, key, order, 1, "_rn").drop("_rn").where(~F.col("is_deleted"))


def dense_calendar(daily: DataFrame, first_day: str, last_day: str, measures: Sequence[str]) -> DataFrame:
    """One row per ad and day of the calendar, zero where nothing happened.

    Measures of one ad and day are summed first. Then an ad's days fit a small map that the calendar is
    read from: the input is read and shuffled once, where a join with the calendar would do both twice.
    """
    daily = daily.groupBy("ad_id", "day").agg(*[F.sum(m).alias(m) for m in measures])
    first, last = F.lit(first_day).cast("date"), F.lit(last_day).cast("date")
    entry = F.struct(F.col("day"), F.struct(*measures).alias("_m"))
    by_ad = daily.groupBy("ad_id").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("day").between(first, last), entry))).alias("_days")
    )
    found = F.element_at("_days", F.col("day"))
    return by_ad.select("ad_id", "_days", F.explode(F.sequence(first, last)).alias("day")).select(
        "ad_id", "day", *[F.coalesce(found[m], F.lit(0)).alias(m) for m in measures]
    )


def rolling_ctr(daily: DataFrame, first_day: str, last_day: str, days: int = 7) -> DataFrame:
    """Ratio of sums over the last ``days`` calendar days. ``daily`` has one row per ad and day,
    so a window never exceeds the length of the calendar."""
    dense = dense_calendar(daily, first_day, last_day, ["impressions", "clicked"])
    w = Window.partitionBy("ad_id").orderBy("day").rowsBetween(-(days - 1), 0)
    return (
        dense.withColumn(f"impressions_{days}d", F.sum("impressions").over(w))
        .withColumn(f"clicked_{days}d", F.sum("clicked").over(w))
        .withColumn(f"ctr_{days}d", ratio(f"clicked_{days}d", f"impressions_{days}d"))
    )
