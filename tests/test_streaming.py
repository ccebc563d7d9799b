"""The streaming jobs against the batch operators on the same events."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from clickloom.operators import attribution
from clickloom.plans import views
from clickloom.streaming import jobs

from .conftest import SF, rows


def write_days(df, ts, path):
    """One file per day and one more copy of each day: repeated deliveries, in order of time."""
    days = [r[0] for r in df.select(F.to_date(ts)).distinct().orderBy(1).collect()]
    for day in days:
        part = df.where(F.to_date(ts) == F.lit(day)).coalesce(1)
        part.unionByName(part).coalesce(1).write.mode("append").parquet(path)


def test_labels_and_daily_ctr(spark, tmp_path):
    shown = views.served_impressions(spark, SF).select(
        F.col("id").alias("impression_id"), "ad_id", F.col("occurred_at").cast("timestamp").alias("impression_ts")
    ).persist()
    acted = views.served_clicks(spark, SF).select(
        F.col("id").alias("click_id"), "impression_id", F.col("occurred_at").cast("timestamp").alias("click_ts")
    ).persist()
    write_days(shown, "impression_ts", f"{tmp_path}/i")
    write_days(acted, "click_ts", f"{tmp_path}/c")

    def source(name, schema):
        return spark.readStream.schema(schema).option("maxFilesPerTrigger", 3).parquet(f"{tmp_path}/{name}")

    labels = jobs.mature_labels(source("i", shown.schema), source("c", acted.schema))
    jobs.run_available(labels, f"{tmp_path}/labels", f"{tmp_path}/labels-state")
    got = {r["impression_id"]: r["label"] for r in spark.read.parquet(f"{tmp_path}/labels").collect()}
    batch = attribution.occurs_within(
        shown, acted, ["impression_id"], start_ts="impression_ts", event_ts="click_ts", unique=True, name="label"
    ).collect()
    expected = {r["impression_id"]: r["label"] for r in batch}
    end = min(shown.agg(F.max("impression_ts")).first()[0], acted.agg(F.max("click_ts")).first()[0])
    assert spark.read.parquet(f"{tmp_path}/labels").count() == len(got)
    assert all(expected[i] == label for i, label in got.items())
    open_still = {r["impression_id"] for r in batch if r["impression_ts"] + dt.timedelta(hours=25) > end}
    assert set(expected) - set(got) <= open_still

    # A second run over the same checkpoint finds nothing new.
    jobs.run_available(labels, f"{tmp_path}/labels", f"{tmp_path}/labels-state")
    assert spark.read.parquet(f"{tmp_path}/labels").count() == len(got)

    daily = jobs.daily_ctr(jobs.mature_labels(source("i", shown.schema), source("c", acted.schema)))
    jobs.run_available(daily, f"{tmp_path}/daily", f"{tmp_path}/daily-state")
    emitted = rows(spark.read.parquet(f"{tmp_path}/daily"), "day", "ad_id", "impressions", "clicked")
    totals = {}
    for r in batch:
        day = r["impression_ts"].date()
        n, c = totals.get((day, r["ad_id"]), (0, 0))
        totals[day, r["ad_id"]] = (n + 1, c + r["label"])
    assert emitted and all(totals[d, a] == (n, c) for d, a, n, c in emitted)
    done = {k for k in totals if dt.datetime.combine(k[0], dt.time()) + dt.timedelta(hours=49) <= end}
    assert done <= {(d, a) for d, a, _, _ in emitted}
