"""Structured Streaming: classified and deduplicated ingest, mature labels, daily click-through rate.

Watermarks bound all state: one hour of lateness plus, for labels, the 24-hour attribution window,
which together are the 25-hour maturity rule.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.functions.columns import ratio
from clickloom.operators.event_store import BUCKETS, EventStore, classify_click_batch, classify_impression_batch
from clickloom.schemas import ATTRIBUTION_HOURS, LATENESS_HOURS
from clickloom.session import ROCKSDB


def ingest(events: DataFrame, *, event_ts: str, key: str) -> DataFrame:
    """Drops repeated deliveries of an id; later events than the lateness are dropped."""
    return events.withWatermark(event_ts, f"{LATENESS_HOURS} hours").dropDuplicatesWithinWatermark([key])


def mature_labels(impressions: DataFrame, clicks: DataFrame) -> DataFrame:
    """Each impression once with ``label`` 1 at its first attributed click, or 0 after the window.

    impressions: impression_id, impression_ts, any others; clicks: click_id, impression_id,
    click_ts. A click meets the one impression it names. A positive comes out when its click is
    seen; reports over closed ranges must still apply the maturity rule.
    """
    shown = ingest(impressions, event_ts="impression_ts", key="impression_id")
    acted = ingest(clicks, event_ts="click_ts", key="click_id").select(
        F.col("impression_id").alias("_key"), F.col("click_ts").alias("_click_ts")
    )
    within = F.expr(
        "impression_id = _key AND _click_ts >= impression_ts "
        f"AND _click_ts < impression_ts + INTERVAL {ATTRIBUTION_HOURS} HOURS"
    )
    joined = shown.join(acted, within, "left_outer")
    return (
        joined.withColumn("label", F.col("_click_ts").isNotNull().cast("int"))
        .drop("_key", "_click_ts")
        .dropDuplicatesWithinWatermark(["impression_id"])
    )


def daily_ctr(labels: DataFrame) -> DataFrame:
    """Per day and ad; a day comes out once the watermark has passed its end."""
    return (
        labels.groupBy(F.window("impression_ts", "1 day"), "ad_id")
        .agg(F.count(F.lit(1)).alias("impressions"), F.sum("label").alias("clicked"))
        .select(
            F.to_date("window.start").alias("day"), "ad_id", "impressions", "clicked",
            ratio("clicked", "impressions").alias("ctr"),
        )
    )


def run_available(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Processes what is there and stops; exactly once into Parquet. State lives in RocksDB, not on the heap."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    query = (
        stream.writeStream.format("parquet").outputMode("append")
        .option("path", path).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()


IMPRESSION = ("delivery_id", "id", "request_id", "ad_id", "occurred_at", "received_at")
CLICK = ("delivery_id", "id", "impression_id", "occurred_at", "received_at")


def classify_available(
    deliveries: DataFrame, requests: DataFrame, results: DataFrame, *, store: str, outcomes: str, checkpoint: str, buckets: int = BUCKETS
) -> None:
    """Classifies what is there of a stream of deliveries against the event store below ``store``, and stops.

    deliveries: event_type (impression or click), delivery_id (unique for each type) and the fields of both.
    Each micro-batch writes event_type, delivery_id, id, outcome and reason to its own folder of ``outcomes``;
    store and outcomes of a micro-batch that runs again after a failure are replaced by the same rows. Nothing
    is dropped: a repeat is a replay or a conflict however late it comes, as in the batch form.
    """

    def process(batch: DataFrame, number: int) -> None:
        kept = EventStore(batch.sparkSession, store, buckets)
        shown = classify_impression_batch(kept, number, batch.where("event_type = 'impression'").select(*IMPRESSION), requests, results)
        acted = classify_click_batch(kept, number, batch.where("event_type = 'click'").select(*CLICK))
        both = None
        for kind, found in (("impression", shown), ("click", acted)):
            found = found.select(F.lit(kind).alias("event_type"), "delivery_id", "id", "outcome", "reason")
            both = found if both is None else both.unionByName(found)
        both.write.mode("overwrite").parquet(f"{outcomes}/batch={number}")

    query = deliveries.writeStream.foreachBatch(process).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
