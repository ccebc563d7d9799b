"""Accepted events kept between batches, and classification of a batch against them.

Three append-only tables hold what was accepted: impressions and clicks by id, exposures by (request, ad). Each
is dealt by hash to buckets, one folder for each batch and bucket, so that a batch reads the buckets of its own
keys only and writes one folder of its own. What a batch sees are the batches before it: its outcome depends on
these and on itself, whatever was written later, so a batch that is processed again rewrites the same rows.
``compact`` merges all batches before one into a base.

Processing batches in order of receipt gives each delivery the outcome of one pass over all of them.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.operators import events

#: Table, the columns that find a row, and the schema.
TABLES = {
    "impressions": (("id",), "id string, request_id string, ad_id string, occurred_at timestamp_ntz, received_at timestamp_ntz, delivery_id long"),
    "exposures": (("request_id", "ad_id"), "request_id string, ad_id string"),
    "clicks": (("id",), "id string, impression_id string, occurred_at timestamp_ntz, received_at timestamp_ntz, delivery_id long"),
}
BUCKETS = 64
_EARLIER = "0001-01-01 00:00:00"


def _folders(spark: SparkSession, path: str) -> list[str]:
    """Names of the complete folders below ``path``: those whose writing ended."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = folder.getFileSystem(spark._jsc.hadoopConfiguration())
    if not files.exists(folder):
        return []
    names = [status.getPath().getName() for status in files.listStatus(folder) if status.isDirectory()]
    return sorted(n for n in names if files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{n}/_SUCCESS")))


@dataclass(frozen=True)
class EventStore:
    """The accepted events below ``path``, a folder that all executors share; ``buckets`` stays as first chosen."""

    spark: SparkSession
    path: str
    buckets: int = BUCKETS

    def _bucket(self, table: str) -> Column:
        return F.pmod(F.xxhash64(*TABLES[table][0]), F.lit(self.buckets)).cast("int")

    def read(self, table: str, before: int, buckets: list[int] | None = None) -> DataFrame:
        """Rows accepted by the batches before ``before``; of ``buckets`` only, if given.

        The latest base that ends at or before ``before`` and the batches from its end on.
        """
        schema = f"{TABLES[table][1]}, bucket int"
        names = _folders(self.spark, f"{self.path}/{table}")
        ends = [int(n[5:]) for n in names if n.startswith("base=") and int(n[5:]) <= before]
        base = max(ends, default=-1)
        batches = [f"{self.path}/{table}/{n}" for n in names if n.startswith("batch=") and base <= int(n[6:]) < before]
        parts = [self.spark.read.schema(schema).parquet(f"{self.path}/{table}/base={base}")] if ends else []
        if batches:
            read = self.spark.read.schema(f"{schema}, batch long").option("basePath", f"{self.path}/{table}")
            parts.append(read.parquet(*batches).drop("batch"))
        found = self.spark.createDataFrame([], schema)
        for part in parts:
            found = found.unionByName(part)
        # A filter on the folders' own column: other buckets are never listed as input.
        return found if buckets is None else found.where(F.col("bucket").isin(buckets))

    def held(self, table: str, keys: DataFrame, before: int) -> DataFrame:
        """Stored rows with a key of ``keys``. At most ``buckets`` numbers come to the driver, to prune folders."""
        columns = list(TABLES[table][0])
        wanted = keys.select(*columns).dropna().distinct()
        touched = sorted(r["_b"] for r in wanted.select(self._bucket(table).alias("_b")).distinct().collect())
        return self.read(table, before, touched).drop("bucket").join(wanted, columns, "left_semi")

    def append(self, table: str, rows: DataFrame, batch: int) -> None:
        """Writes what ``batch`` accepted, in place of what an earlier attempt at it wrote."""
        schema = [field.name for field in self.spark.createDataFrame([], TABLES[table][1]).schema]
        dealt = rows.select(*schema).withColumn("bucket", self._bucket(table)).repartition("bucket")
        dealt.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{table}/batch={batch}")

    def compact(self, before: int) -> None:
        """Merges what was accepted before ``before`` into one folder for each table.

        Readers take the base once it is complete; the batches in it stay until ``drop_compacted``.
        """
        for table in TABLES:
            rows = self.read(table, before)
            rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/{table}/base={before}")

    def drop_compacted(self, before: int) -> None:
        """Deletes batches and bases that the base up to ``before`` replaces; batches before it cannot be processed again."""
        for table in TABLES:
            names = _folders(self.spark, f"{self.path}/{table}")
            if f"base={before}" not in names:
                raise ValueError(f"{table} has no complete base up to batch {before}")
            for name in names:
                if int(name.partition("=")[2]) < before:
                    folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{table}/{name}")
                    folder.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(folder, True)


def _as_stored(rows: DataFrame, payload: list[str]) -> DataFrame:
    """Rows of the store as the classification knows them: accepted before anything that a batch brings."""
    at = F.struct(F.lit(_EARLIER).cast("timestamp_ntz").alias("received_at"), F.col("delivery_id"))
    return rows.select("id", at.alias("_at"), F.struct(*payload).alias("_payload"))


def _accepted(stored: DataFrame) -> DataFrame:
    return stored.select("id", "_payload.*", "_at.received_at", "_at.delivery_id")


def classify_impression_batch(store: EventStore, batch: int, deliveries: DataFrame, requests: DataFrame, results: DataFrame) -> DataFrame:
    """``deliveries`` with ``outcome`` and ``reason``, decided against the store; accepted ones are added to it.

    ``batch`` numbers rise in order of receipt. deliveries: delivery_id (unique), id, request_id, ad_id,
    occurred_at, received_at; requests and results as for ``checked_impressions``. An id that the store knows is a replay or a conflict even if its clock is wrong
    by now; an exposure that it knows is a conflict. An empty batch adds nothing.
    """
    payload = ["request_id", "ad_id", "occurred_at"]
    checked = events.checked_impressions(deliveries, requests, results)
    known = _as_stored(store.held("impressions", checked, batch), payload)
    taken = store.held("exposures", checked.where("problem IS NULL"), batch)
    edges = events.distinct_edges(checked).join(known.select("id"), "id", "left_anti").join(taken, ["request_id", "ad_id"], "left_anti")
    won = events.first_deliveries(edges)
    new = _accepted(won)
    store.append("impressions", new, batch)
    store.append("exposures", new, batch)
    return events.outcomes(checked, known.unionByName(won), payload, F.lit("exposure"))


def classify_click_batch(store: EventStore, batch: int, deliveries: DataFrame) -> DataFrame:
    """``deliveries`` of clicks decided against the store, whose impressions of this batch are already in it.

    deliveries: delivery_id (unique), id, impression_id, occurred_at, received_at.
    """
    payload = ["impression_id", "occurred_at"]
    shown = store.held("impressions", deliveries.select(F.col("impression_id").alias("id")), batch + 1)
    checked = events.checked_clicks(deliveries, shown)
    known = _as_stored(store.held("clicks", checked, batch), payload)
    won = events.first_clicks(checked.join(known.select("id"), "id", "left_anti"))
    store.append("clicks", _accepted(won), batch)
    return events.outcomes(checked, known.unionByName(won), payload, F.lit("event_id"))
