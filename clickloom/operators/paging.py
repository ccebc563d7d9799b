"""Ordered pages and dense positions over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.session import cut_lineage


def keyset_page(df: DataFrame, key: str, after=None, size: int = 1000) -> DataFrame:
    """The ``size`` rows after ``after`` in key order, with ``next_after``: the last key of the page
    if there is more, else NULL. The ordered limit never sorts the whole table."""
    if not 1 <= size <= 5000:
        raise ValueError("Page size must be 1-5000")
    rows = df if after is None else df.where(F.col(key) > F.lit(after))
    probe = rows.orderBy(key).limit(size + 1)
    w = Window.orderBy(key)
    everything = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    # At most size + 1 rows reach this window.
    return (
        probe.withColumn("_n", F.row_number().over(w))
        .withColumn("_more", F.count(F.lit(1)).over(everything) > size)
        .withColumn("_last", F.max(F.when(F.col("_n") <= size, F.col(key))).over(everything))
        .where(F.col("_n") <= size)
        .withColumn("next_after", F.when(F.col("_more"), F.col("_last")))
        .drop("_n", "_more", "_last")
    )


def with_dense_index(df: DataFrame, key: str, name: str = "index") -> DataFrame:
    """0-based position of each row in the order of a unique key.

    The table is range-sorted once and kept; a row's position is its place in its partition plus
    the rows of the partitions before. Only one count per partition is ever brought together.
    """
    ordered = cut_lineage(df.orderBy(key).withColumn("_place", F.monotonically_increasing_id()))
    part = F.shiftright("_place", 33).alias("_part")
    offsets = (
        ordered.groupBy(part)
        .agg(F.count(F.lit(1)).alias("_rows"))
        .withColumn(
            "_before",
            F.coalesce(
                F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
            ),
        )
        .select("_part", "_before")
    )
    return (
        ordered.withColumn("_part", F.shiftright("_place", 33))
        .join(F.broadcast(offsets), "_part")
        .withColumn(name, F.col("_before") + F.col("_place").bitwiseAND((1 << 33) - 1))
        .drop("_part", "_place", "_before")
    )


def with_page_number(df: DataFrame, key: str, size: int, name: str = "page") -> DataFrame:
    """The keyset page each row falls on when all pages are read."""
    if not 1 <= size <= 5000:
        raise ValueError("Page size must be 1-5000")
    return (
        with_dense_index(df, key, "_index")
        .withColumn(name, F.floor(F.col("_index") / size).cast("long"))
        .drop("_index")
    )


def latest_models(models: DataFrame, n: int = 100) -> DataFrame:
    return models.orderBy(F.desc("registered_at"), "version").limit(n)


def deployment_history(deployments: DataFrame, n: int = 100) -> DataFrame:
    return deployments.orderBy(F.desc("revision")).limit(n)
