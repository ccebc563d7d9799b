"""Point-in-time lookups: what was known, and available, at a given instant."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clickloom.functions.columns import epoch_micros


def asof_join(
    left: DataFrame,
    history: DataFrame,
    on: Sequence[str],
    *,
    left_ts: str,
    clocks: Sequence[str],
    order: Sequence[str],
    values: Sequence[str],
    slot_minutes: int = 1,
) -> DataFrame:
    """Adds to each row of ``left`` the values of its latest history record.

    A record counts once all of its ``clocks`` are at or before ``left_ts``; the latest is the
    greatest by ``order``. Rows without history keep NULL. No pair of a row and a record is
    formed: a record becomes known at the greatest of its clocks, and the answer is a running
    maximum over time. Every key is cut into time slots: the maximum runs inside a slot, and the
    maxima of the earlier slots, one row each, are carried in. Instants are made distinct first.
    So however hot a key is, with slots of one minute a task sees at most 60 million distinct
    microseconds of it, and half a million carried rows per year. With no key at all (``on`` empty)
    the carried rows of the whole table meet in one task: that is bounded by the minutes of the
    calendar, at most 1.1 million small rows a year whatever the size of either side.
    """
    keys = list(on)
    width = slot_minutes * 60_000_000
    known = F.greatest(*[F.col(c) for c in clocks]) if len(clocks) > 1 else F.col(clocks[0])
    complete = F.lit(True)
    for clock in clocks:
        complete = complete & F.col(clock).isNotNull()
    payload = F.struct(*[F.col(c) for c in order], *[F.col(c).alias(f"_v_{c}") for c in values])
    slot = F.floor(epoch_micros("_t") / F.lit(width)).cast("long")

    records = (
        history.where(complete)
        .select(*keys, known.alias("_t"), payload.alias("_rec"))
        .groupBy(*keys, "_t")
        .agg(F.max("_rec").alias("_rec"))
        .withColumn("_slot", slot)
    )
    by_slot = records.groupBy(*keys, "_slot").agg(F.max("_rec").alias("_rec"))
    instants = left.select(*keys, F.col(left_ts).alias("_t")).distinct().withColumn("_slot", slot)
    points = instants.withColumn("_rec", F.lit(None).cast(records.schema["_rec"].dataType)).withColumn(
        "_ask", F.lit(1)
    )
    timeline = points.unionByName(records.withColumn("_ask", F.lit(0)))
    running = Window.partitionBy(*keys, "_slot").orderBy("_t", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    inside = timeline.withColumn("_rec", F.max("_rec").over(running)).where("_ask = 1").drop("_ask")

    slots = _carry_in(instants.select(*keys, "_slot").distinct(), by_slot, keys)
    answered = inside.join(slots, [*keys, "_slot"], "left").select(
        *keys, F.col("_t").alias(left_ts), F.greatest("_rec", "_carry").alias("_rec")
    )
    joined = left.join(answered, [*keys, left_ts], "left")
    return joined.select(
        *[F.col(c) for c in left.columns], *[F.col(f"_rec._v_{c}").alias(c) for c in values]
    )


def _carry_in(slots: DataFrame, by_slot: DataFrame, keys: list[str]) -> DataFrame:
    """For each asked slot of a key: the greatest record of all earlier slots."""
    empty = F.lit(None).cast(by_slot.schema["_rec"].dataType)
    asked = slots.withColumn("_rec", empty).withColumn("_ask", F.lit(1))
    # An asked slot sorts before the records of the same slot, so only earlier slots are carried.
    w = (
        Window.partitionBy(*keys)
        .orderBy("_slot", F.desc("_ask"))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        asked.unionByName(by_slot.withColumn("_ask", F.lit(0)))
        .withColumn("_carry", F.max("_rec").over(w))
        .where("_ask = 1")
        .select(*keys, "_slot", "_carry")
    )
