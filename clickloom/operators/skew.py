"""Joins that stay balanced when one key holds a large share of the rows.

Most operators rely on the skew handling of adaptive execution: it splits an oversized shuffle
partition of a sort-merge join by map output and costs no extra pass. It needs a fresh shuffle on
both sides, so a side that was just grouped by the join keys is keyed by an expression there, which
makes Spark shuffle the (reduced) groups once more. The join below is for facts read from a table:
it finds hot keys beforehand and salts them, whatever the settings of the session are.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HOT_SHARE = 1 / 2000
HOT_MIN_ROWS = 100_000
_TRACKED = 20_000


def hot_keys(
    df: DataFrame, keys: Sequence[str], *, share: float = HOT_SHARE, min_rows: int = HOT_MIN_ROWS
) -> DataFrame:
    """Hashes of the keys with more than ``share`` of all rows, and how many salts each needs.

    A frequent-items sketch finds them in one narrow pass without a shuffle of the keys. There
    are at most ``1 / share`` of them, whatever the data, so the result may be broadcast. A hash
    collision or a sketch error only moves a salt count, never a result.
    """
    limit = int(1 / share)
    sketch = df.select(F.xxhash64(*keys).alias("_key")).agg(
        F.expr(f"approx_top_k(_key, {limit}, {_TRACKED})").alias("_top"), F.count(F.lit(1)).alias("_n")
    )
    bound = F.greatest(F.col("_n") * share, F.lit(float(min_rows)))
    return (
        sketch.select(F.explode("_top").alias("_item"), bound.alias("_bound"))
        .where(F.col("_item.count") > F.col("_bound"))
        .select(
            F.col("_item.item").alias("_hot"),
            F.ceil(F.col("_item.count") / F.col("_bound")).cast("int").alias("_salts"),
        )
    )


def row_salt(columns: Sequence[str | Column], salts: Column) -> Column:
    """A salt that a retried task computes again: no random numbers, no row order.

    The partition number spreads rows that are copies of each other.
    """
    return F.pmod(F.pmod(F.xxhash64(*columns), salts) + F.spark_partition_id(), salts).cast("int")


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str],
    how: str = "left",
    *,
    share: float = HOT_SHARE,
    min_rows: int = HOT_MIN_ROWS,
    hint: str | None = None,
) -> DataFrame:
    """Equi join for a ``left`` with hot keys; same rows as a plain join.

    Rows of a hot key on the left are spread over salts, the matching rows on the right are
    repeated once per salt. With one right row per key this repeats at most ``2 / share`` rows.
    """
    if how not in ("left", "inner", "left_semi", "left_anti"):
        raise ValueError(f"Unsupported join type: {how}")
    keys = list(on)
    hot = F.broadcast(hot_keys(left, keys, share=share, min_rows=min_rows))

    def marked(df: DataFrame) -> DataFrame:
        return df.withColumn("_hot", F.xxhash64(*keys)).join(hot, "_hot", "left").drop("_hot")

    spread = marked(left).withColumn(
        "_salt", F.when(F.col("_salts").isNull(), F.lit(0)).otherwise(row_salt(left.columns, F.col("_salts")))
    ).drop("_salts")
    copies = marked(right).withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_salts"), F.lit(1)) - 1))
    ).drop("_salts")
    if hint:
        spread, copies = spread.hint(hint), copies.hint(hint)
    return spread.join(copies, [*keys, "_salt"], how).drop("_salt")
