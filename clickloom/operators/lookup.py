"""Lookups of facts in a table with one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.operators.quality import require_unique, unique_row_count
from clickloom.operators.skew import HOT_MIN_ROWS, HOT_SHARE, salted_join

BROADCAST_ROWS, BROADCAST_BYTES = 200_000, 32 << 20


def _json_bytes(df: DataFrame) -> int:
    """Size of the rows as text, to bound what a broadcast holds; only strings and nested values can be long."""
    wide = [name for name, kind in df.dtypes if kind in ("string", "binary") or "<" in kind]
    fixed = 16 * (len(df.columns) - len(wide))
    size = F.lit(fixed)
    if wide:
        size = size + F.length(F.to_json(F.struct(*wide)))
    return df.agg(F.coalesce(F.sum(size.cast("long")), F.lit(0))).first()[0]


def lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: Sequence[str] | str,
    *,
    unknown: dict[str, str] | None = None,
    broadcast_rows: int = BROADCAST_ROWS,
) -> DataFrame:
    """Left join that keeps every fact. The lookup must have unique, non-null keys.

    The check of the keys also counts the rows: up to ``broadcast_rows`` of them, and
    ``BROADCAST_BYTES`` as JSON text, are sent to all executors and the facts do not move; a larger
    table is joined by a shuffle, whose hot partitions adaptive execution splits.
    """
    keys = [on] if isinstance(on, str) else list(on)
    rows = unique_row_count(lookup, keys)
    small = rows <= broadcast_rows and _json_bytes(lookup) <= BROADCAST_BYTES
    joined = facts.join(F.broadcast(lookup) if small else lookup.hint("merge"), keys, "left")
    return joined.withColumns(
        {name: F.coalesce(F.col(name), F.lit(text)) for name, text in (unknown or {}).items()}
    )


def salted_lookup_join(
    facts: DataFrame,
    lookup: DataFrame,
    on: Sequence[str] | str,
    *,
    unknown: dict[str, str] | None = None,
    share: float = HOT_SHARE,
    min_rows: int = HOT_MIN_ROWS,
) -> DataFrame:
    """The shuffled form: hot keys are found by a sketch and salted, sort-merge joined."""
    keys = [on] if isinstance(on, str) else list(on)
    require_unique(lookup, keys)
    joined = salted_join(facts, lookup, keys, "left", share=share, min_rows=min_rows, hint="merge")
    return joined.withColumns(
        {name: F.coalesce(F.col(name), F.lit(text)) for name, text in (unknown or {}).items()}
    )
