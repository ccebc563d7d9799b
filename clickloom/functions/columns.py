"""Ratios, clocks and visibility rules."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F


def as_col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def instant(value: datetime | str | Column) -> Column:
    """A cutoff as a column: text stays comparable with both timestamp types."""
    if isinstance(value, Column):
        return value
    if isinstance(value, datetime) and value.tzinfo is not None:
        return F.lit(value)
    return F.lit(str(value)).cast("timestamp_ntz")


def hours(n: int) -> Column:
    return F.expr(f"INTERVAL {int(n)} HOURS")


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """NULL, not an error, where the denominator is zero."""
    den = as_col(denominator)
    return F.when(den > 0, as_col(numerator).cast("double") / den)


def visible(received: Column | str, cutoff, *, inclusive: bool) -> Column:
    """Receipt visibility. Reports over a closed cutoff include it, daily cohorts exclude it."""
    return as_col(received) <= instant(cutoff) if inclusive else as_col(received) < instant(cutoff)


def matured(start: Column | str, as_of, n_hours: int) -> Column:
    """The follow-up of ``n_hours`` is complete at ``as_of``."""
    return as_col(start) + hours(n_hours) <= instant(as_of)


def between(ts: Column | str, start, end) -> Column:
    """Half-open event-time range."""
    return (as_col(ts) >= instant(start)) & (as_col(ts) < instant(end))


def epoch_micros(ts: Column | str) -> Column:
    """Microseconds since the epoch; the session time zone is UTC by contract."""
    return F.unix_micros(as_col(ts).cast("timestamp"))


def clamp(value: Column | str, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), as_col(value)))


def name_uuid(name: Column) -> Column:
    """A version-3 UUID from the MD5 of a name."""
    h = F.md5(name.cast("binary"))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat_ws(
        "-",
        F.substring(h, 1, 8),
        F.substring(h, 9, 4),
        F.concat(F.lit("3"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)),
        F.substring(h, 21, 12),
    )
