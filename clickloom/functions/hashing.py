"""Stable buckets for experiments and rollouts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bucket(*parts: Column) -> Column:
    """0..9999 from the SHA-256 of the length-prefixed parts, so that ("a","bc") differs from ("ab","c")."""
    pieces: list[Column] = []
    for part in parts:
        text = part.cast("string")
        pieces += [F.length(text).cast("string"), F.lit(":"), text]
    digest = F.sha2(F.concat(*pieces), 256)
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % 10_000).cast("int")


def arm(experiment_id: Column, salt: Column, user_id: Column, treatment_percent: Column) -> Column:
    return F.when(
        bucket(experiment_id, salt, user_id) < treatment_percent * 100, F.lit("treatment")
    ).otherwise(F.lit("control"))


def in_rollout(model_version: Column, user_id: Column, percent: Column) -> Column:
    """Monotone in ``percent``: a user once inside stays inside while the share grows."""
    return bucket(F.lit("rollout"), model_version, user_id) < percent * 100
