"""Tables bucketed by a key, so that joins on it read what belongs together and move nothing."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame

#: Tables that are joined with each other need the same number.
BUCKETS = 64


def write_bucketed(df: DataFrame, key: str, name: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """``df`` below ``path`` in ``buckets`` files by ``key``, each sorted by it, as a table of the session's catalog.

    The rows move once, when they are written: a task writes one bucket. ``name`` is made unique; rows without a
    key share a bucket and meet nothing in a join. The number of buckets should grow with the table: a bucket is
    what one task of a join reads.
    """
    table = f"{name}_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key)
    writer.format("parquet").option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)


def write_bucketed_in_place(df: DataFrame, key: str, name: str, path: str, buckets: int = BUCKETS) -> DataFrame:
    """As ``write_bucketed``, but no row moves: each task writes a file for every bucket that it has rows of.

    For tables of few large rows, where such files are few, that a grouping or join by ``key`` reads later.
    """
    table = f"{name}_{uuid.uuid4().hex}"
    writer = df.write.bucketBy(buckets, key).option("compression", "zstd")
    writer.format("parquet").option("path", path).saveAsTable(table)
    return df.sparkSession.table(table)
