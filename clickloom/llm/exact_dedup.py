"""Exact dedup over a cuckoo-filter index of live digests.

The index is a table of one row per live digest: ``bucket, digest, keep_id, group_size``. A digest's
bucket is a hash of it, so that the index of a large corpus is many small filters. Each bucket keeps a
cuckoo filter in front of its stored digests: a miss proves that a digest is new, a hit is verified
against the stored content, and an overflow resizes the filter from the stored keys.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import keep, one_space, unused

INDEX = "bucket long, digest string, keep_id long, group_size long"
SLOTS, KICKS = 4, 200


class CuckooFilter:
    """Fingerprints of two bytes in buckets of four slots; each has two possible buckets.

    ``stored`` yields the live digests whenever the table has to grow.
    """

    def __init__(self, stored, capacity: int = 64) -> None:
        self.stored, self.live = stored, 0
        self._allocate(capacity)

    def _allocate(self, capacity: int) -> None:
        self.size = 1 << max(2, (max(1, capacity) * 4 // 3 // SLOTS).bit_length())
        self.table = np.zeros((self.size, SLOTS), np.uint16)

    def _places(self, digest: str) -> tuple[int, int, int]:
        mark = int(digest[:4], 16) or 1
        first = int(digest[4:20], 16) & (self.size - 1)
        return mark, first, self._other(first, mark)

    def _other(self, place: int, mark: int) -> int:
        return place ^ (mark * 0x5BD1E995 & (self.size - 1))

    def __contains__(self, digest: str) -> bool:
        mark, a, b = self._places(digest)
        return mark in self.table[a] or mark in self.table[b]

    def insert(self, digest: str) -> None:
        """``digest`` must not be live yet, and must already be among the stored keys."""
        self.live += 1
        if not self._place(digest):
            self._resize()

    def _place(self, digest: str) -> bool:
        mark, a, b = self._places(digest)
        for place in (a, b):
            if (free := np.flatnonzero(self.table[place] == 0)).size:
                self.table[place, free[0]] = mark
                return True
        place = a
        for kick in range(KICKS):
            slot = kick % SLOTS
            mark, self.table[place, slot] = int(self.table[place, slot]), mark
            place = self._other(place, mark)
            if (free := np.flatnonzero(self.table[place] == 0)).size:
                self.table[place, free[0]] = mark
                return True
        return False

    def _resize(self) -> None:
        capacity = self.size * SLOTS
        while True:
            capacity *= 2
            self._allocate(capacity)
            if all(self._place(digest) for digest in self.stored()):
                return

    def delete(self, digest: str) -> None:
        """``digest`` must be live."""
        mark, a, b = self._places(digest)
        for place in (a, b):
            if (at := np.flatnonzero(self.table[place] == mark)).size:
                self.table[place, at[0]] = 0
                self.live -= 1
                return


class Bucket:
    """The live digests of one bucket with their kept ids and counts, behind a filter."""

    def __init__(self, capacity: int = 64) -> None:
        self.rows: dict[str, list] = {}
        self.filter = CuckooFilter(lambda: self.rows, capacity)

    def insert(self, digest: str, keep_id: int | None, copies: int) -> None:
        if digest in self.filter and (row := self.rows.get(digest)):
            ids = [x for x in (row[0], keep_id) if x is not None]
            row[:] = [min(ids, default=None), row[1] + copies]
        else:
            self.rows[digest] = [keep_id, copies]
            self.filter.insert(digest)

    def delete(self, digest: str) -> None:
        if digest in self.filter and self.rows.pop(digest, None):
            self.filter.delete(digest)

    def frame(self, bucket: int | None = None) -> pd.DataFrame:
        return pd.DataFrame(
            {
                "bucket": pd.Series([bucket] * len(self.rows), dtype="Int64"),
                "digest": pd.Series(list(self.rows), dtype=object),
                "keep_id": pd.Series([r[0] for r in self.rows.values()], dtype="Int64"),
                "group_size": pd.Series([r[1] for r in self.rows.values()], dtype="Int64"),
            }
        )


def _id(value) -> int | None:
    return None if pd.isna(value) else int(value)


def with_digest(docs: DataFrame, text: str = "text") -> Column:
    """SHA-256, in hexadecimal, of the text with white space normalised."""
    return F.sha2(F.encode(one_space(docs[text]), "UTF-8"), 256)


def _first_seen(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row per digest of a task's batch: copies collapse before they are shuffled."""
    for frame in frames:
        bucket = Bucket(len(frame))
        for digest, doc_id in zip(frame["digest"], frame["doc_id"], strict=True):
            bucket.insert(digest, _id(doc_id), 1)
        yield bucket.frame()[["digest", "keep_id", "group_size"]]


def _apply(key, index: pd.DataFrame, changes: pd.DataFrame) -> pd.DataFrame:
    bucket = Bucket(len(index) + len(changes))
    for row in index.itertuples(index=False):
        bucket.insert(row.digest, _id(row.keep_id), int(row.group_size))
    for row in changes[changes["removed"]].itertuples(index=False):
        bucket.delete(row.digest)
    for row in changes[~changes["removed"]].itertuples(index=False):
        bucket.insert(row.digest, _id(row.keep_id), int(row.group_size))
    return bucket.frame(key[0])


def update_index(index: DataFrame, added: DataFrame | None = None, removed: DataFrame | None = None, buckets: int = 64) -> DataFrame:
    """The index after deleting the digests of ``removed`` and then inserting the rows of ``added``.

    ``added`` has ``digest, doc_id``, ``removed`` has ``digest``; further columns are ignored. A digest
    that is deleted loses all its live copies; null digests say nothing, and deleting an unknown digest changes nothing. ``buckets``
    is a property of the index: use the same number for its whole life, about one per 100 000 digests.
    """
    if added is None and removed is None:
        return index
    spark = index.sparkSession
    changes = spark.createDataFrame([], "digest string, keep_id long, group_size long, removed boolean")
    if added is not None:
        rows = added.select(F.col("digest").cast("string"), F.col("doc_id").cast("long")).where("digest IS NOT NULL")
        seen = rows.mapInPandas(_first_seen, "digest string, keep_id long, group_size long")
        changes = changes.unionByName(
            # The sum has a map side, so that a hot digest reaches its bucket as one row a task.
            seen.groupBy("digest")
            .agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
            .withColumn("removed", F.lit(False))
        )
    if removed is not None:
        gone = removed.select(F.col("digest").cast("string")).where("digest IS NOT NULL").distinct()
        changes = changes.unionByName(gone.withColumn("removed", F.lit(True)), allowMissingColumns=True)
    changes = changes.withColumn("bucket", F.pmod(F.xxhash64("digest"), F.lit(buckets)))
    return index.groupBy("bucket").cogroup(changes.groupBy("bucket")).applyInPandas(_apply, INDEX)


def empty_index(spark) -> DataFrame:
    return spark.createDataFrame([], INDEX)


def exact_dedup(docs: DataFrame, id: str = "doc_id", text: str = "text", per_bucket: int = 50_000) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical after each run of white space becomes one blank; null counts
    as empty. Of equal texts the smallest id stays. Rows with a null id join their group, and stay only
    if no row of the group has an id: then ``keep_id`` is null and ``kept`` true for all of them. Repeated
    ids with equal texts all stay. An empty table gives no rows; other columns are not read.
    """
    rows = keep(docs.select(docs[id].cast("long").alias("doc_id"), with_digest(docs, text).alias("digest")), "digests")
    buckets = max(docs.sparkSession.sparkContext.defaultParallelism, rows.count() // per_bucket + 1)
    index = update_index(empty_index(docs.sparkSession), rows, buckets=buckets)
    return rows.join(index, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.col("digest").alias("text_sha256"),
    )


def drop_exact_copies(docs: DataFrame, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` for each text: of the smallest id, or without one where no row has an id. Of rows
    that repeat that id and text, or have the text and no id, any one stays."""
    key, digest = unused(docs, "__key"), unused(docs, "__text_sha256")
    kept = exact_dedup(docs, id, text).where("kept")
    kept = kept.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias(key), F.col("text_sha256").alias(digest))
    named = {key: F.coalesce(docs[id].cast("long").cast("string"), F.lit("")), digest: with_digest(docs, text)}
    # Repeated rows collapse in each task before the shuffle, which serves the join as well.
    single = docs.withColumns(named).dropDuplicates([key, digest])
    return single.join(kept.distinct(), [key, digest], "left_semi").drop(key, digest)
