"""Content hashes and the manifest that makes a run complete."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F



def _multiset_digest(digests: DataFrame) -> DataFrame:
    """One digest of many, whatever their order: slices of them are summed, nothing is gathered."""

    def part(start: int):
        return F.conv(F.substring("digest", start, 15), 16, 10).cast("decimal(38,0)")

    sums = digests.agg(
        *[F.coalesce(F.sum(part(1 + 15 * i)), F.lit(0)).cast("string").alias(f"s{i}") for i in range(4)],
        F.count(F.lit(1)).alias("items"),
    )
    return sums.select(F.sha2(F.concat_ws(":", "s0", "s1", "s2", "s3", "items"), 256).alias("sha256"), "items")


def files_sha256(spark: SparkSession, path: str) -> DataFrame:
    """Digest of the contents of the data files under ``path``; their names do not take part.

    A file passes through one task as a whole, so this is for inputs in files of moderate size;
    ``rows_sha256`` is free of that.
    """
    files = (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        .where(~F.element_at(F.split("path", "/"), -1).rlike("^[._]"))
    )
    return _multiset_digest(files.select(F.sha2("content", 256).alias("digest")))


def rows_sha256(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Digest of the rows as a multiset, whatever their order, files or partitions."""
    names = columns or df.columns
    row = F.to_json(F.struct(*names), {"ignoreNullFields": "false"})
    return _multiset_digest(df.select(F.sha2(row, 256).alias("digest")))


def source_id(digest: str, *, synthetic: bool = False) -> str:
    return f"{'synthetic' if synthetic else 'sha256'}:{digest}"


def manifest(version: str, source: str, model: DataFrame, snapshot: DataFrame) -> DataFrame:
    """The row to write last: with it a run counts as complete."""
    spark = model.sparkSession
    return spark.createDataFrame(
        [(version, source, rows_sha256(model).first()["sha256"], rows_sha256(snapshot).first()["sha256"])],
        "version STRING, source_id STRING, model_sha256 STRING, snapshot_sha256 STRING",
    )


def manifest_mismatches(recorded: DataFrame, model: DataFrame, snapshot: DataFrame) -> DataFrame:
    """What differs from the manifest; empty for a publishable run."""
    now = [
        ("model", "model_sha256", rows_sha256(model).first()["sha256"]),
        ("snapshot", "snapshot_sha256", rows_sha256(snapshot).first()["sha256"]),
    ]
    return recorded.select(
        "version",
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(name).alias("artifact"), F.col(column).alias("recorded"), F.lit(found).alias("found")
                    )
                    for name, column, found in now
                ]
            )
        ),
    ).where("recorded <> found")
