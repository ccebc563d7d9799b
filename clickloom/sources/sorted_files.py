"""Range-sorted files with a manifest, so that a keyset page opens the one or two files that hold it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.operators.paging import keyset_page
from clickloom.operators.quality import ContractError
from clickloom.sources.tables import write_new

#: Rows of a file that are aimed at; a page has 5000 at most.
FILE_ROWS = 100_000


def write_sorted(df: DataFrame, key: str, path: str, file_rows: int = FILE_ROWS) -> None:
    """Writes ``df`` below ``path`` in files of about ``file_rows`` rows, sorted by ``key`` within and across
    files, and a manifest with each file's smallest and largest key and number of rows.

    The manifest comes last: files without one count for nothing. ``key`` is unique by contract; a null key is an
    error, found in the manifest's own pass. An empty table has an empty manifest.
    """
    files = max(1, -(-df.count() // file_rows))
    write_new(df.repartitionByRange(files, key).sortWithinPartitions(key), f"{path}/rows")
    stored = df.sparkSession.read.schema(df.schema).parquet(f"{path}/rows")
    manifest = stored.groupBy(F.col("_metadata.file_path").alias("file")).agg(
        F.min(key).alias("least"), F.max(key).alias("most"), F.count(F.lit(1)).alias("rows"), F.count(key).alias("_keys")
    )
    manifest = manifest.withColumn(
        "rows", F.when(F.col("rows") == F.col("_keys"), F.col("rows")).otherwise(F.raise_error(F.lit(f"Rows without {key} cannot be paged")).cast("long"))
    ).drop("_keys")
    # A row for each file: sorted, in one file of its own.
    write_new(manifest.orderBy("least").coalesce(1), f"{path}/manifest")


def page_files(spark: SparkSession, path: str, after, size: int) -> list[str]:
    """The files of the ``size + 1`` rows behind ``after``: of the first an unknown part, of the others all."""
    manifest = spark.read.parquet(f"{path}/manifest")
    behind = manifest if after is None else manifest.where(F.col("most") > F.lit(after))
    probe = 4
    while True:
        found = behind.orderBy("least").limit(probe).collect()
        rows, files = 0, []
        for k, file in enumerate(found):
            files.append(file["file"])
            # Behind a key inside the first file there may be as little as one row of it.
            rows += file["rows"] if k or after is None else 1
            if rows > size:
                return files
        if len(found) < probe:
            return files
        probe *= 4


def page(spark: SparkSession, path: str, key: str, after=None, size: int = 1000) -> DataFrame:
    """``keyset_page`` of a table written by ``write_sorted``, over the files that hold the page."""
    schema = spark.read.parquet(f"{path}/rows").schema
    files = page_files(spark, path, after, size)
    rows = spark.read.schema(schema).parquet(*files) if files else spark.createDataFrame([], schema)
    return keyset_page(rows, key, after, size)


def check_manifest(spark: SparkSession, path: str) -> None:
    """Raises unless the files' key ranges follow one another without touching."""
    overlapping = (
        spark.read.parquet(f"{path}/manifest").alias("a")
        .join(spark.read.parquet(f"{path}/manifest").alias("b"), F.expr("a.file < b.file AND a.least <= b.most AND b.least <= a.most"))
    )
    if not overlapping.isEmpty():
        raise ContractError(f"Files below {path} overlap in their keys")
