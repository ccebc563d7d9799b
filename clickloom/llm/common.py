"""Small shared pieces: kept tables in the shared folder and white-space normalisation."""

from __future__ import annotations

import os
import tempfile
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.session import scratch_path


def keep(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once below ``spark.checkpoint.dir`` and read back: cuts the lineage for good."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, *tables: DataFrame) -> None:
    """Deletes tables made by ``keep`` that no later plan reads."""
    for table in tables:
        for folder in {file.rpartition("/")[0] for file in table.inputFiles()}:
            path = spark._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def one_space(text: Column) -> Column:
    """Runs of tab, line feed, vertical tab, form feed, carriage return and blank become one blank; null is empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", " ")


def unused(df: DataFrame, name: str) -> str:
    """``name``, with underscores behind it until no column of ``df`` is named so."""
    taken = {column.lower() for column in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def ship(spark: SparkSession) -> None:
    """Hands the library to Python workers that would not find it: for sessions started elsewhere than in
    the folder of the package, without it on PYTHONPATH and without having it installed."""
    package = Path(__file__).resolve().parents[1]
    root = str(package.parent)
    known = [os.getcwd(), *os.environ.get("PYTHONPATH", "").split(os.pathsep)]
    if "site-packages" in root or root in map(os.path.realpath, known) or spark.conf.get("clickloom.shipped", None):
        return
    archive = Path(tempfile.mkdtemp(prefix="clickloom-")) / "clickloom.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in package.rglob("*.py"):
            out.write(file, file.relative_to(root))
    spark.sparkContext.addPyFile(str(archive))
    spark.conf.set("clickloom.shipped", "true")
