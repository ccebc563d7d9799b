"""Physical plans as text."""

from __future__ import annotations

from pyspark.sql import DataFrame


def formatted_plan(df: DataFrame, mode: str = "formatted") -> str:
    spark = df.sparkSession
    return df._jdf.queryExecution().explainString(
        spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode)
    )


def final_plan(df: DataFrame) -> str:
    """The plan that adaptive execution settled on; runs the query, whose rows stay where they arise."""
    rows = df._jdf.queryExecution().toRdd()
    rows.count()
    return df._jdf.queryExecution().executedPlan().toString()
