"""Features and the portable scorer of the click model."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.schemas import MAX_COUNT


def smoothed_ctr(impressions: Column, clicked: Column) -> Column:
    return (clicked + F.lit(1.0)) / (impressions + F.lit(20.0))


def log_impressions(impressions: Column) -> Column:
    return F.log1p(impressions.cast("double"))


def valid_counts(impressions: Column, clicked: Column) -> Column:
    return (impressions >= 0) & (impressions <= MAX_COUNT) & (clicked >= 0) & (clicked <= impressions)


def valid_inputs(relevance: Column, impressions: Column, clicked: Column) -> Column:
    """FALSE where a count or the relevance is out of its range (NaN sorts above 1)."""
    return (relevance >= 0) & (relevance <= 1) & valid_counts(impressions, clicked)


def sigmoid(z: Column) -> Column:
    """exp of a negative number only, so it never overflows."""
    e = F.exp(-F.abs(z))
    return F.when(z >= 0, F.lit(1.0)).otherwise(e) / (1 + e)


def is_finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < F.lit(float("inf")))


def linear_score(features: list[Column], means: Column, scales: Column, coefficients: Column, intercept: Column) -> Column:
    z = intercept
    for i, x in enumerate(features):
        z = z + coefficients[i] * ((x - means[i]) / scales[i])
    return z


def with_probability(
    df: DataFrame, name: str, features: list[str], means: Column, scales: Column, coefficients: Column, intercept: Column
) -> DataFrame:
    """Adds the click probability, or NULL where the score is not finite (one feature that is not
    finite is enough). The score is a column of its own, or its expression would be repeated
    wherever it is used."""
    z = F.col("_score")
    return (
        df.withColumn("_score", linear_score([F.col(f) for f in features], means, scales, coefficients, intercept))
        .withColumn(name, F.when(is_finite(z), sigmoid(z)))
        .drop("_score")
    )


def baseline_score(relevance: Column, smoothed: Column) -> Column:
    return relevance + F.lit(0.25) * smoothed
