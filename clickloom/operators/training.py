"""Training examples, the purged temporal split and the model fit."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.functions.columns import hours, instant
from clickloom.operators.attribution import mature_impressions
from clickloom.schemas import FEATURES, MATURITY_HOURS, SCHEMA_VERSION, TRAINING_EXAMPLE, TRAINING_FIELDS


def training_examples(
    impressions: DataFrame, clicks: DataFrame, requests: DataFrame, results: DataFrame, as_of
) -> DataFrame:
    """One row per mature impression with the features captured when it was served.

    A request returns at most 50 results, so the star join has no hot keys.
    """
    labelled = mature_impressions(impressions, clicks, as_of)
    served = requests.select(F.col("id").alias("request_id"), F.col("created_at").alias("predictionTime"))
    captured = results.select(
        "request_id", "ad_id",
        F.col("text_relevance").alias("textRelevance"),
        F.col("smoothed_ctr").alias("smoothedCtr"),
        F.col("log_impressions").alias("logImpressions"),
    )
    return _as_examples(labelled.join(served, "request_id").join(captured, ["request_id", "ad_id"]))


def _as_examples(labelled: DataFrame) -> DataFrame:
    return labelled.select(
        F.col("id").alias("impressionId"),
        F.col("request_id").alias("requestId"),
        F.col("ad_id").alias("adId"),
        "predictionTime",
        F.col("occurred_at").alias("impressionTime"),
        (F.col("occurred_at") + hours(MATURITY_HOURS)).alias("labelAvailableAt"),
        F.lit(SCHEMA_VERSION).alias("schemaVersion"),
        *FEATURES,
        F.col("label").cast("double").alias("label"),
    )


def captured_impressions(impressions: DataFrame, requests: DataFrame, results: DataFrame) -> DataFrame:
    """Impressions with the time and the features of their serving, joined by the request alone.

    Over tables bucketed by request (``sources.bucketed``; requests by ``id``) no row moves. A join on request and
    ad would be shuffled by both, so the ad is compared as a range of one value, which stays a condition of the
    join by request: a request has at most 50 results.
    """
    served = requests.select(F.col("id").alias("request_id"), F.col("created_at").alias("predictionTime"))
    captured = results.select(
        F.col("request_id").alias("_request"), F.col("ad_id").alias("_ad"),
        F.col("text_relevance").alias("textRelevance"),
        F.col("smoothed_ctr").alias("smoothedCtr"),
        F.col("log_impressions").alias("logImpressions"),
    )
    same = (F.col("request_id") == F.col("_request")) & F.col("ad_id").between(F.col("_ad"), F.col("_ad"))
    return impressions.join(served, "request_id").join(captured, same).drop("_request", "_ad")


def training_examples_by_request(
    impressions: DataFrame, clicks: DataFrame, requests: DataFrame, results: DataFrame, as_of
) -> DataFrame:
    """``training_examples`` from tables bucketed by request: impressions move once, to meet their clicks."""
    return _as_examples(mature_impressions(captured_impressions(impressions, requests, results), clicks, as_of))


# Written to the microsecond; read with or without a zone, as both timestamp types are written.
JSON_TIMES = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}
JSON_READ = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss[.SSSSSS][XXX]"}


def frozen_payloads(examples: DataFrame, export_id: str) -> DataFrame:
    """Rows of a frozen export; the payload is JSON text, with timestamps to the microsecond."""
    return examples.select(
        F.lit(export_id).alias("export_id"),
        F.col("impressionId").alias("impression_id"),
        F.to_json(F.struct(*TRAINING_FIELDS), JSON_TIMES).alias("payload"),
    )


def thaw_payloads(frozen: DataFrame) -> DataFrame:
    return frozen.select(F.from_json("payload", TRAINING_EXAMPLE, JSON_READ).alias("_row")).select("_row.*")


def with_split(examples: DataFrame, train_end, validation_end, as_of) -> DataFrame:
    """``train``, ``validation``, ``test``, or ``purged`` where a label matures across a boundary."""
    predicted, known = F.col("predictionTime"), F.col("labelAvailableAt")
    t, v, end = instant(train_end), instant(validation_end), instant(as_of)
    return examples.withColumn(
        "split",
        F.when((predicted < t) & (known <= t), "train")
        .when((predicted >= t) & (predicted < v) & (known <= v), "validation")
        .when((predicted >= v) & (known <= end), "test")
        .otherwise("purged"),
    )


def split_counts(split: DataFrame) -> DataFrame:
    return split.groupBy("split").agg(
        F.count(F.lit(1)).alias("rows"), F.sum("label").cast("long").alias("positives")
    )


@dataclass
class FittedModel:
    pipeline: PipelineModel
    regularization: float
    validation_log_loss: float
    trials: list[tuple[float, float]]


def fit_scaling(train: DataFrame) -> PipelineModel:
    """Feature vector, standardised by the means and deviations of ``train``."""
    return Pipeline(
        stages=[
            VectorAssembler(inputCols=list(FEATURES), outputCol="rawFeatures"),
            StandardScaler(inputCol="rawFeatures", outputCol="features", withMean=True, withStd=True),
        ]
    ).fit(train)


def fit_click_model(train: DataFrame, regularization: float, scaling: PipelineModel | None = None) -> PipelineModel:
    scaling = scaling or fit_scaling(train)
    regression = LogisticRegression(
        featuresCol="features", labelCol="label", standardization=False,
        regParam=regularization, maxIter=100, tol=1e-8,
    ).fit(scaling.transform(train))
    return PipelineModel(stages=[*scaling.stages, regression])


def with_probability(model: PipelineModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("p", vector_to_array("probability", "float64")[1])


def fit_best(train: DataFrame, validation: DataFrame, regularizations: Sequence[float] = (0.01, 0.1)) -> FittedModel:
    """Lowest validation log loss; the earlier candidate wins a tie. All stages see ``train`` only."""
    from clickloom.operators.evaluation import probability_losses

    best: FittedModel | None = None
    trials: list[tuple[float, float]] = []
    scaling = fit_scaling(train)
    for reg in regularizations:
        fitted = fit_click_model(train, reg, scaling)
        loss = probability_losses(with_probability(fitted, validation)).first()["log_loss"]
        trials.append((reg, loss))
        if best is None or loss < best.validation_log_loss:
            best = FittedModel(fitted, reg, loss, trials)
    return best


def model_parameters(model: PipelineModel) -> dict[str, object]:
    """Means, scales, coefficients and intercept; a constant feature scales by 1 and weighs 0,
    which is what the fitted scaler does with it."""
    scaler, regression = model.stages[1], model.stages[2]
    scales = [float(s) for s in scaler.std]
    flat = [s < 1e-12 for s in scales]
    return {
        "means": [float(m) for m in scaler.mean],
        "scales": [1.0 if f else s for s, f in zip(scales, flat)],
        "coefficients": [0.0 if f else float(c) for c, f in zip(regression.coefficients, flat)],
        "intercept": float(regression.intercept),
    }
