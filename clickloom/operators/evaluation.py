"""Offline evaluation: losses, AUC, NDCG, calibration, parity, model rules."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.functions import text
from clickloom.functions.click_model import is_finite, with_probability
from clickloom.functions.columns import between, clamp
from clickloom.operators.attribution import mature_impressions
from clickloom.operators.quality import check_report_range, source_id_invalid
from clickloom.operators.windows import top_per_group
from clickloom.schemas import FEATURES, SCHEMA_VERSION

_EPSILON = 1e-15


def _losses(p: Column, y: Column, squared_on: Column) -> tuple[Column, Column]:
    log_loss = F.avg(-(y * F.log(p) + (1 - y) * F.log(1 - p)))
    return log_loss, F.avg(F.pow(squared_on - y, F.lit(2.0)))


def probability_losses(scored: DataFrame) -> DataFrame:
    """Log loss on the clamped probability, Brier score on the probability as it is."""
    p = clamp("p", _EPSILON, 1 - _EPSILON)
    log_loss, brier = _losses(p, F.col("label"), F.col("p"))
    return scored.agg(log_loss.alias("log_loss"), brier.alias("brier"))


def model_quality(
    impressions: DataFrame,
    clicks: DataFrame,
    requests: DataFrame,
    results: DataFrame,
    start: datetime,
    end: datetime,
    as_of: datetime,
    *,
    now: datetime | None = None,
) -> DataFrame:
    """Per served model version over mature impressions; here both losses use the clamped score."""
    check_report_range(start, end, as_of, now)
    labelled = mature_impressions(impressions.where(between("occurred_at", start, end)), clicks, as_of)
    served = requests.where(F.col("policy") == "model").select(F.col("id").alias("request_id"), "model_version")
    scored = (
        labelled.join(served, "request_id")
        .join(results.select("request_id", "ad_id", "score"), ["request_id", "ad_id"])
        .withColumn("p", clamp("score", _EPSILON, 1 - _EPSILON))
    )
    log_loss, brier = _losses(F.col("p"), F.col("label"), F.col("p"))
    return (
        scored.groupBy("model_version")
        .agg(
            F.count(F.lit(1)).alias("impressions"),
            log_loss.alias("log_loss"),
            brier.alias("brier"),
            F.avg("label").alias("ctr"),
        )
        .orderBy("model_version")
    )


def area_under_roc(scored: DataFrame, score: str = "p", label: str = "label") -> DataFrame:
    """One row, ``auc``: the share of pairs of a clicked and another row that the score orders rightly, ties half.

    Exact: every distinct score is a threshold. Rows are counted by score, scores are dealt to ranges, and inside a
    range running sums give each clicked row the others below it. A range adds those of the ranges before as a whole,
    so only two counts and a sum for each range come together. Rows without a score or label do not count; without
    both kinds of rows the area is null.
    """
    counted = (
        scored.where(F.col(score).isNotNull() & F.col(label).isNotNull())
        .groupBy(F.col(score).alias("_score"))
        .agg(F.sum((F.col(label) > 0).cast("long")).alias("_hits"), F.sum((F.col(label) <= 0).cast("long")).alias("_rest"))
    )
    below = Window.partitionBy("_range").orderBy("_score").rowsBetween(Window.unboundedPreceding, -1)
    wins = F.col("_hits") * (F.coalesce(F.sum("_rest").over(below), F.lit(0)) + F.col("_rest") / 2)
    ranges = (
        counted.repartitionByRange("_score").withColumn("_range", F.spark_partition_id())
        .withColumn("_wins", wins)
        .groupBy("_range").agg(F.sum("_hits").alias("hits"), F.sum("_rest").alias("rest"), F.sum("_wins").alias("wins"))
    )
    # A row for each range, as many as there are shuffle partitions.
    zero = F.struct(F.lit(0).cast("long").alias("hits"), F.lit(0).cast("long").alias("rest"), F.lit(0.0).alias("wins"))
    total = F.aggregate(
        F.array_sort(F.collect_list(F.struct("_range", "hits", "rest", "wins"))), zero,
        lambda t, r: F.struct(
            (t["hits"] + r["hits"]).alias("hits"), (t["rest"] + r["rest"]).alias("rest"),
            (t["wins"] + r["wins"] + r["hits"].cast("double") * t["rest"]).alias("wins"),
        ),
    )
    pairs = F.col("_t.hits").cast("double") * F.col("_t.rest")
    return ranges.agg(total.alias("_t")).select(F.when(pairs > 0, F.col("_t.wins") / pairs).alias("auc"))


def ndcg_at(scored: DataFrame, score: str, depth: int = 10) -> DataFrame:
    """Mean NDCG over requests with a click; one row, 0 where there is none.

    Labels are 0 or 1, so the ideal order starts with all clicked rows and its gain follows from
    their number alone. The model order needs only the first ``depth`` rows per request, which the
    limited ranking keeps before the shuffle: a request of any size is never gathered.
    """
    gain = F.lit(1.0) / F.log2(F.col("rank") + 1)
    dcg = (
        top_per_group(
            scored.select("requestId", "adId", "label", F.col(score).alias("_score")),
            ["requestId"], [F.desc("_score"), F.asc("adId")], depth,
        )
        .groupBy("requestId")
        .agg(F.sum(F.col("label") * gain).alias("dcg"))
    )
    clicked = scored.groupBy("requestId").agg(F.sum("label").cast("int").alias("clicked")).where("clicked > 0")
    discounts = F.array(*[F.lit(1.0) / F.log2(F.lit(float(r + 1))) for r in range(1, depth + 1)])
    ideal = F.aggregate(
        F.slice(discounts, 1, F.least(F.col("clicked"), F.lit(depth))), F.lit(0.0), lambda a, x: a + x
    )
    return (
        clicked.join(dcg, "requestId")
        .agg(F.coalesce(F.avg(F.col("dcg") / ideal), F.lit(0.0)).alias("ndcg"), F.count(F.lit(1)).alias("requests"))
    )


def calibration(scored: DataFrame) -> DataFrame:
    """Ten bins by predicted probability; empty bins are absent."""
    return (
        scored.withColumn("bin", F.least(F.lit(9), F.floor(F.col("p") * 10)).cast("int"))
        .groupBy("bin")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.avg("p").alias("meanPrediction"),
            F.avg("label").alias("observedRate"),
        )
        .orderBy("bin")
    )


def with_model_score(rows: DataFrame, parameters: dict[str, object], name: str = "online") -> DataFrame:
    """Scores with the portable parameters; NULL where the score is invalid."""
    arrays = [
        F.array(*[F.lit(float(v)) for v in parameters[key]]) for key in ("means", "scales", "coefficients")
    ]
    return with_probability(rows, name, list(FEATURES), *arrays, F.lit(float(parameters["intercept"])))


def max_parity_error(scored: DataFrame, parameters: dict[str, object]) -> float:
    row = with_model_score(scored, parameters).agg(
        F.max(F.abs(F.col("online") - F.col("p"))).alias("worst"),
        F.sum(F.col("online").isNull().cast("long")).alias("invalid"),
    ).first()
    if row["invalid"]:
        raise ValueError(f"{row['invalid']} rows have no finite score")
    if row["worst"] > 1e-9:
        raise ValueError(f"Portable and fitted probabilities differ by {row['worst']}")
    return row["worst"]


def model_rules(now: Column | None = None) -> dict[str, Column]:
    """Rule name -> TRUE where a row of the models table must not be served or registered."""

    def vector(name: str) -> Column:
        value = F.col(name)
        fine = F.forall(value, lambda v: is_finite(v) & (F.abs(v) <= 1e6))
        return value.isNull() | (F.size(value) != len(FEATURES)) | ~F.coalesce(fine, F.lit(False))

    def loss(name: str) -> Column:
        return ~(is_finite(F.col(name)) & F.col(name).between(0, 100))

    trained, validated, evaluated = (
        F.col(c) for c in ("trained_through", "validation_through", "evaluation_as_of")
    )
    rows = [F.col(c) for c in ("training_rows", "validation_rows", "test_rows")]
    rules = {
        "version": F.col("version").isNull() | ~text.matches(F.col("version"), text.IDENTIFIER),
        "schema": F.col("schema_version").isNull()
        | (F.col("schema_version") != SCHEMA_VERSION)
        | F.col("feature_names").isNull()
        | (F.col("feature_names") != F.array(*[F.lit(f) for f in FEATURES])),
        "means": vector("means"),
        "scales": vector("scales") | F.coalesce(F.exists("scales", lambda v: v < 1e-12), F.lit(True)),
        "coefficients": vector("coefficients"),
        "intercept": ~(is_finite(F.col("intercept")) & (F.abs("intercept") <= 1e6)),
        "boundaries": ~F.coalesce((trained < validated) & (validated < evaluated), F.lit(False)),
        "sample_sizes": ~F.coalesce((rows[0] >= 2) & (rows[1] >= 2) & (rows[2] >= 2), F.lit(False)),
        "source_id": source_id_invalid(F.col("source_id")),
        "brier_above_one": F.col("test_brier") > 1,
    }
    for name in (
        "validation_log_loss", "baseline_validation_log_loss", "test_log_loss", "baseline_test_log_loss", "test_brier",
    ):
        rules[name] = loss(name)
    if now is not None:
        rules["evaluated_in_future"] = evaluated > now
    return rules


def promotion_eligible() -> Column:
    return F.col("validation_log_loss") <= F.col("baseline_validation_log_loss")
