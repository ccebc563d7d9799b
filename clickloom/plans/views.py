"""Click-platform tables derived from the given tables.

``events`` carries views and clicks of users on ads (``k`` in its properties). Eight consecutive
events make one search session for the tables of the serving side. All derivations are row-wise or
reduce on the map side, so they scale with the input.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions import click_model
from clickloom.functions.columns import name_uuid
from clickloom.schemas import FEATURES, SCHEMA_VERSION

# The fixed scorer used for served scores.
FIXED_MODEL = {"means": [0.0, 0.0, 0.0], "scales": [1.0, 1.0, 1.0], "coefficients": [1.0, 1.0, 0.1], "intercept": -1.0}
SESSION = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def minutes(n: Column) -> Column:
    return F.make_dt_interval(mins=n.cast("int"))


def named(prefix: str, value: Column) -> Column:
    return name_uuid(F.concat(F.lit(f"{prefix}-"), value.cast("string")))


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
    )


# ---- views and clicks, attributed by user ---------------------------------------------------


def impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("event_type = 'view'").select(
        F.col("event_id").alias("impression_id"),
        F.col("k").alias("ad_id"),
        "user_id",
        F.col("ts").alias("impression_ts"),
        (F.col("ts") + minutes(F.col("event_id") % 120)).alias("received_ts"),
        F.round(F.col("value") * 100).cast("long").alias("cost_cents"),
    )


def clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).where("event_type = 'click'").select(
        F.col("event_id").alias("click_id"),
        "user_id",
        F.col("ts").alias("click_ts"),
        (F.col("ts") + minutes(F.col("event_id") % 90)).alias("received_ts"),
    )


# ---- the serving side -----------------------------------------------------------------------


def _sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events(spark, sf_dir).withColumn("session", F.floor(F.col("event_id") / SESSION).cast("long"))


def search_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_session = _sessions(spark, sf_dir).groupBy("session").agg(
        F.min("ts").alias("created_at"), F.min_by("user_id", "event_id").alias("user")
    )
    is_model = F.col("session") % 3 != 0
    return per_session.select(
        named("request", F.col("session")).alias("id"),
        F.concat(F.lit("u"), F.col("user").cast("string")).alias("user_id"),
        "created_at",
        F.when(is_model, "model").otherwise("baseline").alias("policy"),
        F.when(is_model, F.concat(F.lit("model-"), (F.col("session") % 2).cast("string"))).alias("model_version"),
        F.concat(F.lit("exp-"), (F.col("user") % 5).cast("string")).alias("experiment_id"),
    )


def search_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _sessions(spark, sf_dir).groupBy("session", "k").agg(F.min_by("value", "event_id").alias("value"))
    history = F.floor(F.col("value") * 10).cast("long")
    clicked = F.floor(history / 4).cast("long")
    features = first.select(
        named("request", F.col("session")).alias("request_id"),
        named("ad", F.col("k")).alias("ad_id"),
        (F.col("value") - F.floor("value")).alias("text_relevance"),
        click_model.smoothed_ctr(history, clicked).alias("smoothed_ctr"),
        click_model.log_impressions(history).alias("log_impressions"),
    )
    return with_fixed_score(features, "score", ["text_relevance", "smoothed_ctr", "log_impressions"])


def with_fixed_score(df: DataFrame, name: str, features: list[str]) -> DataFrame:
    means, scales, coefficients = (
        F.array(*[F.lit(v) for v in FIXED_MODEL[k]]) for k in ("means", "scales", "coefficients")
    )
    return click_model.with_probability(
        df, name, features, means, scales, coefficients, F.lit(FIXED_MODEL["intercept"])
    )


def served_impressions(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = (
        _sessions(spark, sf_dir).where("event_type = 'view'")
        .groupBy("session", "k").agg(F.min("event_id").alias("event_id"), F.min_by("ts", "event_id").alias("ts"))
    )
    return first.select(
        named("impression", F.col("event_id")).alias("id"),
        named("request", F.col("session")).alias("request_id"),
        named("ad", F.col("k")).alias("ad_id"),
        F.col("ts").alias("occurred_at"),
        (F.col("ts") + minutes(F.col("event_id") % 50)).alias("received_at"),
    )


def _session_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks of a session on its first view."""
    rows = _sessions(spark, sf_dir)
    shown = rows.where("event_type = 'view'").groupBy("session").agg(F.min("event_id").alias("shown"))
    return rows.where("event_type = 'click'").join(shown, "session")


def served_clicks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _session_clicks(spark, sf_dir).select(
        named("click", F.col("event_id")).alias("id"),
        named("impression", F.col("shown")).alias("impression_id"),
        F.col("ts").alias("occurred_at"),
        (F.col("ts") + minutes(F.col("event_id") % 50)).alias("received_at"),
    )


# ---- deliveries with retries, reused ids and bad clocks --------------------------------------


def _variants(base: DataFrame, variants: list[tuple[Column, Column]]) -> DataFrame:
    """One output row per variant whose condition holds; the base is read once."""
    chosen = F.array(*[F.when(condition, row) for condition, row in variants])
    return base.select(F.inline(F.array_compact(chosen)))


def impression_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _sessions(spark, sf_dir)
    last = rows.groupBy("session").agg(F.max("k").alias("last_k"))
    base = (
        rows.where("event_type = 'view'").join(last, "session")
        .withColumn("received", F.col("ts") + minutes(F.col("event_id") % 75))
    )
    value = F.col("value")

    def variant(n: int, *, id_prefix="impression", ad=F.col("k"), late=0, occurred=None) -> Column:
        received = F.col("received") + minutes(F.lit(late))
        return F.struct(
            (F.col("event_id") * 10 + n).alias("delivery_id"),
            named(id_prefix, F.col("event_id")).alias("id"),
            named("request", F.col("session")).alias("request_id"),
            named("ad", ad).alias("ad_id"),
            (F.col("ts") if occurred is None else received + minutes(F.lit(occurred))).alias("occurred_at"),
            received.alias("received_at"),
        )

    def band(low: float, high: float) -> Column:
        return (value >= low) & (value < high)

    return _variants(
        base,
        [
            (F.lit(True), variant(0)),
            (band(0, 10), variant(1, late=120)),
            (band(10, 20), variant(2, ad=F.col("k") + 1, late=1)),
            (band(20, 40), variant(3, id_prefix="again", late=2)),
            (band(20, 40), variant(4, id_prefix="again", ad=F.col("last_k"), late=3)),
            (band(40, 45), variant(5, id_prefix="future", occurred=1)),
        ],
    )


def click_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _session_clicks(spark, sf_dir).withColumn("received", F.col("ts") + minutes(F.col("event_id") % 75))
    value = F.col("value")

    def variant(n: int, *, earlier=0, late=0) -> Column:
        return F.struct(
            (F.col("event_id") * 10 + n).alias("delivery_id"),
            named("click", F.col("event_id")).alias("id"),
            named("impression", F.col("shown")).alias("impression_id"),
            (F.col("ts") - minutes(F.lit(earlier))).alias("occurred_at"),
            (F.col("received") + minutes(F.lit(late))).alias("received_at"),
        )

    return _variants(
        base,
        [
            (F.lit(True), variant(0)),
            ((value >= 0) & (value < 10), variant(1, late=120)),
            ((value >= 10) & (value < 20), variant(2, earlier=1, late=1)),
        ],
    )


# ---- search input and configuration ---------------------------------------------------------


def ads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        named("ad", F.col("p_partkey")).alias("id"), F.col("p_name").alias("title"), F.col("p_type").alias("category")
    )


def search_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_name").alias("query"))
    # Parts compress well: by the size of their file they would be broadcast at any number of rows.
    return events(spark, sf_dir).join(names.hint("merge"), "k").select(
        named("search", F.col("event_id")).alias("id"),
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("user_id"),
        "query",
        F.col("ts").alias("created_at"),
        (F.col("event_id") % 16 + 5).cast("int").alias("limit"),
        F.when(
            F.col("value") < 30, F.concat(F.lit("exp-"), (F.col("user_id") % 26).cast("string"))
        ).alias("experiment_id"),
    )


def experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(
        F.concat(F.lit("exp-"), F.col("n_nationkey").cast("string")).alias("id"),
        F.concat(F.lit("salt-"), F.col("n_name")).alias("salt"),
        F.concat(F.lit("model-"), F.col("n_regionkey").cast("string")).alias("model_version"),
        (F.col("n_nationkey") * 7 % 81 + 10).cast("int").alias("treatment_percent"),
        (F.col("n_nationkey") % 5 != 0).alias("active"),
    )


def models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One model per region; the fourth has an unusable scale, the fifth another name."""
    r = F.col("r_regionkey")
    epoch = F.lit("2024-01-01").cast("timestamp_ntz")

    def day(n: int) -> Column:
        return epoch - F.make_dt_interval(days=F.lit(n))

    return table(spark, sf_dir, "region").select(
        F.when(r == 4, "retired-4").otherwise(F.concat(F.lit("model-"), r.cast("string"))).alias("version"),
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        F.array(*[F.lit(f) for f in FEATURES]).alias("feature_names"),
        F.array(F.lit(0.0), r * F.lit(0.05), F.lit(0.0)).alias("means"),
        F.array(F.when(r == 3, 0.0).otherwise(1.0), F.lit(1.0), F.lit(2.0)).alias("scales"),
        F.array(F.lit(1.0) + r * F.lit(0.5), F.lit(2.0), F.lit(0.1)).alias("coefficients"),
        F.lit(-1.0).alias("intercept"),
        day(10).alias("trained_through"),
        day(5).alias("validation_through"),
        day(1).alias("evaluation_as_of"),
        F.lit(100).cast("long").alias("training_rows"),
        F.lit(50).cast("long").alias("validation_rows"),
        F.lit(50).cast("long").alias("test_rows"),
        (F.lit(0.5) + r * F.lit(0.05)).alias("validation_log_loss"),
        F.lit(0.6).alias("baseline_validation_log_loss"),
        F.lit(0.4).alias("test_log_loss"),
        F.lit(0.6).alias("baseline_test_log_loss"),
        F.lit(0.2).alias("test_brier"),
        F.lit("derived").alias("source_id"),
        (epoch + F.make_dt_interval(days=r)).alias("registered_at"),
    )


def deployments(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = F.col("r_regionkey")
    return table(spark, sf_dir, "region").select(
        r.cast("long").alias("revision"),
        F.concat(F.lit("model-"), r.cast("string")).alias("model_version"),
        (r * 20 + 10).cast("int").alias("rollout_percent"),
        (F.lit("2024-01-02").cast("timestamp_ntz") + F.make_dt_interval(days=r * 6)).alias("changed_at"),
    )


def snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One snapshot per day of views, available three hours after the day."""
    days = events(spark, sf_dir).where("event_type = 'view'").select(F.to_date("ts").alias("day")).distinct()
    cutoff = (F.col("day").cast("timestamp_ntz") + F.expr("INTERVAL 1 DAY"))
    return days.select(
        named("snapshot", F.col("day")).alias("id"),
        F.lit(SCHEMA_VERSION).alias("schema_version"),
        (cutoff - F.expr("INTERVAL 30 DAYS")).alias("window_start"),
        cutoff.alias("cutoff"),
        (cutoff + F.expr("INTERVAL 3 HOURS")).alias("available_at"),
        F.concat(F.lit("events:"), F.col("day").cast("string")).alias("source_id"),
    )


def ad_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        events(spark, sf_dir).where("event_type = 'view'")
        .groupBy(F.to_date("ts").alias("day"), "k")
        .agg(
            F.count(F.lit(1)).alias("impressions"),
            F.sum((F.col("value") < 30).cast("long")).alias("clicked_impressions"),
        )
        .select(
            named("snapshot", F.col("day")).alias("snapshot_id"), named("ad", F.col("k")).alias("ad_id"),
            "impressions", "clicked_impressions",
        )
    )
