"""Lexical retrieval, policy resolution and ranking for whole tables of search requests.

Requests that share the query, the feature snapshot and the model share their ranking, so ranking
runs once per such context; a popular query costs what a rare one costs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickloom.functions import click_model, hashing, text
from clickloom.functions.columns import epoch_micros
from clickloom.operators.asof import asof_join
from clickloom.operators.evaluation import model_rules
from clickloom.operators.lookup import lookup_join
from clickloom.operators.quality import with_violations
from clickloom.operators.windows import top_per_group
from clickloom.schemas import MAX_RESULTS, RETRIEVAL_DEPTH, SCHEMA_VERSION, SNAPSHOT_MAX_AGE_SECONDS

#: Size of quantile sketches, and a bound on their rank error, over three times what is usual at that size.
SKETCH_SIZE = 800
SKETCH_ERROR = 0.02
#: Bounds of a history that is broadcast as a step function: rows, bytes, publications on one day.
STEP_ROWS, STEP_BYTES, STEP_DAY = 200_000, 16 << 20, 64


def token_counts(ads: DataFrame, *carried: str) -> DataFrame:
    """ad_id, the ad's ``carried`` columns and ``held``, each token of title and category with how often they hold it."""
    words = text.tokens(F.concat_ws(" ", "title", "category"))
    # Repeats of a token lie in one ad: its count needs no shuffle.
    return ads.select(F.col("id").alias("ad_id"), words.alias("_words"), *carried).select(
        "ad_id", *carried,
        F.map_from_entries(
            F.transform(
                F.array_distinct("_words"),
                lambda t: F.struct(t.alias("token"), F.size(F.filter("_words", lambda w: w == t)).alias("tf")),
            )
        ).alias("held"),
    )


def token_postings(ads: DataFrame, *carried: str) -> DataFrame:
    """token, ad_id, ``tf``, how often the ad's title and category hold the token, and the ad's ``carried`` columns."""
    return token_counts(ads, *carried).select("ad_id", *carried, F.explode("held").alias("token", "tf")).select("token", "ad_id", "tf", *carried)


def relevance(least: Column) -> Column:
    raw = F.lit(0.1) * least
    return raw / (1 + raw)


def lexical_candidates(queries: DataFrame, ads: DataFrame, depth: int = RETRIEVAL_DEPTH) -> DataFrame:
    """query, ad_id, relevance, rank: the best ``depth`` ads holding all tokens of the query.

    relevance = raw / (1 + raw) with raw = 0.1 * the smallest term frequency over the query tokens;
    ties go to the lower id. Queries that ask for the same set of tokens are one retrieval. For a
    single token the ads are ranked per token before any query is met, so a token that every ad holds
    gives ``depth`` rows. A set of several meets the ads on its rarest token; an ad carries the counts of
    all its tokens, so the others are looked up in its row and only what holds them all is ranked. Ads are
    dealt over tasks by id first, since few and small files can hold many of them, and no join may
    broadcast postings, whose size an estimate from the files' does not tell.
    """
    asked = (
        queries.select("query").distinct()
        .withColumn("_terms", F.array_sort(F.array_distinct(text.tokens(F.col("query")))))
        .where(F.size("_terms") > 0)
    )
    sets = asked.select("_terms").distinct()
    dealt = ads.select("id", "title", "category").repartition("id")
    postings = token_postings(dealt)
    order = [F.desc("tf"), F.asc("ad_id")]
    single = sets.where(F.size("_terms") == 1).select("_terms", F.col("_terms")[0].alias("token"))
    # Among ads with one token the relevance rises with its frequency, so the order is the same.
    best_single = top_per_group(postings, ["token"], order, depth).hint("merge").join(single, "token").select(
        "_terms", "ad_id", F.col("tf").alias("_least"), "rank"
    )

    several = sets.where(F.size("_terms") > 1)
    terms = several.select("_terms", F.explode("_terms").alias("token"))
    frequency = postings.groupBy("token").agg(F.count(F.lit(1)).alias("_df"))
    rarest = (
        terms.join(frequency.hint("merge"), "token")
        .groupBy("_terms")
        .agg(F.array_sort(F.collect_list(F.struct("_df", "token"))).alias("_found"))
        # A token that no ad holds leaves the set without candidates.
        .where(F.size("_found") == F.size("_terms"))
        .select("_terms", F.col("_found")[0]["token"].alias("token"), F.col("_found")[1]["token"].alias("_second"))
    )
    # The side of the ads is the streamed one: of a token's rows only the sets are held.
    carrying = token_counts(dealt).select("ad_id", "held", F.explode(F.map_keys("held")).alias("token"))
    met = carrying.hint("merge").join(rarest, "token").where(F.array_contains(F.map_keys("held"), F.col("_second")))
    least = F.array_min(F.transform("_terms", lambda t: F.coalesce(F.element_at("held", t), F.lit(0))))
    held = met.select("_terms", "ad_id", least.alias("_least")).where(F.col("_least") > 0)
    best_several = top_per_group(held, ["_terms"], [F.desc("_least"), F.asc("ad_id")], depth).select(
        "_terms", "ad_id", "_least", "rank"
    )
    return asked.join(best_single.unionByName(best_several).hint("merge"), "_terms").select(
        "query", "ad_id", relevance(F.col("_least")).alias("relevance"), "rank"
    )


# ---- snapshots and deployments as of a request ----------------------------------------------


def _step_function(history: DataFrame, known: Column, best: Column) -> DataFrame:
    """Intervals ``[_t, _until)`` with the greatest record known in them."""
    w = Window.orderBy("_t")
    # Only called for histories small enough to broadcast.
    return (
        history.select(known.alias("_t"), best.alias("_rec"))
        .groupBy("_t").agg(F.max("_rec").alias("_rec"))
        .withColumn("_rec", F.max("_rec").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .withColumn("_until", F.lead("_t").over(w))
    )


def _day(ts: str | Column) -> Column:
    return F.floor(epoch_micros(ts) / F.lit(86_400_000_000)).cast("long")


def latest_as_of(
    requests: DataFrame, history: DataFrame, *, clocks: list[str], order: list[str], values: list[str], at: str,
    broadcast_rows: int = STEP_ROWS,
) -> DataFrame:
    """The one latest record of a keyless history at each request's time; NULL if there is none.

    A history of at most ``broadcast_rows`` publications and days, of ``STEP_BYTES`` in all and with at
    most ``STEP_DAY`` publications on a day, becomes a step function by day and is broadcast, so requests
    neither move nor meet more than those. Any other takes the general point-in-time join, with the
    same result.
    """
    complete = F.lit(True)
    for clock in clocks:
        complete = complete & F.col(clock).isNotNull()
    known = F.greatest(*[F.col(c) for c in clocks]) if len(clocks) > 1 else F.col(clocks[0])
    usable = history.where(complete)
    width = F.length(F.to_json(F.struct(*order, *values)))
    by_day = usable.groupBy(_day(known).alias("day")).agg(F.count(F.lit(1)).alias("n"), F.sum(width).alias("bytes"))
    size = by_day.agg(
        F.sum("n").alias("n"), F.max("n").alias("most"), F.sum("bytes").alias("bytes"),
        F.min("day").alias("first"), F.max("day").alias("last"),
    ).first()
    if not size["n"]:
        return requests.select("*", *[F.lit(None).cast(history.schema[v].dataType).alias(v) for v in values])
    days = size["last"] - size["first"] + 1
    # A record is repeated on each day that it holds.
    if size["n"] + days > broadcast_rows or size["most"] > STEP_DAY or size["bytes"] / size["n"] * (size["n"] + days) > STEP_BYTES:
        return asof_join(requests, history, [], left_ts=at, clocks=clocks, order=order, values=values)
    record = F.struct(*order, *[F.col(v).alias(f"_v_{v}") for v in values])
    # An interval counts on each day it touches; the last one is open and stands for all later days.
    by_day = _step_function(usable, known, record).withColumn(
        "_slot", F.explode(F.sequence(_day("_t"), F.coalesce(_day("_until"), _day("_t"))))
    )
    hit = (
        (F.col("_slot") == F.least(_day(at), F.lit(size["last"])))
        & (F.col(at) >= F.col("_t"))
        & (F.col("_until").isNull() | (F.col(at) < F.col("_until")))
    )
    return requests.join(F.broadcast(by_day), hit, "left").select(
        *[requests[c] for c in requests.columns], *[F.col(f"_rec._v_{v}").alias(v) for v in values]
    )


def snapshot_as_of(requests: DataFrame, snapshots: DataFrame, at: str = "created_at") -> DataFrame:
    """Adds snapshot_id and snapshot_cutoff of the latest usable snapshot at the request time."""
    history = snapshots.where(F.col("schema_version") == SCHEMA_VERSION).select(
        F.col("id").alias("snapshot_id"), F.col("cutoff").alias("snapshot_cutoff"), "available_at"
    )
    return latest_as_of(
        requests, history, clocks=["snapshot_cutoff", "available_at"],
        order=["snapshot_cutoff", "available_at", "snapshot_id"], values=["snapshot_id", "snapshot_cutoff"], at=at,
    )


def active_deployment(deployments: DataFrame) -> DataFrame:
    """The row of the latest revision."""
    return deployments.agg(F.max_by(F.struct(*deployments.columns), "revision").alias("_d")).select("_d.*")


def deployment_as_of(
    requests: DataFrame, deployments: DataFrame, at: str = "created_at", broadcast_rows: int = STEP_ROWS
) -> DataFrame:
    history = deployments.select(
        "revision", "changed_at", F.col("model_version").alias("deployed_model"), F.col("rollout_percent").alias("deployed_percent")
    )
    return latest_as_of(
        requests, history, clocks=["changed_at"], order=["revision"],
        values=["deployed_model", "deployed_percent"], at=at, broadcast_rows=broadcast_rows,
    )


# ---- policy -------------------------------------------------------------------------------


def resolve_policy(
    requests: DataFrame,
    experiments: DataFrame,
    deployments: DataFrame,
    snapshots: DataFrame,
    models: DataFrame,
    assignments: DataFrame | None = None,
) -> DataFrame:
    """Adds target_model, arm, snapshot_id, policy, model_version and fallback_reason.

    Precedence of the reasons: baseline selected; experiment stopped; no snapshot (only with a
    target); stale snapshot, for all traffic; unknown model; invalid model. Requests of an
    experiment that does not exist are refused with ``unknown_experiment``. requests: id, user_id,
    query, created_at, limit, experiment_id.
    """
    config = experiments.select(
        F.col("id").alias("experiment_id"), "salt", F.col("model_version").alias("_treatment_model"),
        "treatment_percent", "active",
    )
    known = lookup_join(requests, config, "experiment_id").withColumn(
        "arm",
        F.when(
            F.col("active"),
            hashing.arm(F.col("experiment_id"), F.col("salt"), F.col("user_id"), F.col("treatment_percent")),
        ),
    )
    if assignments is not None:
        stored = assignments.select("experiment_id", "user_id", F.col("arm").alias("_stored"))
        known = (
            known.join(stored, ["experiment_id", "user_id"], "left")
            .withColumn("arm", F.when(F.col("active"), F.coalesce("_stored", "arm")))
            .drop("_stored")
        )
    placed = snapshot_as_of(deployment_as_of(known, deployments), snapshots)
    in_experiment = F.col("experiment_id").isNotNull()
    refused = in_experiment & F.col("active").isNull()
    target = F.when(in_experiment, F.when(F.col("arm") == "treatment", F.col("_treatment_model"))).when(
        hashing.in_rollout(F.col("deployed_model"), F.col("user_id"), F.col("deployed_percent")),
        F.col("deployed_model"),
    )
    age = F.floor((epoch_micros("created_at") - epoch_micros("snapshot_cutoff")) / F.lit(1_000_000))
    checked = with_violations(models, model_rules(), "_broken").select(
        F.col("version").alias("target_model"), (F.size("_broken") == 0).alias("_model_ok")
    )
    with_model = lookup_join(
        placed.withColumn("target_model", target).withColumn("snapshot_age_seconds", age), checked, "target_model"
    )
    no_target = F.col("target_model").isNull()
    stale = F.col("snapshot_age_seconds") > SNAPSHOT_MAX_AGE_SECONDS
    missing = F.col("snapshot_id").isNull()
    reason = (
        F.when(refused, "unknown_experiment")
        .when(stale, "stale_features")
        .when(missing & ~no_target, "missing_features")
        .when(in_experiment & ~F.col("active"), "experiment_stopped")
        .when(no_target, "baseline_selected")
        .when(F.col("_model_ok").isNull(), "missing_model")
        .when(~F.col("_model_ok"), "invalid_model")
    )
    return (
        with_model.withColumn("fallback_reason", reason)
        .withColumn(
            "policy",
            F.when(refused, F.lit(None)).when(F.col("fallback_reason").isNull(), "model").otherwise("baseline"),
        )
        .withColumn("model_version", F.when(F.col("policy") == "model", F.col("target_model")))
        .withColumn("snapshot_id", F.when(~stale, F.col("snapshot_id")))
        .withColumn("experiment_id", F.when(F.col("arm").isNotNull(), F.col("experiment_id")))
        .select(
            *[c for c in requests.columns if c != "experiment_id"], "experiment_id", "arm", "target_model",
            "snapshot_id", "snapshot_age_seconds", "policy", "model_version", "fallback_reason",
        )
    )


# ---- ranking ------------------------------------------------------------------------------


def _scored_candidates(contexts: DataFrame, candidates: DataFrame, ad_features: DataFrame, models: DataFrame) -> DataFrame:
    """The candidates of each distinct context with features and the model's probability ``_p``."""
    keys = ["query", "snapshot_id", "model_version"]
    pairs = contexts.select(*keys).distinct().join(candidates.select("query", "ad_id", "relevance"), "query")
    history = ad_features.select(
        "snapshot_id", "ad_id", F.col("impressions").alias("_i"), F.col("clicked_impressions").alias("_c")
    )
    counted = pairs.join(history, ["snapshot_id", "ad_id"], "left")
    impressions, clicked = F.coalesce("_i", F.lit(0)), F.coalesce("_c", F.lit(0))
    featured = counted.select(
        *keys, "ad_id",
        F.col("relevance").alias("text_relevance"),
        click_model.smoothed_ctr(impressions, clicked).alias("smoothed_ctr"),
        click_model.log_impressions(impressions).alias("log_impressions"),
        F.col("_i").isNull().alias("cold"),
        click_model.valid_inputs(F.col("relevance"), impressions, clicked).alias("_valid"),
    )
    parameters = models.select(
        F.col("version").alias("model_version"), "means", "scales", "coefficients", "intercept"
    )
    return click_model.with_probability(
        lookup_join(featured, parameters, "model_version"), "_p",
        ["text_relevance", "smoothed_ctr", "log_impressions"],
        *[F.col(c) for c in ("means", "scales", "coefficients", "intercept")],
    ).withColumn("_p", F.when(F.col("_valid"), F.col("_p")))


def rank_contexts(
    contexts: DataFrame, candidates: DataFrame, ad_features: DataFrame, models: DataFrame, keep: int = MAX_RESULTS
) -> DataFrame:
    """Ranks each distinct (query, snapshot_id, model_version).

    A context whose model yields one invalid score falls back to the baseline as a whole, which
    ``invalid_score`` records; ``missing`` counts its candidates without history, shown or not. Adds the features used, so nothing has to be joined again later.
    """
    keys = ["query", "snapshot_id", "model_version"]
    by_model = _scored_candidates(contexts, candidates, ad_features, models)
    # Retrieval depth bounds a context at 200 rows.
    context = Window.partitionBy(*keys)
    by_model = by_model.withColumn("missing", F.sum(F.col("cold").cast("long")).over(context))
    invalid = F.col("model_version").isNotNull() & (F.max(F.col("_p").isNull().cast("int")).over(context) == 1)
    scored = by_model.withColumn("invalid_score", invalid).withColumn(
        "score",
        F.when(F.col("model_version").isNotNull() & ~F.col("invalid_score"), F.col("_p")).otherwise(
            click_model.baseline_score(F.col("text_relevance"), F.col("smoothed_ctr"))
        ),
    )
    ranked = scored.withColumn(
        "position", F.row_number().over(context.orderBy(F.desc("score"), F.asc("ad_id")))
    ).where(F.col("position") <= keep)
    return ranked.select(
        *keys, "ad_id", "position", "score", "text_relevance", "smoothed_ctr", "log_impressions", "cold", "invalid_score",
        "missing",
    )


def serve(resolved: DataFrame, candidates: DataFrame, ad_features: DataFrame, models: DataFrame) -> DataFrame:
    """One row per answered request: policy, reason and the ``items`` shown, at most 50 by contract."""
    accepted = resolved.where(F.col("policy").isNotNull())
    ranked = rank_contexts(accepted, candidates, ad_features, models)
    item = F.struct("position", "ad_id", "score", "text_relevance", "smoothed_ctr", "log_impressions", "cold")
    keys = {"_snapshot": F.coalesce("snapshot_id", F.lit("")), "_model": F.coalesce("model_version", F.lit(""))}
    lists = (
        ranked.groupBy("query", "snapshot_id", "model_version")
        .agg(
            F.sort_array(F.collect_list(item)).alias("_items"), F.max("invalid_score").alias("_invalid"),
            F.max("missing").alias("_missing"),
        )
        .select("query", *[c.alias(name) for name, c in keys.items()], "_items", "_invalid", "_missing")
    )
    failed = F.coalesce(F.col("_invalid"), F.lit(False))
    return accepted.withColumns(keys).join(lists, ["query", *keys], "left").select(
        "id", "user_id", "query", "created_at",
        F.when(failed, "baseline").otherwise(F.col("policy")).alias("policy"),
        F.when(~failed, F.col("model_version")).alias("model_version"),
        "snapshot_id", "experiment_id", "arm",
        F.when(failed, "invalid_score").otherwise(F.col("fallback_reason")).alias("fallback_reason"),
        F.slice("_items", F.lit(1), F.col("limit").cast("int")).alias("items"),
        F.coalesce("_missing", F.lit(0)).alias("missing_features"),
    )


def request_log(served: DataFrame) -> DataFrame:
    return served.drop("items", "missing_features")


def result_rows(served: DataFrame) -> DataFrame:
    """request_id, ad_id, position, score and the captured features."""
    return served.select(F.col("id").alias("request_id"), F.explode("items").alias("_item")).select("request_id", "_item.*")


def serving_rollup(requests: DataFrame) -> DataFrame:
    """Requests by policy and fallback reason."""
    return requests.groupBy("policy", "fallback_reason").agg(F.count(F.lit(1)).alias("requests"))


def invalid_contexts(contexts: DataFrame, candidates: DataFrame, ad_features: DataFrame, models: DataFrame) -> DataFrame:
    """query, snapshot_id, model_version of the contexts whose model yields an invalid score.

    One maximum per context: nothing is ranked."""
    featured = _scored_candidates(contexts.where("model_version IS NOT NULL"), candidates, ad_features, models)
    keys = ["query", "snapshot_id", "model_version"]
    return featured.groupBy(*keys).agg(F.max(F.col("_p").isNull()).alias("_invalid")).where("_invalid").select(*keys)


def policy_rollup(resolved: DataFrame, candidates: DataFrame, ad_features: DataFrame, models: DataFrame) -> DataFrame:
    """``serving_rollup`` of requests that are not ranked: only invalid scores are looked for."""
    accepted = resolved.where(F.col("policy").isNotNull())
    broken = invalid_contexts(accepted, candidates, ad_features, models).withColumn("_broken", F.lit(True))
    same = ["query", "snapshot_id", "model_version"]
    failed = F.coalesce("_broken", F.lit(False))
    return serving_rollup(
        accepted.join(broken, same, "left").select(
            F.when(failed, "baseline").otherwise(F.col("policy")).alias("policy"),
            F.when(failed, "invalid_score").otherwise(F.col("fallback_reason")).alias("fallback_reason"),
        )
    )


def score_rollup(served: DataFrame) -> DataFrame:
    """By policy: the distribution of the scores shown, and how many candidates, shown or not, had no
    history, counted for every request."""
    shown = F.transform("items", lambda i: i["score"])
    per_request = served.select(
        "policy", "missing_features", F.coalesce(F.size("items"), F.lit(0)).alias("_n"),
        F.aggregate(F.coalesce(shown, F.array().cast("array<double>")), F.lit(0.0), lambda a, x: a + x).alias("_sum"),
        F.array_max(shown).alias("_max"),
    )
    return per_request.groupBy("policy").agg(
        F.sum(F.greatest("_n", F.lit(0)).cast("long")).alias("results"),
        F.sum("_sum").alias("score_total"),
        F.max("_max").alias("score_max"),
        F.sum("missing_features").alias("missing_features"),
    )


def feature_age(resolved: DataFrame) -> DataFrame:
    """Answered requests that saw a snapshot, and its mean and greatest age in seconds."""
    return resolved.where("policy IS NOT NULL AND snapshot_age_seconds IS NOT NULL").agg(
        F.count(F.lit(1)).alias("requests"),
        F.avg("snapshot_age_seconds").alias("mean_age"),
        F.max("snapshot_age_seconds").alias("max_age"),
    )


def hourly_sketches(values: DataFrame, value: str, at: str, by: Sequence[str], size: int = SKETCH_SIZE) -> DataFrame:
    """One row per hour of ``at`` and ``by``: ``hour, n`` and a quantile sketch of the finite values.

    Hours are what a report stores; any of them merge to longer periods (``merged_quantiles``). Null values,
    NaN and infinities are left out, an hour without a value has no row. A sketch holds a few times
    ``size`` values however many rows it has seen, and is built on the map side.
    """
    finite = values.where(F.col(value).isNotNull() & (F.abs(F.col(value).cast("double")) < F.lit(float("inf"))))
    sketch = F.kll_sketch_agg_double(F.col(value).cast("double"), F.lit(size))
    return finite.groupBy(F.date_trunc("hour", at).alias("hour"), *by).agg(F.count(F.lit(1)).alias("n"), sketch.alias("sketch"))


def merged_quantiles(sketches: DataFrame, by: Sequence[str], quantiles: Sequence[float] = (0.5, 0.95, 0.99), size: int = SKETCH_SIZE) -> DataFrame:
    """By ``by`` and quantile: ``n`` and a value whose rank is within about 0.6 % of n of the quantile's
    (``SKETCH_ERROR`` bounds it for practical purposes), from sketches of any hours."""
    merged = sketches.groupBy(*by).agg(F.sum("n").alias("n"), F.kll_merge_agg_double("sketch", F.lit(size)).alias("_sketch"))
    found = F.array(
        *[
            F.struct(F.lit(float(q)).alias("quantile"), F.kll_sketch_get_quantile_double("_sketch", F.lit(float(q))).alias("value"))
            for q in quantiles
        ]
    )
    return merged.select(*by, "n", F.inline(found)).select(*by, "quantile", "n", "value")


def quantiles_hold(values: DataFrame, found: DataFrame, value: str, by: Sequence[str], error: float = SKETCH_ERROR) -> DataFrame:
    """``found`` (of ``merged_quantiles``) with ``within``: whether exact ranks are within ``error`` of the quantile."""
    asked = found.groupBy(*by).agg(F.collect_list(F.struct("quantile", "value")).alias("_asked"))
    below = (
        values.where(F.col(value).isNotNull()).join(asked, list(by))
        .select(*by, F.col(value).cast("double").alias("_x"), F.explode("_asked").alias("_one"))
        .groupBy(*by, F.col("_one.quantile").alias("quantile"))
        .agg(F.sum((F.col("_x") < F.col("_one.value")).cast("long")).alias("_less"), F.sum((F.col("_x") <= F.col("_one.value")).cast("long")).alias("_upto"))
    )
    within = (F.col("_less") / F.col("n") <= F.col("quantile") + error) & (F.col("_upto") / F.col("n") >= F.col("quantile") - error)
    return found.join(below, [*by, "quantile"]).select(*by, "quantile", "n", within.alias("within"))
