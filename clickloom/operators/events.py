"""Classification of delivered events: accepted, replay, conflict or rejected.

The outcome of a delivery is the one it would have had if all deliveries were processed in
order of receipt (ties by delivery id). Deliveries: delivery_id (unique), id, the payload,
occurred_at, received_at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.functions.columns import epoch_micros, hours
from clickloom.schemas import ATTRIBUTION_HOURS, EXPOSURE_HOURS, LATENESS_HOURS
from clickloom.session import drop_scratch, scratch_table

#: Rows of blocked chains that one task folds in order.
FOLD_ROWS = 500_000


def _clock_problem() -> Column:
    return (F.col("occurred_at") > F.col("received_at")) | (
        F.col("occurred_at") < F.col("received_at") - hours(LATENESS_HOURS)
    )


def _missing(*names: str) -> Column:
    missing = F.lit(False)
    for name in names:
        missing = missing | F.col(name).isNull()
    return missing


def _order() -> Column:
    return F.struct("received_at", "delivery_id")


def outcomes(deliveries: DataFrame, stored: DataFrame, payload: list[str], otherwise: Column) -> DataFrame:
    """``stored``: id, _at (order of the accepted delivery), _payload. A known id decides before
    the rules do, so a late identical retry is still a replay."""
    joined = deliveries.join(stored, "id", "left")
    same = F.col("_payload") == F.struct(*payload)
    known = F.coalesce(F.col("_at") < _order(), F.lit(False))
    first = F.coalesce(F.col("_at") == _order(), F.lit(False))
    outcome = (
        F.when(F.col("problem") == "missing_field", "rejected")
        .when(first, "accepted")
        .when(known & same, "replay")
        .when(known, "conflict")
        .when(F.col("problem") == "impression_not_arrived", "conflict")
        .when(F.col("problem").isNotNull(), "rejected")
        .otherwise("conflict")
    )
    reason = (
        F.when(F.col("problem") == "missing_field", F.col("problem"))
        .when(first | (known & same), F.lit(None))
        .when(known, "event_id")
        .otherwise(F.coalesce(F.col("problem"), otherwise))
    )
    return joined.withColumn("outcome", outcome).withColumn("reason", reason).drop("_at", "_payload", "problem")


def _claims(edges: DataFrame) -> DataFrame:
    """Edges that come first both for their id and for their exposure.

    Two map-side reduced minima meet on the unique order of the edge; no id or exposure, however
    often it is used, is gathered in one place.
    """
    by_id = edges.groupBy("id").agg(F.min("_at").alias("_at"))
    by_exposure = edges.groupBy("request_id", "ad_id").agg(F.min("_at").alias("_at"))
    return by_id.join(by_exposure, "_at")


def _unblocked(rest: DataFrame, won: DataFrame) -> DataFrame:
    """What the winners leave: rows whose id and whose exposure are both still free."""
    return rest.join(won.select("id"), "id", "left_anti").join(
        won.select("request_id", "ad_id"), ["request_id", "ad_id"], "left_anti"
    )


def _fold(rest: DataFrame) -> DataFrame:
    """Greedy acceptance row by row, in order, by one task: only for a bounded number of rows."""

    def free(frames):
        ids, exposures = set(), set()
        for frame in frames:
            chosen = []
            for id, exposure in zip(frame["id"], zip(frame["request_id"], frame["ad_id"])):
                chosen.append(id not in ids and exposure not in exposures)
                if chosen[-1]:
                    ids.add(id)
                    exposures.add(exposure)
            yield frame.loc[chosen, ["_delivery"]]

    kind = rest.schema["_at"].dataType["delivery_id"].dataType.simpleString()
    # The sorted rows leave the clock behind: what comes back is the unique delivery.
    ordered = rest.repartition(1).sortWithinPartitions("_at").select("id", "request_id", "ad_id", F.col("_at.delivery_id").alias("_delivery"))
    won = ordered.mapInPandas(free, f"_delivery {kind}")
    return rest.join(won, F.col("_at.delivery_id") == F.col("_delivery")).select("_at", "id", "request_id", "ad_id")


def _earliest(rest: DataFrame, rows: int, bound: int) -> DataFrame | None:
    """The first rows of ``rest`` in order, near but not above ``bound``; None if ties leave no such cut."""
    clock = epoch_micros(F.col("_at.received_at"))
    cut = rest.agg(F.percentile_approx(clock, F.lit(0.8 * bound / rows), F.lit(100_000))).first()[0]
    early = rest.where(clock <= cut)
    return early if early.limit(bound + 1).count() <= bound else None


def accept_impressions(edges: DataFrame, fold_rows: int = FOLD_ROWS) -> DataFrame:
    """Greedy acceptance in order of receipt: an id and a (request, ad) are each taken once.

    ``edges`` are distinct valid payloads with the order ``_at`` of their first delivery. A round settles all
    edges that are first at both ends and drops what they block; normally nothing is left after one round.
    What is left of chains of edges that block each other is folded in order by one task as soon as it has at
    most ``fold_rows`` rows. More than that takes further rounds, and where a round settles less than half, the
    earliest ``fold_rows`` are folded, which depend on nothing later. Winners and rest are written once a
    round, and the rest of the round before is deleted.
    """
    rest, accepted = scratch_table(edges, "edges"), []

    def settle(rest: DataFrame, won: DataFrame) -> DataFrame:
        accepted.append(scratch_table(won, "accepted"))
        left = scratch_table(_unblocked(rest, accepted[-1]), "edges")
        drop_scratch(rest)
        return left

    before = None
    while True:
        rest = settle(rest, _claims(rest))
        rows = rest.count()
        if rows <= fold_rows:
            if rows:
                accepted.append(scratch_table(_fold(rest), "accepted"))
            break
        if before is not None and rows > before / 2 and (
            early := _earliest(rest, rows, fold_rows)
        ) is not None:
            rest = settle(rest, _fold(early))
        before = rows
    drop_scratch(rest)
    result = accepted[0]
    for won in accepted[1:]:
        result = result.unionByName(won)
    return result


def returned_results(requests: DataFrame, results: DataFrame) -> DataFrame:
    """``request_id, ad_id, returned_at`` of the results whose request is known."""
    known = requests.select(F.col("id").alias("request_id"), F.col("created_at").alias("returned_at"))
    return results.select("request_id", "ad_id").join(known, "request_id")


def checked_impressions(deliveries: DataFrame, requests: DataFrame, results: DataFrame) -> DataFrame:
    """``deliveries`` with the rule that each breaks by itself, kept once. requests: id, created_at; results:
    request_id, ad_id (unique pairs). Results that bring ``returned_at`` are those of ``returned_results``: many
    batches against the same tables join these once."""
    if "returned_at" in results.columns:
        # Both sides by a shuffle: a stored table may compress well, and a hot exposure is split.
        returned = results.select("request_id", "ad_id", F.col("returned_at").alias("_returned")).hint("merge")
    else:
        returned = returned_results(requests, results).withColumnRenamed("returned_at", "_returned")
    joined = deliveries.join(returned, ["request_id", "ad_id"], "left")
    outside = (F.col("occurred_at") < F.col("_returned")) | (
        F.col("occurred_at") >= F.col("_returned") + hours(EXPOSURE_HOURS)
    )
    # Kept once, by columns: the rounds of acceptance and the outcomes both start from it and read few of them.
    return scratch_table(
        joined.withColumn(
            "problem",
            F.when(_missing("id", "request_id", "ad_id", "occurred_at"), "missing_field")
            .when(_clock_problem(), "clock")
            .when(F.col("_returned").isNull(), "result_not_found")
            .when(outside, "exposure_window"),
        ).select(*deliveries.columns, "problem"),
        "checked",
    )


def distinct_edges(checked: DataFrame) -> DataFrame:
    """Distinct valid payloads with the order of their first delivery."""
    return checked.where("problem IS NULL").groupBy("id", "request_id", "ad_id", "occurred_at").agg(F.min(_order()).alias("_at"))


def first_deliveries(edges: DataFrame) -> DataFrame:
    """``id, _at, _payload`` of the edges that acceptance in order takes."""
    won = accept_impressions(edges).select("_at").join(edges, "_at")
    return won.select("id", "_at", F.struct("request_id", "ad_id", "occurred_at").alias("_payload"))


def classify_impressions(deliveries: DataFrame, requests: DataFrame, results: DataFrame) -> DataFrame:
    """All deliveries at once. requests: id, created_at; results: request_id, ad_id (unique pairs)."""
    checked = checked_impressions(deliveries, requests, results)
    stored = first_deliveries(distinct_edges(checked))
    return outcomes(checked, stored, ["request_id", "ad_id", "occurred_at"], F.lit("exposure"))


def checked_clicks(deliveries: DataFrame, impressions: DataFrame) -> DataFrame:
    """``deliveries`` with the rule that each breaks by itself. ``impressions``: accepted ones by id."""
    known = impressions.select(
        F.col("id").alias("impression_id"), F.col("occurred_at").alias("_shown"), F.col("received_at").alias("_arrived")
    )
    joined = deliveries.join(known, "impression_id", "left")
    outside = (F.col("occurred_at") < F.col("_shown")) | (
        F.col("occurred_at") >= F.col("_shown") + hours(ATTRIBUTION_HOURS)
    )
    return joined.withColumn(
        "problem",
        F.when(_missing("id", "impression_id", "occurred_at"), "missing_field")
        .when(_clock_problem(), "clock")
        .when(~F.coalesce(F.col("_arrived") <= F.col("received_at"), F.lit(False)), "impression_not_arrived")
        .when(outside, "attribution_window"),
    ).select(*deliveries.columns, "problem")


def first_clicks(checked: DataFrame) -> DataFrame:
    """``id, _at, _payload`` of the first valid delivery of each id."""
    payload = F.struct("impression_id", "occurred_at")
    return (
        checked.where("problem IS NULL")
        .groupBy("id")
        .agg(F.min(F.struct(_order().alias("_at"), payload.alias("_payload"), "id")).alias("_first"))
        # The id out of the reduced struct: both sides of the next join are shuffled for it.
        .select("_first.id", "_first._at", "_first._payload")
    )


def classify_clicks(deliveries: DataFrame, impressions: DataFrame) -> DataFrame:
    """All deliveries at once. ``impressions`` are the accepted ones: id, occurred_at, received_at."""
    checked = checked_clicks(deliveries, impressions)
    return outcomes(checked, first_clicks(checked), ["impression_id", "occurred_at"], F.lit("event_id"))


def accepted(classified: DataFrame) -> DataFrame:
    return classified.where("outcome = 'accepted'").drop("outcome", "reason", "delivery_id")


def ingest_rollup(impressions: DataFrame, clicks: DataFrame) -> DataFrame:
    """Deliveries by event type, outcome and reason."""
    both = impressions.select(F.lit("impression").alias("event_type"), "outcome", "reason").unionByName(
        clicks.select(F.lit("click").alias("event_type"), "outcome", "reason")
    )
    return both.groupBy("event_type", "outcome", "reason").agg(F.count(F.lit(1)).alias("deliveries"))
