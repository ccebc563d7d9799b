"""The registered queries over the given tables, each beside its SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from clickloom.functions import click_model, hashing
from clickloom.functions.columns import between, matured
from clickloom.operators import (
    asof,
    attribution,
    evaluation,
    event_store,
    events,
    experiments,
    incremental,
    inverted_index,
    lookup,
    paging,
    publication,
    quality,
    search,
    training,
    windows,
)
from clickloom.plans import oracle as o
from clickloom.plans import training_run, views
from clickloom.schemas import FEATURES, MATURITY_HOURS, TRAINING_FIELDS
from clickloom.session import scratch_path, scratch_table
from clickloom.sources import bucketed, provenance, sorted_files, tables
from clickloom.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

DAY, LAST_DAY, CUTOFF = "2024-01-01", "2024-01-28", "2024-01-25 00:00:00"
START, AS_OF = datetime(2024, 1, 1), datetime(2024, 1, 29)
TRAIN_END, VALIDATION_END = datetime(2024, 1, 16), datetime(2024, 1, 22)


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = o.with_tables(sql)
        return fn

    return register


def r9(column: Column | str) -> Column:
    """Nine decimals: sums and logarithms differ in the last bits between engines and orders."""
    return F.round(column, 9)


# ---- cohorts and click-through rates --------------------------------------------------------


@query(
    "eligible_impressions",
    f"""SELECT impression_id, ad_id, user_id, impression_ts, received_ts, cost_cents FROM imp
    WHERE CAST(impression_ts AS DATE) BETWEEN DATE '{DAY}' AND DATE '{LAST_DAY}' AND received_ts < TIMESTAMP '{CUTOFF}'""",
)
def _(spark, sf):
    return attribution.eligible_impressions(views.impressions(spark, sf), DAY, CUTOFF, LAST_DAY)


_CTR = f"""SELECT ad_id, count(*) AS impressions, count(*) FILTER (WHERE hit) AS clicked,
    CAST(count(*) FILTER (WHERE hit) AS DOUBLE)/count(*) AS ctr
    FROM (SELECT i.ad_id, EXISTS (SELECT 1 FROM clk c WHERE c.user_id=i.user_id AND c.received_ts < TIMESTAMP '{CUTOFF}'
            AND c.click_ts>=i.impression_ts AND c.click_ts<i.impression_ts+INTERVAL 24 HOURS) AS hit
          FROM imp i WHERE CAST(i.impression_ts AS DATE) BETWEEN DATE '{DAY}' AND DATE '{LAST_DAY}'
            AND i.received_ts < TIMESTAMP '{CUTOFF}') GROUP BY ad_id"""


@query("clicked_impression_ctr", _CTR)
def clicked_impression_ctr(spark, sf):
    return attribution.clicked_impression_ctr(
        views.impressions(spark, sf), views.clicks(spark, sf), day=DAY, cutoff=CUTOFF, last_day=LAST_DAY, on=("user_id",)
    )


@query(
    "clicked_impression_ctr_sql",
    f"""SELECT ad_id, count(*) AS impressions, count(*) FILTER (WHERE hit) AS clicked,
    CAST(count(*) FILTER (WHERE hit) AS DOUBLE)/count(*) AS ctr
    FROM (SELECT i.ad_id, EXISTS (SELECT 1 FROM sclk c WHERE c.impression_id=i.id AND c.received_at < TIMESTAMP '{CUTOFF}'
            AND c.occurred_at>=i.occurred_at AND c.occurred_at<i.occurred_at+INTERVAL 24 HOURS) AS hit
          FROM simp i WHERE CAST(i.occurred_at AS DATE) BETWEEN DATE '{DAY}' AND DATE '{LAST_DAY}'
            AND i.received_at < TIMESTAMP '{CUTOFF}') GROUP BY ad_id""",
)
def _(spark, sf):
    shown = views.served_impressions(spark, sf).select(
        F.col("id").alias("impression_id"), "ad_id", F.col("occurred_at").alias("impression_ts"),
        F.col("received_at").alias("received_ts"),
    )
    acted = views.served_clicks(spark, sf).select(
        F.col("id").alias("click_id"), "impression_id", F.col("occurred_at").alias("click_ts"),
        F.col("received_at").alias("received_ts"),
    )
    return attribution.clicked_impression_ctr_sql(shown, acted, day=DAY, cutoff=CUTOFF, last_day=LAST_DAY)


@query(
    "mature_ctr_report",
    """SELECT ad_id, count(*) AS impressions, CAST(sum(label) AS BIGINT) AS clicked_impressions,
    CAST(sum(label) AS DOUBLE)/count(*) AS ctr FROM labelled GROUP BY ad_id ORDER BY ad_id""",
)
def _(spark, sf):
    return attribution.mature_ctr_report(
        views.served_impressions(spark, sf), views.served_clicks(spark, sf), START, AS_OF, AS_OF
    )


@query(
    "daily_counts_by_merge",
    """SELECT CAST(occurred_at AS DATE) AS day, ad_id, count(*) AS impressions, CAST(sum(label) AS BIGINT) AS clicked_impressions
    FROM labelled GROUP BY 1, 2""",
)
def _(spark, sf):
    """Counts as of the end of each period, from those of the period before and its delta; kept once a period."""
    shown, acted = views.served_impressions(spark, sf), views.served_clicks(spark, sf)
    in_range = scratch_table(shown.where(between("occurred_at", START, AS_OF)), "impressions")
    acted = scratch_table(acted, "clicks")
    counts = spark.createDataFrame([], "day date, ad_id string, impressions long, clicked_impressions long")
    since = START - timedelta(days=1)
    for until in (datetime(2024, 1, 9), datetime(2024, 1, 17), AS_OF):
        delta = incremental.daily_delta(in_range, acted, since, until, lateness_hours=None)
        counts, since = scratch_table(incremental.add_counts(counts, delta), "daily-counts"), until
    return counts


def _batches(spark, sf):
    return views.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("ad_id"),
        F.col("l_quantity").cast("long").alias("impressions"),
        F.floor(F.col("l_quantity") * F.col("l_discount")).cast("long").alias("clicked"),
    )


_POOLED = """SELECT l_partkey AS ad_id, CAST(sum(CAST(floor(l_quantity*l_discount) AS BIGINT)) AS BIGINT) AS clicked,
    CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS impressions FROM lineitem GROUP BY 1"""


@query("pooled_ctr", f"SELECT *, CASE WHEN impressions>0 THEN CAST(clicked AS DOUBLE)/impressions END AS ctr FROM ({_POOLED})")
def _(spark, sf):
    return attribution.pooled_ctr(_batches(spark, sf))


# ---- lookups, rankings, versions, calendars ---------------------------------------------------


def _categories(spark, sf):
    return views.table(spark, sf, "part").where("p_size > 15").select(
        F.col("p_partkey").alias("ad_id"), F.col("p_type").alias("category")
    )


@query(
    "lookup_join",
    """SELECT i.ad_id, impression_id, cost_cents, coalesce(p_type,'UNKNOWN') AS category FROM imp i
    LEFT JOIN (SELECT * FROM part WHERE p_size>15) ON p_partkey=i.ad_id""",
)
def _(spark, sf):
    facts = views.impressions(spark, sf).select("ad_id", "impression_id", "cost_cents")
    return lookup.lookup_join(facts, _categories(spark, sf), "ad_id", unknown={"category": "UNKNOWN"})


@query(
    "salted_lookup_join",
    """SELECT l_partkey AS ad_id, l_orderkey, l_linenumber, l_extendedprice, coalesce(p_type,'UNKNOWN') AS category
    FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size>15) ON p_partkey=l_partkey""",
)
def _(spark, sf):
    facts = views.table(spark, sf, "lineitem").select(
        F.col("l_partkey").alias("ad_id"), "l_orderkey", "l_linenumber", "l_extendedprice"
    )
    return lookup.salted_lookup_join(facts, _categories(spark, sf), "ad_id", unknown={"category": "UNKNOWN"})


_SALTED = """SELECT l_returnflag, l_orderkey, l_linenumber, n AS flag_rows FROM lineitem
    JOIN (SELECT l_returnflag, count(*) AS n FROM lineitem GROUP BY 1) USING (l_returnflag)"""


@query("salted_join_of_hot_keys", _SALTED)
def _(spark, sf):
    """Three keys share all rows, so each of them is salted at any size."""
    rows = views.table(spark, sf, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber")
    counts = rows.groupBy("l_returnflag").agg(F.count(F.lit(1)).alias("flag_rows"))
    return lookup.salted_lookup_join(rows, counts, "l_returnflag", share=0.02, min_rows=1)


@query(
    "top_ads_per_category",
    f"""SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY category ORDER BY ctr DESC, ad_id) AS INTEGER) AS rank
    FROM (SELECT b.ad_id, b.clicked, b.impressions, p_type AS category, CAST(b.clicked AS DOUBLE)/b.impressions AS ctr
          FROM ({_POOLED}) b JOIN part ON p_partkey=b.ad_id WHERE b.impressions>=500)) WHERE rank<=3""",
)
def _(spark, sf):
    categories = views.table(spark, sf, "part").select(
        F.col("p_partkey").alias("ad_id"), F.col("p_type").alias("category")
    )
    daily = attribution.pooled_ctr(_batches(spark, sf)).drop("ctr").join(categories, "ad_id")
    return windows.top_ads_per_category(daily, minimum=500)


@query(
    "latest_versions",
    """SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
      ORDER BY version DESC, received_ts DESC, delivery_id DESC) AS rn FROM (
        SELECT l_orderkey, l_linenumber, l_shipdate AS version, l_shipdate + to_days(CAST(l_suppkey%30 AS INTEGER)) AS received_ts,
          CAST(l_partkey AS VARCHAR)||'-'||CAST(l_suppkey AS VARCHAR)||'-'||CAST(CAST(round(l_extendedprice*100) AS BIGINT) AS VARCHAR) AS delivery_id,
          l_returnflag='R' AS is_deleted FROM lineitem) WHERE received_ts < TIMESTAMP '2001-01-01 00:00:00')
    WHERE rn=1 AND NOT is_deleted""",
)
def _(spark, sf):
    rows = views.table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber",
        F.col("l_shipdate").alias("version"),
        (F.col("l_shipdate") + F.make_dt_interval(days=(F.col("l_suppkey") % 30).cast("int"))).alias("received_ts"),
        F.concat_ws(
            "-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string"),
            F.round(F.col("l_extendedprice") * 100).cast("long").cast("string"),
        ).alias("delivery_id"),
        (F.col("l_returnflag") == "R").alias("is_deleted"),
    )
    return windows.latest_versions(rows, "2001-01-01 00:00:00", ("l_orderkey", "l_linenumber"))


def _daily(spark, sf):
    flagged = attribution.occurs_within(
        views.impressions(spark, sf), views.clicks(spark, sf), ["user_id"],
        start_ts="impression_ts", event_ts="click_ts",
    )
    return flagged.groupBy("ad_id", F.to_date("impression_ts").alias("day")).agg(
        F.count(F.lit(1)).alias("impressions"), F.sum("clicked").alias("clicked")
    )


_DENSE = """SELECT a.ad_id, CAST(c.day AS DATE) AS day, coalesce(d.impressions,0) AS impressions, coalesce(d.clicked,0) AS clicked
    FROM (SELECT DISTINCT ad_id FROM daily) a
    CROSS JOIN (SELECT unnest(generate_series(DATE '2024-01-01', DATE '2024-01-30', INTERVAL 1 DAY)) AS day) c
    LEFT JOIN daily d ON d.ad_id=a.ad_id AND d.day=c.day"""


@query("dense_calendar", _DENSE)
def _(spark, sf):
    return windows.dense_calendar(_daily(spark, sf), "2024-01-01", "2024-01-30", ["impressions", "clicked"])


@query(
    "rolling_ctr",
    f"""SELECT *, CASE WHEN impressions_7d>0 THEN CAST(clicked_7d AS DOUBLE)/impressions_7d END AS ctr_7d FROM (
      SELECT *, CAST(sum(impressions) OVER w AS BIGINT) AS impressions_7d, CAST(sum(clicked) OVER w AS BIGINT) AS clicked_7d
      FROM ({_DENSE}) WINDOW w AS (PARTITION BY ad_id ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))""",
)
def _(spark, sf):
    return windows.rolling_ctr(_daily(spark, sf), "2024-01-01", "2024-01-30")


@query(
    "point_in_time",
    """SELECT prediction_id, user_id, prediction_ts, feature_value FROM (
      SELECT p.*, f.feature_value, row_number() OVER (PARTITION BY p.prediction_id
        ORDER BY f.event_ts DESC NULLS LAST, f.available_ts DESC NULLS LAST, f.feature_record_id DESC NULLS LAST) AS rn
      FROM pit_pred p LEFT JOIN pit_feat f ON f.user_id=p.user_id AND f.event_ts<=p.prediction_ts AND f.available_ts<=p.prediction_ts)
    WHERE rn=1""",
)
def _(spark, sf):
    rows = views.events(spark, sf)
    predictions = rows.where("event_type = 'view'").select(
        F.col("event_id").alias("prediction_id"), "user_id", F.col("ts").alias("prediction_ts")
    )
    features = rows.where("event_type = 'purchase'").select(
        F.col("event_id").alias("feature_record_id"), "user_id", F.col("ts").alias("event_ts"),
        (F.col("ts") + F.make_dt_interval(days=(F.col("event_id") % 5).cast("int"))).alias("available_ts"),
        F.col("value").alias("feature_value"),
    )
    return asof.asof_join(
        predictions, features, ["user_id"], left_ts="prediction_ts", clocks=["event_ts", "available_ts"],
        order=["event_ts", "available_ts", "feature_record_id"], values=["feature_value"],
    )


# ---- Parquet by day ---------------------------------------------------------------------------


def _day_table(spark, sf) -> str:
    path = scratch_path(spark, "impressions-by-day")
    rows = views.impressions(spark, sf).withColumn("day", F.to_date("impression_ts"))
    tables.write_new(rows, path, partition_by="day")
    return path


@query(
    "parquet_day_scan",
    "SELECT impression_id, ad_id, cost_cents FROM imp WHERE CAST(impression_ts AS DATE)=DATE '2024-01-15'",
)
def _(spark, sf):
    return tables.read_day(spark, _day_table(spark, sf), "2024-01-15")


@query("cost_by_ad", "SELECT ad_id, CAST(sum(cost_cents) AS BIGINT) AS cost FROM imp WHERE cost_cents>=200 GROUP BY 1")
def _(spark, sf):
    return tables.cost_by_ad(views.impressions(spark, sf))


# ---- experiments --------------------------------------------------------------------------------


def _bucketed_customers(spark, sf):
    user = F.col("c_custkey").cast("string")
    return views.table(spark, sf, "customer").select(
        "c_custkey", "c_nationkey", "c_acctbal",
        hashing.bucket(F.lit("exp"), F.lit("salt"), user).alias("bucket"),
        hashing.arm(F.lit("exp"), F.lit("salt"), user, F.lit(50)).alias("arm"),
    )


_CUSTOMER_BUCKET = o._bucket("'exp'", "'salt'", "CAST(c_custkey AS VARCHAR)")


@query(
    "bucket_assignment",
    f"""SELECT c_custkey, {_CUSTOMER_BUCKET} AS bucket,
    CASE WHEN {_CUSTOMER_BUCKET}<5000 THEN 'treatment' ELSE 'control' END AS arm FROM customer""",
)
def _(spark, sf):
    return _bucketed_customers(spark, sf).select("c_custkey", "bucket", "arm")


@query(
    "rollout_bucket",
    f"""SELECT c_custkey, {o._bucket("'rollout'", "'model-a'", "CAST(c_custkey AS VARCHAR)")} < 500 AS at_5,
    {o._bucket("'rollout'", "'model-a'", "CAST(c_custkey AS VARCHAR)")} < 2500 AS at_25 FROM customer""",
)
def _(spark, sf):
    user = F.col("c_custkey").cast("string")
    return views.table(spark, sf, "customer").select(
        "c_custkey",
        hashing.in_rollout(F.lit("model-a"), user, F.lit(5)).alias("at_5"),
        hashing.in_rollout(F.lit("model-a"), user, F.lit(25)).alias("at_25"),
    )


@query("sticky_assignments", "SELECT experiment_id, user_id, arm, assigned_at FROM assigned")
def _(spark, sf):
    return experiments.assign(views.search_requests(spark, sf), views.experiments(spark, sf))


@query(
    "assigned_user_conversion",
    """SELECT arm, count(*) AS assigned_users, count(*) FILTER (WHERE hit) AS converted_users,
    CAST(count(*) FILTER (WHERE hit) AS DOUBLE)/count(*) AS conversion_rate FROM (
      SELECT arm, EXISTS (SELECT 1 FROM ev e WHERE e.event_type='purchase' AND e.user_id=a.user_id
        AND e.ts + to_minutes(e.event_id % 90) < TIMESTAMP '2024-01-29 00:00:00'
        AND e.ts>=a.assigned_ts AND e.ts<a.assigned_ts+INTERVAL 24 HOURS) AS hit
      FROM first_signup a WHERE a.assigned_ts+INTERVAL 24 HOURS<=TIMESTAMP '2024-01-29 00:00:00') GROUP BY arm""",
)
def _(spark, sf):
    rows = views.events(spark, sf)
    users = rows.where("event_type = 'signup'").groupBy("user_id").agg(F.min("ts").alias("assigned_ts"))
    assignments = users.withColumn(
        "arm", hashing.arm(F.lit("signup"), F.lit("v1"), F.col("user_id").cast("string"), F.lit(50))
    )
    conversions = rows.where("event_type = 'purchase'").select(
        "user_id", F.col("ts").alias("event_ts"), (F.col("ts") + views.minutes(F.col("event_id") % 90)).alias("received_ts")
    )
    return experiments.assigned_user_conversion(assignments, conversions, "2024-01-29 00:00:00")


_STATS = ("control_rate", "control_lower95", "control_upper95", "treatment_rate", "treatment_lower95", "treatment_upper95",
          "absolute_lift", "lift_lower95", "lift_upper95", "allocation_chi_square")


def _rounded_stats(df: DataFrame) -> DataFrame:
    return df.withColumns({c: r9(c) for c in _STATS})


def _compare_sql(source: str, key: str) -> str:
    """source: ``key``, cu, cc, tu, tc (bigint), pct."""
    z = o._Z

    def wilson(n: str, s: str, sign: str) -> str:
        p = f"({s}/{n})"
        den = f"(1+{z * z}::DOUBLE/{n})"
        half = f"({z}::DOUBLE*sqrt({p}*(1-{p})/{n}+{z * z}::DOUBLE/(4*{n}*{n}))/{den})"
        center = f"(({p}+{z * z}::DOUBLE/(2*{n}))/{den})"
        edge = f"greatest(0.0, {center}-{half})" if sign == "-" else f"least(1.0, {center}+{half})"
        return f"CASE WHEN {n}>0 THEN {edge} END"

    return f"""SELECT {key}, cu AS control_users, cc AS control_converted, tu AS treatment_users, tc AS treatment_converted,
      round(cr,9) AS control_rate, round(cl,9) AS control_lower95, round(ch,9) AS control_upper95,
      round(tr,9) AS treatment_rate, round(tl,9) AS treatment_lower95, round(th,9) AS treatment_upper95,
      round(tr-cr,9) AS absolute_lift,
      round(CASE WHEN both_arms THEN greatest(-1.0, tr-cr-sqrt(power(tr-tl,2)+power(ch-cr,2))) END,9) AS lift_lower95,
      round(CASE WHEN both_arms THEN least(1.0, tr-cr+sqrt(power(th-tr,2)+power(cr-cl,2))) END,9) AS lift_upper95,
      round(chi,9) AS allocation_chi_square,
      both_arms AND et>=5 AND ec>=5 AND chi>10.8275661707 AS sample_ratio_mismatch,
      NOT both_arms OR et<5 OR ec<5 OR cu<100 OR tu<100 AS small_sample
    FROM (SELECT *, cu>0 AND tu>0 AS both_arms, CASE WHEN cu>0 THEN cc/cud END AS cr, CASE WHEN tu>0 THEN tc/tud END AS tr,
        {wilson('cud', 'cc', '-')} AS cl, {wilson('cud', 'cc', '+')} AS ch, {wilson('tud', 'tc', '-')} AS tl, {wilson('tud', 'tc', '+')} AS th,
        CASE WHEN cud+tud=0 THEN 0 ELSE power(tu-et,2)/et+power(cu-ec,2)/ec END AS chi
      FROM (SELECT *, (cud+tud)*pct/100.0::DOUBLE AS et, (cud+tud)-(cud+tud)*pct/100.0::DOUBLE AS ec
        FROM (SELECT *, CAST(cu AS DOUBLE) AS cud, CAST(tu AS DOUBLE) AS tud FROM ({source}))))"""


@query(
    "experiment_comparison",
    _compare_sql(
        f"""SELECT c_nationkey, 50 AS pct, count(*) FILTER (WHERE NOT t) AS cu, count(*) FILTER (WHERE NOT t AND c_acctbal>5000) AS cc,
        count(*) FILTER (WHERE t) AS tu, count(*) FILTER (WHERE t AND c_acctbal>5000) AS tc
        FROM (SELECT *, {_CUSTOMER_BUCKET}<5000 AS t FROM customer) GROUP BY 1""",
        "c_nationkey",
    ),
)
def _(spark, sf):
    hit = F.col("c_acctbal") > 5000
    treated = F.col("arm") == "treatment"
    arms = _bucketed_customers(spark, sf).groupBy("c_nationkey").agg(
        F.sum((~treated).cast("long")).alias("control_users"),
        F.sum((~treated & hit).cast("long")).alias("control_converted"),
        F.sum(treated.cast("long")).alias("treatment_users"),
        F.sum((treated & hit).cast("long")).alias("treatment_converted"),
    ).withColumn("treatment_percent", F.lit(50))
    return _rounded_stats(experiments.compare_arms(arms)).drop("treatment_percent")


@query(
    "experiment_report",
    _compare_sql(
        f"""SELECT e.id, e.treatment_percent AS pct, count(*) FILTER (WHERE arm='control') AS cu,
        count(*) FILTER (WHERE arm='control' AND hit) AS cc, count(*) FILTER (WHERE arm='treatment') AS tu,
        count(*) FILTER (WHERE arm='treatment' AND hit) AS tc
        FROM exps e LEFT JOIN (SELECT a.*, EXISTS (SELECT 1 FROM sreq r JOIN simp i ON i.request_id=r.id JOIN sclk c ON c.impression_id=i.id
            WHERE r.experiment_id=a.experiment_id AND r.user_id=a.user_id AND c.occurred_at>=a.assigned_at
            AND c.occurred_at<a.assigned_at+INTERVAL 24 HOURS AND c.received_at<={o.AS_OF} AND i.received_at<={o.AS_OF}) AS hit
          FROM assigned a WHERE a.assigned_at+INTERVAL 25 HOURS<={o.AS_OF}) x ON x.experiment_id=e.id GROUP BY 1,2""",
        "id",
    ),
)
def _(spark, sf):
    requests, config = views.search_requests(spark, sf), views.experiments(spark, sf)
    report = experiments.experiment_report(
        config, experiments.assign(requests, config), requests,
        views.served_impressions(spark, sf), views.served_clicks(spark, sf), AS_OF,
    )
    counts = ["control_users", "control_converted", "treatment_users", "treatment_converted"]
    return _rounded_stats(report).select("id", *counts, *_STATS, "sample_ratio_mismatch", "small_sample")


# ---- training examples --------------------------------------------------------------------------


def _examples(spark, sf):
    return training.training_examples(
        views.served_impressions(spark, sf), views.served_clicks(spark, sf),
        views.search_requests(spark, sf), views.search_results(spark, sf), AS_OF,
    )


def _rounded_examples(df: DataFrame) -> DataFrame:
    return df.withColumns({c: r9(c) for c in ("textRelevance", "smoothedCtr", "logImpressions")})


_EXAMPLES = """SELECT * REPLACE (round("textRelevance",9) AS "textRelevance", round("smoothedCtr",9) AS "smoothedCtr",
    round("logImpressions",9) AS "logImpressions") FROM examples"""


@query("training_examples", _EXAMPLES)
def _(spark, sf):
    return _rounded_examples(_examples(spark, sf))


@query("training_examples_by_request", _EXAMPLES)
def _(spark, sf):
    """From tables bucketed by request; eight buckets at these sizes."""
    def stored(df, key, name):
        return bucketed.write_bucketed(df, key, name, scratch_path(spark, name), buckets=8)

    return _rounded_examples(
        training.training_examples_by_request(
            stored(views.served_impressions(spark, sf), "request_id", "impressions"), views.served_clicks(spark, sf),
            stored(views.search_requests(spark, sf), "id", "requests"),
            stored(views.search_results(spark, sf), "request_id", "results"), AS_OF,
        )
    )


@query(
    "frozen_export",
    _EXAMPLES,
)
def _(spark, sf):
    thawed = training.thaw_payloads(training.frozen_payloads(_examples(spark, sf), "export-1"))
    made = _examples(spark, sf).schema
    return _rounded_examples(thawed.select(*[F.col(c).cast(made[c].dataType) for c in TRAINING_FIELDS]))


@query(
    "keyset_page",
    """SELECT "impressionId", label, CASE WHEN more THEN last END AS next_after FROM (
      SELECT *, count(*) OVER ()>100 AS more, max(CASE WHEN n<=100 THEN "impressionId" END) OVER () AS last FROM (
        SELECT "impressionId", label, row_number() OVER (ORDER BY "impressionId") AS n FROM examples WHERE "impressionId">'4')
      WHERE n<=101) WHERE n<=100""",
)
def _(spark, sf):
    return paging.keyset_page(_examples(spark, sf).select("impressionId", "label"), "impressionId", "4", 100)


@query(
    "export_pages",
    """SELECT "impressionId", (row_number() OVER (ORDER BY "impressionId")-1)//100 AS page FROM examples""",
)
def _(spark, sf):
    return paging.with_page_number(_examples(spark, sf).select("impressionId"), "impressionId", 100)


@query(
    "page_of_sorted_files",
    """SELECT "impressionId", label, CASE WHEN more THEN last END AS next_after FROM (
      SELECT *, count(*) OVER ()>100 AS more, max(CASE WHEN n<=100 THEN "impressionId" END) OVER () AS last FROM (
        SELECT "impressionId", label, row_number() OVER (ORDER BY "impressionId") AS n FROM examples WHERE "impressionId">'8')
      WHERE n<=101) WHERE n<=100""",
)
def _(spark, sf):
    path = scratch_path(spark, "sorted-export")
    sorted_files.write_sorted(_examples(spark, sf).select("impressionId", "label"), "impressionId", path, file_rows=5_000)
    return sorted_files.page(spark, path, "impressionId", "8", 100)


def _split(spark, sf):
    return training.with_split(_examples(spark, sf), TRAIN_END, VALIDATION_END, AS_OF)


@query(
    "temporal_split_counts",
    "SELECT split, count(*) AS rows, CAST(sum(label) AS BIGINT) AS positives FROM split GROUP BY 1",
)
def _(spark, sf):
    return training.split_counts(_split(spark, sf))


@query(
    "split_adequacy",
    """SELECT split, count(*) AS rows, min(label) AS lowest, max(label) AS highest,
    count(*)>=20 AND min(label)<max(label) AS adequate FROM split GROUP BY 1""",
)
def _(spark, sf):
    return quality.split_adequacy(_split(spark, sf))


@query(
    "window_features",
    """SELECT "adId", count(*) AS impressions, CAST(sum(label) AS BIGINT) AS "clickedImpressions" FROM examples
    WHERE "impressionTime">=TIMESTAMP '2024-01-05 00:00:00' AND "impressionTime"<TIMESTAMP '2024-01-29 00:00:00' GROUP BY 1""",
)
def _(spark, sf):
    return attribution.window_counts(_examples(spark, sf), datetime(2024, 1, 5), AS_OF)


@query(
    "daily_features",
    """SELECT CAST("impressionTime" AS DATE) AS "eventDate", "adId", count(*) AS impressions,
    CAST(sum(label) AS BIGINT) AS "clickedImpressions" FROM examples GROUP BY 1,2""",
)
def _(spark, sf):
    return attribution.daily_counts(_examples(spark, sf))


@query(
    "click_features",
    f"""SELECT ad_id, snapshot_id, round({o._smoothed('i', 'c')},9) AS smoothed_ctr, round(ln(1+CAST(i AS DOUBLE)),9) AS log_impressions FROM afeat""",
)
def _(spark, sf):
    i, c = F.col("impressions"), F.col("clicked_impressions")
    return views.ad_features(spark, sf).select(
        "ad_id", "snapshot_id", r9(click_model.smoothed_ctr(i, c)).alias("smoothed_ctr"),
        r9(click_model.log_impressions(i)).alias("log_impressions"),
    )


# ---- contracts ----------------------------------------------------------------------------------

# One fault per band of the served value; the rules must name exactly that fault.
_FAULTS = """SELECT * REPLACE (
    CASE WHEN "logImpressions"<3 THEN 'x'||"impressionId" ELSE "impressionId" END AS "impressionId",
    CASE WHEN "logImpressions">=3 AND "logImpressions"<4 THEN 'click-v0' ELSE "schemaVersion" END AS "schemaVersion",
    CASE WHEN "logImpressions">=4 AND "logImpressions"<5 THEN 0.5 ELSE label END AS label,
    CASE WHEN "logImpressions">=5 AND "logImpressions"<5.5 THEN "impressionTime"+INTERVAL 1 HOUR ELSE "predictionTime" END AS "predictionTime",
    CASE WHEN "logImpressions">=5.5 AND "logImpressions"<6 THEN "impressionTime"+INTERVAL 24 HOURS
         WHEN "logImpressions">=6 AND "logImpressions"<6.5 THEN "labelAvailableAt"+INTERVAL 30 DAYS ELSE "labelAvailableAt" END AS "labelAvailableAt",
    CASE WHEN "logImpressions">=6.5 AND "logImpressions"<7 THEN NULL ELSE "adId" END AS "adId",
    CASE WHEN "logImpressions">=7 THEN -"textRelevance"-1 ELSE "textRelevance" END AS "textRelevance") FROM examples"""


def _faulty(spark, sf):
    x = F.col("logImpressions")

    def band(low, high):
        return (x >= low) & (x < high)

    replaced = {
        "impressionId": F.when(x < 3, F.concat(F.lit("x"), "impressionId")).otherwise(F.col("impressionId")),
        "schemaVersion": F.when(band(3, 4), "click-v0").otherwise(F.col("schemaVersion")),
        "label": F.when(band(4, 5), 0.5).otherwise(F.col("label")),
        "predictionTime": F.when(band(5, 5.5), F.col("impressionTime") + F.expr("INTERVAL 1 HOUR")).otherwise(F.col("predictionTime")),
        "labelAvailableAt": F.when(band(5.5, 6), F.col("impressionTime") + F.expr("INTERVAL 24 HOURS"))
        .when(band(6, 6.5), F.col("labelAvailableAt") + F.expr("INTERVAL 30 DAYS"))
        .otherwise(F.col("labelAvailableAt")),
        "adId": F.when(~band(6.5, 7), F.col("adId")),
        "textRelevance": F.when(x >= 7, -F.col("textRelevance") - 1).otherwise(F.col("textRelevance")),
    }
    return _examples(spark, sf).withColumns(replaced)


@query(
    "training_violations",
    f"""SELECT "requestId", "impressionId", CASE WHEN "adId" IS NULL THEN 'null_field'
      WHEN length("impressionId")<>36 THEN 'bad_uuid_impressionId' WHEN "schemaVersion"<>'click-v1' THEN 'schema_version'
      WHEN label NOT IN (0,1) THEN 'label' WHEN "predictionTime">"impressionTime" THEN 'prediction_after_impression'
      WHEN "labelAvailableAt"<"impressionTime"+INTERVAL 25 HOURS THEN 'label_too_early'
      WHEN "labelAvailableAt">{o.AS_OF} THEN 'label_in_future'
      WHEN "textRelevance"<0 OR "textRelevance">1 THEN 'range_textRelevance' ELSE '' END AS violations FROM ({_FAULTS})""",
)
def _(spark, sf):
    checked = quality.with_violations(_faulty(spark, sf), quality.training_rules(AS_OF))
    return checked.select("requestId", "impressionId", F.array_join("violations", ",").alias("violations"))


@query(
    "key_violations",
    """SELECT l_orderkey, l_linenumber, count(*) AS rows, 'duplicate_key' AS problem FROM lineitem GROUP BY 1,2 HAVING count(*)>1""",
)
def _(spark, sf):
    return quality.key_violations(views.table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "dependency_violations",
    """SELECT l_orderkey, min(l_shipdate) AS lowest, max(l_shipdate) AS highest FROM lineitem GROUP BY 1
    HAVING min(l_shipdate)<>max(l_shipdate)""",
)
def _(spark, sf):
    return quality.functional_dependency_violations(views.table(spark, sf, "lineitem"), "l_orderkey", "l_shipdate")


# White space that a strip removes, as code points of an RE2 class.
_RE2_SPACE = r"[\x09-\x0D\x1C-\x20\x{1680}\x{2000}-\x{2006}\x{2008}-\x{200A}\x{2028}\x{2029}\x{205F}\x{3000}]"


@query(
    "catalog_normalise",
    rf"""SELECT id, title, category, concat_ws(',', CASE WHEN length(title) NOT BETWEEN 1 AND 200 THEN 'title_length' END,
      CASE WHEN regexp_matches(title,'[\x00-\x1F\x7F-\x{{9F}}]') THEN 'title_control' END,
      CASE WHEN length(category) NOT BETWEEN 1 AND 64 THEN 'category_length' END,
      CASE WHEN regexp_matches(category,'[\x00-\x1F\x7F-\x{{9F}}]') THEN 'category_control' END) AS violations FROM (
      SELECT id, regexp_replace(regexp_replace(title,'^{_RE2_SPACE}+',''),'{_RE2_SPACE}+$','') AS title,
        regexp_replace(regexp_replace(category,'^{_RE2_SPACE}+',''),'{_RE2_SPACE}+$','') AS category FROM (
        SELECT p_partkey AS id, CASE WHEN p_size<10 THEN ' '||chr(8195)||p_name||chr(9) WHEN p_size<20 THEN chr(160)||p_name
          WHEN p_size<30 THEN repeat(p_name,25) WHEN p_size<35 THEN chr(9)||chr(32) WHEN p_size<40 THEN p_name||chr(133)||'x' ELSE p_name END AS title,
          CASE WHEN p_size>45 THEN repeat(p_type,12) ELSE p_type||' ' END AS category FROM part))""",
)
def _(spark, sf):
    size, name, kind = F.col("p_size"), F.col("p_name"), F.col("p_type")
    ads = views.table(spark, sf, "part").select(
        F.col("p_partkey").alias("id"),
        F.when(size < 10, F.concat(F.lit(" " + chr(8195)), name, F.lit(chr(9))))
        .when(size < 20, F.concat(F.lit(chr(160)), name))
        .when(size < 30, F.repeat(name, 25))
        .when(size < 35, F.lit(chr(9) + " "))
        .when(size < 40, F.concat(name, F.lit(chr(133) + "x")))
        .otherwise(name).alias("title"),
        F.when(size > 45, F.repeat(kind, 12)).otherwise(F.concat(kind, F.lit(" "))).alias("category"),
    )
    return quality.normalise_catalog(ads).withColumn("violations", F.array_join("violations", ","))


@query(
    "request_violations",
    r"""SELECT c_custkey, concat_ws(',', CASE WHEN length(trim(q))=0 OR length(q)>120 OR regexp_matches(q,'[\x00-\x1F]') THEN 'query' END,
      CASE WHEN NOT regexp_full_match(u,'[A-Za-z0-9][A-Za-z0-9._:-]{0,127}') THEN 'user_id' END,
      CASE WHEN l NOT BETWEEN 1 AND 50 THEN 'limit' END,
      CASE WHEN x IS NOT NULL AND NOT regexp_full_match(x,'[A-Za-z0-9][A-Za-z0-9._-]{0,79}') THEN 'experiment_id' END) AS violations FROM (
      SELECT c_custkey, CASE WHEN c_acctbal<0 THEN '  ' WHEN c_acctbal>9000 THEN repeat(c_mktsegment,20) ELSE c_mktsegment END AS q,
        c_name AS u, CAST(c_nationkey*3 AS INTEGER) AS l,
        CASE WHEN c_nationkey<10 THEN c_mktsegment||':'||c_nationkey WHEN c_nationkey<20 THEN 'exp-'||c_nationkey END AS x FROM customer)""",
)
def _(spark, sf):
    balance, nation, segment = F.col("c_acctbal"), F.col("c_nationkey"), F.col("c_mktsegment")
    requests = views.table(spark, sf, "customer").select(
        "c_custkey",
        F.when(balance < 0, "  ").when(balance > 9000, F.repeat(segment, 20)).otherwise(segment).alias("query"),
        F.col("c_name").alias("user_id"),
        (nation * 3).cast("int").alias("limit"),
        F.when(nation < 10, F.concat(segment, F.lit(":"), nation.cast("string")))
        .when(nation < 20, F.concat(F.lit("exp-"), nation.cast("string"))).alias("experiment_id"),
    )
    checked = quality.with_violations(requests, quality.request_rules())
    return checked.select("c_custkey", F.array_join("violations", ",").alias("violations"))


@query(
    "snapshot_violations",
    f"""SELECT DISTINCT snapshot_id, problem FROM (
      SELECT snapshot_id, 'counts' AS problem FROM afeat WHERE c>i-2
      UNION ALL SELECT snapshot_id, 'unknown_ad' FROM afeat f WHERE NOT EXISTS
        (SELECT 1 FROM part WHERE p_size>5 AND {o._named('ad', 'p_partkey')}=f.ad_id))""",
)
def _(spark, sf):
    # Two clicks are added to every count, so that busy ads break their bound.
    features = views.ad_features(spark, sf).withColumn("clicked_impressions", F.col("clicked_impressions") + 2)
    known = views.table(spark, sf, "part").where("p_size > 5").select(views.named("ad", F.col("p_partkey")).alias("id"))
    return quality.snapshot_row_violations(features, known)


@query(
    "publication_classes",
    """SELECT o_orderkey, CASE WHEN s.k IS NULL THEN 'created' WHEN s.h=sha256(o_orderpriority||'|'||o_orderstatus) THEN 'replay'
      ELSE 'conflict' END AS publication FROM orders LEFT JOIN
      (SELECT o_orderkey AS k, sha256(o_orderpriority||'|'||CASE WHEN o_totalprice<100000 THEN 'O' ELSE o_orderstatus END) AS h
       FROM orders WHERE o_orderstatus<>'P') s ON s.k=o_orderkey""",
)
def _(spark, sf):
    rows = views.table(spark, sf, "orders")

    def digest(status: Column) -> Column:
        return F.sha2(F.concat_ws("|", "o_orderpriority", status), 256).alias("content_hash")

    new = rows.select("o_orderkey", digest(F.col("o_orderstatus")))
    changed = F.when(F.col("o_totalprice") < 100000, "O").otherwise(F.col("o_orderstatus"))
    existing = rows.where("o_orderstatus <> 'P'").select("o_orderkey", digest(changed))
    return quality.classify_publication(new, existing, "o_orderkey").select("o_orderkey", "publication")


# ---- evaluation ---------------------------------------------------------------------------------


def _scored(spark, sf):
    return views.with_fixed_score(_examples(spark, sf), "p", ["textRelevance", "smoothedCtr", "logImpressions"])


@query(
    "model_quality",
    """SELECT r.model_version, count(*) AS impressions, round(avg(-(y*ln(p)+(1-y)*ln(1-p))),9) AS log_loss,
      round(avg(power(p-y,2)),9) AS brier, round(avg(y),9) AS ctr FROM (
        SELECT l.request_id, CAST(l.label AS DOUBLE) AS y, greatest(1e-15,least(1-1e-15,s.score)) AS p FROM labelled l
        JOIN sres s ON s.request_id=l.request_id AND s.ad_id=l.ad_id) x JOIN sreq r ON r.id=x.request_id
      WHERE r.policy='model' GROUP BY 1 ORDER BY 1""",
)
def _(spark, sf):
    report = evaluation.model_quality(
        views.served_impressions(spark, sf), views.served_clicks(spark, sf),
        views.search_requests(spark, sf), views.search_results(spark, sf), START, AS_OF, AS_OF,
    )
    return report.withColumns({c: r9(c) for c in ("log_loss", "brier", "ctr")})


@query(
    "probability_losses",
    """SELECT round(avg(-(label*ln(p)+(1-label)*ln(1-p))),9) AS log_loss, round(avg(power(p-label,2)),9) AS brier FROM scored""",
)
def _(spark, sf):
    return evaluation.probability_losses(_scored(spark, sf)).select(r9("log_loss").alias("log_loss"), r9("brier").alias("brier"))


@query(
    "constant_prior_losses",
    """SELECT round(avg(-(label*ln(p)+(1-label)*ln(1-p))),9) AS log_loss, round(avg(power(p-label,2)),9) AS brier
    FROM split, (SELECT avg(label) AS p FROM split WHERE split='train') WHERE split='test'""",
)
def _(spark, sf):
    split = _split(spark, sf)
    prior = split.where("split = 'train'").agg(F.avg("label")).first()[0]
    scored = split.where("split = 'test'").withColumn("p", F.lit(prior))
    return evaluation.probability_losses(scored).select(r9("log_loss").alias("log_loss"), r9("brier").alias("brier"))


@query(
    "area_under_roc",
    """SELECT round((sum(CASE WHEN label=1 THEN r END)-np*(np+1)/2.0)/(np*nn),9) AS auc FROM (
      SELECT label, rank() OVER (ORDER BY p)+(count(*) OVER (PARTITION BY p)-1)/2.0::DOUBLE AS r,
        CAST(sum(label) OVER () AS DOUBLE) AS np, count(*) OVER ()-CAST(sum(label) OVER () AS DOUBLE) AS nn
      FROM (SELECT label, p FROM scored)) GROUP BY np, nn""",
)
def _(spark, sf):
    return evaluation.area_under_roc(_scored(spark, sf)).select(r9("auc").alias("auc"))


def _ndcg_sql(score: str) -> str:
    return f"""SELECT round(coalesce(avg(dcg/ideal),0),9) AS ndcg, count(*) AS requests FROM (
      SELECT "requestId", sum(CASE WHEN r<=10 THEN label/log2(r+1) ELSE 0 END) AS dcg,
        sum(CASE WHEN b<=10 THEN label/log2(b+1) ELSE 0 END) AS ideal FROM (
        SELECT "requestId", label, row_number() OVER (PARTITION BY "requestId" ORDER BY {score} DESC, "adId") AS r,
          row_number() OVER (PARTITION BY "requestId" ORDER BY label DESC, "adId") AS b FROM scored)
      GROUP BY 1) WHERE ideal>0"""


@query("ndcg_at_10", _ndcg_sql("p"))
def _(spark, sf):
    return evaluation.ndcg_at(_scored(spark, sf), "p").withColumn("ndcg", r9("ndcg"))


@query("baseline_ndcg_at_10", _ndcg_sql('("textRelevance"+0.25::DOUBLE*"smoothedCtr")'))
def _(spark, sf):
    scored = _scored(spark, sf).withColumn(
        "baseline", click_model.baseline_score(F.col("textRelevance"), F.col("smoothedCtr"))
    )
    return evaluation.ndcg_at(scored, "baseline").withColumn("ndcg", r9("ndcg"))


_CALIBRATION = """SELECT CAST(least(9,floor(p*10)) AS INTEGER) AS bin, count(*) AS n, round(avg(p),9) AS "meanPrediction",
    round(avg(label),9) AS "observedRate" FROM scored GROUP BY 1 ORDER BY 1"""


@query("calibration", _CALIBRATION)
def _(spark, sf):
    return evaluation.calibration(_scored(spark, sf)).withColumns({c: r9(c) for c in ("meanPrediction", "observedRate")})


@query("calibration_json", f"""SELECT bin, n, round("meanPrediction",9) AS "meanPrediction", round("observedRate",9) AS "observedRate" FROM ({_CALIBRATION})""")
def _(spark, sf):
    """All four columns through JSON text and back: digits of doubles are written differently by engines."""
    rows = tables.json_rows(evaluation.calibration(_scored(spark, sf)))
    back = rows.select(F.from_json("json", "bin INT, n BIGINT, meanPrediction DOUBLE, observedRate DOUBLE").alias("j")).select("j.*")
    return back.withColumns({c: r9(c) for c in ("meanPrediction", "observedRate")})


@query(
    "model_gate",
    """SELECT version, CASE WHEN r=3 THEN 'scales' ELSE '' END AS violations, 0.5::DOUBLE+r*0.05::DOUBLE<=0.6::DOUBLE AS eligible FROM models""",
)
def _(spark, sf):
    checked = quality.with_violations(views.models(spark, sf), evaluation.model_rules())
    return checked.select(
        "version", F.array_join("violations", ",").alias("violations"), evaluation.promotion_eligible().alias("eligible")
    )


# ---- events -------------------------------------------------------------------------------------


def _impression_outcomes(spark, sf):
    return events.classify_impressions(
        views.impression_deliveries(spark, sf), views.search_requests(spark, sf), views.search_results(spark, sf)
    )


def _click_outcomes(spark, sf, impressions=None):
    shown = events.accepted(_impression_outcomes(spark, sf) if impressions is None else impressions)
    return events.classify_clicks(views.click_deliveries(spark, sf), shown)


@query("impression_outcomes", "SELECT * FROM iout")
def _(spark, sf):
    return _impression_outcomes(spark, sf)


@query("click_outcomes", "SELECT * FROM cout")
def _(spark, sf):
    return _click_outcomes(spark, sf)


@query(
    "ingest_rollup",
    """SELECT event_type, outcome, reason, count(*) AS deliveries FROM (
      SELECT 'impression' AS event_type, outcome, reason FROM iout UNION ALL SELECT 'click', outcome, reason FROM cout) GROUP BY 1,2,3""",
)
def _(spark, sf):
    shown = _impression_outcomes(spark, sf)
    return events.ingest_rollup(shown, _click_outcomes(spark, sf, shown))


def _delivery_batches(spark, sf, days=10):
    """Impression and click deliveries of every ``days`` days by receipt, written once, with the number of batches."""
    period = F.floor(F.datediff("received_at", F.lit(DAY)) / days).cast("int")
    number = F.greatest(F.coalesce(period, F.lit(0)), F.lit(0)).alias("_batch")
    shown = scratch_table(views.impression_deliveries(spark, sf).select("*", number), "impressions-by-batch")
    acted = scratch_table(views.click_deliveries(spark, sf).select("*", number), "clicks-by-batch")
    last = shown.select("_batch").union(acted.select("_batch")).agg(F.max("_batch")).first()[0]
    return shown, acted, range((last or 0) + 1)


def _served_tables(spark, sf):
    """Requests, and the results joined with them once for all batches; both written once."""
    requests = scratch_table(views.search_requests(spark, sf), "requests")
    return requests, scratch_table(events.returned_results(requests, views.search_results(spark, sf)), "results")


def _outcomes_by_batch(spark, sf, clicks):
    """Each batch decided against what earlier ones stored; after the second the store is merged once."""
    store = event_store.EventStore(spark, scratch_path(spark, "event-store"))
    shown, acted, numbers = _delivery_batches(spark, sf)
    requests, results = _served_tables(spark, sf)
    found = []
    for batch in numbers:
        of_batch = F.col("_batch") == batch
        out = event_store.classify_impression_batch(store, batch, shown.where(of_batch).drop("_batch"), requests, results)
        if clicks:
            out = event_store.classify_click_batch(store, batch, acted.where(of_batch).drop("_batch"))
        found.append(scratch_table(out, "outcomes"))
        if batch == 1:
            store.compact(2)
            store.drop_compacted(2)
    result = found[0]
    for out in found[1:]:
        result = result.unionByName(out)
    return result


@query("impression_outcomes_by_batch", "SELECT * FROM iout")
def _(spark, sf):
    return _outcomes_by_batch(spark, sf, clicks=False)


@query("click_outcomes_by_batch", "SELECT * FROM cout")
def _(spark, sf):
    return _outcomes_by_batch(spark, sf, clicks=True)


@query(
    "streaming_outcomes",
    """SELECT 'impression' AS event_type, delivery_id, id, outcome, reason FROM iout
    UNION ALL SELECT 'click', delivery_id, id, outcome, reason FROM cout""",
)
def _(spark, sf):
    shown, acted, numbers = _delivery_batches(spark, sf, days=15)
    folder, outcomes = scratch_path(spark, "deliveries"), scratch_path(spark, "stream-outcomes")
    rows = shown.withColumn("event_type", F.lit("impression")).unionByName(
        acted.withColumn("event_type", F.lit("click")), allowMissingColumns=True
    )
    # As an ingest leaves them: a file for each batch, the older ones first.
    for batch in numbers:
        rows.where(F.col("_batch") == batch).drop("_batch").coalesce(1).write.mode("append").parquet(folder)
    stream = spark.readStream.schema(rows.drop("_batch").schema).option("maxFilesPerTrigger", 1).parquet(folder)
    jobs.classify_available(
        stream, *_served_tables(spark, sf), store=scratch_path(spark, "event-store"), outcomes=outcomes,
        checkpoint=scratch_path(spark, "stream-state"),
    )
    return spark.read.schema("event_type string, delivery_id long, id string, outcome string, reason string").parquet(f"{outcomes}/batch=*")


# ---- search -------------------------------------------------------------------------------------


def _asked(spark, sf):
    part = views.table(spark, sf, "part")
    return (
        part.select(F.col("p_name").alias("query"))
        .union(part.select(F.concat_ws(" ", "p_name", "p_type")))
        .union(part.select("p_type"))
        .union(part.select(F.concat("p_name", F.lit(" unheard"))))
        .distinct()
    )


@query("lexical_search", "SELECT query, ad_id, round(relevance,9) AS relevance, rank FROM cand")
def _(spark, sf):
    return search.lexical_candidates(_asked(spark, sf), views.ads(spark, sf)).withColumn("relevance", r9("relevance"))


@query("indexed_search", "SELECT query, ad_id, round(relevance,9) AS relevance, rank FROM cand")
def _(spark, sf):
    """From a stored index; at these sizes ranges of 250 ads, so that retrieval has blocks to leave out."""
    path = scratch_path(spark, "inverted-index")
    inverted_index.write_index(views.ads(spark, sf), path, range_ads=250)
    found = inverted_index.retrieve(spark, _asked(spark, sf), path).candidates
    return found.withColumn("relevance", r9("relevance"))


@query(
    "snapshot_as_of",
    """SELECT s.id, n.snapshot_id, n.snapshot_cutoff FROM searches s LEFT JOIN snap_at n ON n.request_id=s.id""",
)
def _(spark, sf):
    return search.snapshot_as_of(views.search_input(spark, sf), views.snapshots(spark, sf)).select(
        "id", "snapshot_id", "snapshot_cutoff"
    )


def _resolved(spark, sf):
    return search.resolve_policy(
        views.search_input(spark, sf), views.experiments(spark, sf), views.deployments(spark, sf),
        views.snapshots(spark, sf), views.models(spark, sf),
    )


@query("policy_resolution", "SELECT * FROM resolved")
def _(spark, sf):
    return _resolved(spark, sf)


def _served(spark, sf):
    resolved = _resolved(spark, sf)
    candidates = search.lexical_candidates(views.search_input(spark, sf).select("query"), views.ads(spark, sf))
    return search.serve(resolved, candidates, views.ad_features(spark, sf), views.models(spark, sf))


@query(
    "ranked_results",
    """SELECT request_id, position, ad_id, round(score,9) AS score, round(x0,9) AS text_relevance, round(x1,9) AS smoothed_ctr,
    round(x2,9) AS log_impressions, cold FROM ranked""",
)
def _(spark, sf):
    results = search.result_rows(_served(spark, sf))
    return results.withColumns({c: r9(c) for c in ("score", "text_relevance", "smoothed_ctr", "log_impressions")})


@query(
    "deployment_as_of",
    """SELECT s.id, d.dm AS deployed_model, d.dp AS deployed_percent FROM searches s LEFT JOIN dep_at d ON d.request_id=s.id""",
)
def _(spark, sf):
    return search.deployment_as_of(views.search_input(spark, sf), views.deployments(spark, sf)).select(
        "id", "deployed_model", "deployed_percent"
    )


@query(
    "deployment_as_of_long_history",
    """SELECT s.id, d.dm AS deployed_model, d.dp AS deployed_percent FROM searches s LEFT JOIN dep_at d ON d.request_id=s.id""",
)
def _(spark, sf):
    """The form for histories beyond the broadcast bound."""
    return search.deployment_as_of(
        views.search_input(spark, sf), views.deployments(spark, sf), broadcast_rows=0
    ).select("id", "deployed_model", "deployed_percent")


@query(
    "serving_rollup",
    "SELECT policy, fallback_reason, count(*) AS requests FROM resolved WHERE policy IS NOT NULL GROUP BY 1,2",
)
def _(spark, sf):
    candidates = search.lexical_candidates(views.search_input(spark, sf).select("query"), views.ads(spark, sf))
    return search.policy_rollup(_resolved(spark, sf), candidates, views.ad_features(spark, sf), views.models(spark, sf))


@query(
    "score_rollup",
    """SELECT a.policy, coalesce(results,0) AS results, round(coalesce(score_total,0),6) AS score_total, round(score_max,9) AS score_max,
    coalesce(missing_features,0) AS missing_features FROM (SELECT DISTINCT policy FROM resolved WHERE policy IS NOT NULL) a
    LEFT JOIN (SELECT policy, count(*) AS results, sum(score) AS score_total, max(score) AS score_max FROM ranked GROUP BY 1) r ON r.policy=a.policy
    LEFT JOIN (SELECT policy, count(*) FILTER (WHERE cold) AS missing_features FROM pairs GROUP BY 1) m ON m.policy=a.policy""",
)
def _(spark, sf):
    return search.score_rollup(_served(spark, sf)).withColumn("score_total", F.round("score_total", 6)).withColumn(
        "score_max", r9("score_max")
    )


@query(
    "feature_age",
    """SELECT count(*) AS requests, round(avg(snapshot_age_seconds),6) AS mean_age, max(snapshot_age_seconds) AS max_age
    FROM resolved WHERE policy IS NOT NULL AND snapshot_age_seconds IS NOT NULL""",
)
def _(spark, sf):
    return search.feature_age(_resolved(spark, sf)).withColumn("mean_age", F.round("mean_age", 6))


@query(
    "score_quantiles",
    """SELECT policy, q::DOUBLE AS quantile, count(*) AS n, true AS within
    FROM ranked CROSS JOIN (VALUES (0.5),(0.95),(0.99)) t(q) GROUP BY 1,2""",
)
def _(spark, sf):
    """p50, p95 and p99 of the scores shown, from hourly sketches, held against exact ranks."""
    served = _served(spark, sf).select("policy", "created_at", F.explode("items").alias("_i"))
    shown = scratch_table(served.select("policy", "created_at", F.col("_i.score").alias("score")), "shown-scores")
    hours = search.hourly_sketches(shown, "score", "created_at", ["policy"])
    return search.quantiles_hold(shown, scratch_table(search.merged_quantiles(hours, ["policy"]), "quantiles"), "score", ["policy"])


@query(
    "feature_age_quantiles",
    """SELECT policy, q::DOUBLE AS quantile, count(*) AS n, true AS within
    FROM resolved CROSS JOIN (VALUES (0.5),(0.95),(0.99)) t(q) WHERE policy IS NOT NULL AND snapshot_age_seconds IS NOT NULL GROUP BY 1,2""",
)
def _(spark, sf):
    """The same of the snapshots' age."""
    seen = _resolved(spark, sf).where("policy IS NOT NULL AND snapshot_age_seconds IS NOT NULL")
    seen = seen.select("policy", "created_at", "snapshot_age_seconds")
    hours = search.hourly_sketches(seen, "snapshot_age_seconds", "created_at", ["policy"])
    found = scratch_table(search.merged_quantiles(hours, ["policy"]), "quantiles")
    return search.quantiles_hold(seen, found, "snapshot_age_seconds", ["policy"])


@query(
    "active_deployment",
    "SELECT revision, model_version, rollout_percent, changed_at FROM deps ORDER BY revision DESC LIMIT 1",
)
def _(spark, sf):
    return search.active_deployment(views.deployments(spark, sf))


@query("deployment_history", "SELECT revision, model_version, rollout_percent, changed_at FROM deps ORDER BY revision DESC LIMIT 100")
def _(spark, sf):
    return paging.deployment_history(views.deployments(spark, sf))


@query(
    "latest_models",
    "SELECT version, TIMESTAMP '2024-01-01 00:00:00' + to_days(CAST(r AS INTEGER)) AS registered_at FROM models ORDER BY 2 DESC, 1 LIMIT 100",
)
def _(spark, sf):
    return paging.latest_models(views.models(spark, sf).select("version", "registered_at"))


# ---- JSON ---------------------------------------------------------------------------------------


@query(
    "json_array_rows",
    "SELECT snapshot_id, ad_id AS \"adId\", i AS impressions, c AS \"clickedImpressions\" FROM afeat",
)
def _(spark, sf):
    one = F.to_json(
        F.array(F.struct(
            F.col("ad_id").alias("adId"), "impressions", F.col("clicked_impressions").alias("clickedImpressions")
        ))
    )
    published = views.ad_features(spark, sf).select("snapshot_id", one.alias("rows"))
    return tables.json_array_rows(published, "rows", "adId STRING, impressions BIGINT, clickedImpressions BIGINT")


# ---- streaming ----------------------------------------------------------------------------------

_STREAM_LIMIT = "(SELECT least((SELECT max(occurred_at) FROM simp), (SELECT max(occurred_at) FROM sclk)))"
_STREAM_LABELS = """SELECT i.id, i.ad_id, i.occurred_at, EXISTS (SELECT 1 FROM sclk c WHERE c.impression_id=i.id
    AND c.occurred_at>=i.occurred_at AND c.occurred_at<i.occurred_at+INTERVAL 24 HOURS) AS hit FROM simp i"""


def _as_stream(spark, df: DataFrame, name: str) -> DataFrame:
    """A file stream of a table, as an ingest would leave it in the shared folder."""
    path = scratch_path(spark, name)
    tables.write_new(df, path)
    return spark.readStream.schema(df.schema).parquet(path)


def _label_stream(spark, sf):
    shown = views.served_impressions(spark, sf).select(
        F.col("id").alias("impression_id"), "ad_id", F.col("occurred_at").cast("timestamp").alias("impression_ts")
    )
    acted = views.served_clicks(spark, sf).select(
        F.col("id").alias("click_id"), "impression_id", F.col("occurred_at").cast("timestamp").alias("click_ts")
    )
    return jobs.mature_labels(_as_stream(spark, shown, "impressions"), _as_stream(spark, acted, "clicks"))


def _run_stream(spark, stream: DataFrame, name: str) -> DataFrame:
    path, checkpoint = scratch_path(spark, name), scratch_path(spark, f"{name}-state")
    jobs.run_available(stream, path, checkpoint)
    return spark.read.schema(stream.schema).parquet(path)


@query(
    "streaming_mature_labels",
    f"""SELECT id AS impression_id, ad_id, CAST(CASE WHEN hit THEN 1 ELSE 0 END AS INTEGER) AS label FROM ({_STREAM_LABELS})
    WHERE occurred_at + INTERVAL 25 HOURS <= {_STREAM_LIMIT}""",
)
def _(spark, sf):
    labels = _run_stream(spark, _label_stream(spark, sf), "labels")
    ends = [
        views.served_impressions(spark, sf).agg(F.max("occurred_at")).first()[0],
        views.served_clicks(spark, sf).agg(F.max("occurred_at")).first()[0],
    ]
    # Positives come out at once; the report waits for their maturity as for that of the negatives.
    mature = matured(F.col("impression_ts").cast("timestamp_ntz"), min(ends), MATURITY_HOURS)
    return labels.where(mature).select("impression_id", "ad_id", "label")


@query(
    "streaming_daily_ctr",
    f"""SELECT CAST(occurred_at AS DATE) AS day, ad_id, count(*) AS impressions, count(*) FILTER (WHERE hit) AS clicked,
      CAST(count(*) FILTER (WHERE hit) AS DOUBLE)/count(*) AS ctr FROM ({_STREAM_LABELS})
    WHERE date_trunc('day',occurred_at) + INTERVAL 49 HOURS <= {_STREAM_LIMIT} GROUP BY 1,2""",
)
def _(spark, sf):
    return _run_stream(spark, jobs.daily_ctr(_label_stream(spark, sf)), "daily-ctr")


# ---- model fit ----------------------------------------------------------------------------------


def _ndcg_of(table: str, score: str) -> str:
    return _ndcg_sql(score).replace("FROM scored", f"FROM {table}").replace("round(coalesce(avg(dcg/ideal),0),9)", "coalesce(avg(dcg/ideal),0)")


_LOSS = "avg(-(label*ln({p})+(1-label)*ln(1-{p})))"
_METRICS = {
    **{f"{name}_rows": f"SELECT count(*) FROM split WHERE split='{name}'" for name in ("train", "validation", "test", "purged")},
    "validation_log_loss_reg_0.01": "SELECT loss FROM trials WHERE reg=0.01::DOUBLE",
    "validation_log_loss_reg_0.1": "SELECT loss FROM trials WHERE reg=0.1::DOUBLE",
    "selected_regularization": "SELECT reg FROM chosen",
    "validation_log_loss": "SELECT min(loss) FROM trials",
    **{
        f"baseline_{name}_log_loss": f"SELECT {_LOSS.format(p='prior')} FROM standard WHERE split='{name}'"
        for name in ("validation", "test")
    },
    "test_log_loss": f"SELECT {_LOSS.format(p='p')} FROM ftest",
    "test_brier": "SELECT avg(power(p-label,2)) FROM ftest",
    "test_auc": """SELECT (sum(CASE WHEN label=1 THEN r END)-np*(np+1)/2.0::DOUBLE)/(np*nn) FROM (
      SELECT label, rank() OVER (ORDER BY p)+(count(*) OVER (PARTITION BY p)-1)/2.0::DOUBLE AS r,
        CAST(sum(label) OVER () AS DOUBLE) AS np, count(*) OVER ()-CAST(sum(label) OVER () AS DOUBLE) AS nn FROM ftest) GROUP BY np, nn""",
    "model_ndcg_at_10": f"SELECT ndcg FROM ({_ndcg_of('ftest', 'p')})",
    "baseline_ndcg_at_10": f"SELECT ndcg FROM ({_ndcg_of('ftest', 'baseline')})",
    "scores_agree": "SELECT 1",
}


@query(
    "train_model",
    " UNION ALL ".join(f"SELECT '{name}' AS metric, round(CAST(({sql}) AS DOUBLE),3) AS value" for name, sql in _METRICS.items()),
)
def _(spark, sf):
    """The report of a run; ``scores_agree`` says that portable and fitted scores differ by at most 1e-9."""
    result = training_run.fit_and_evaluate(_examples(spark, sf), TRAIN_END, VALIDATION_END, AS_OF)
    within = F.when(F.col("metric") == "max_parity_error", (F.col("value") <= 1e-9).cast("double")).otherwise(F.round("value", 3))
    name = F.when(F.col("metric") == "max_parity_error", "scores_agree").otherwise(F.col("metric"))
    return result.report().select(name.alias("metric"), within.alias("value"))


_PARAMETERS = " UNION ALL ".join(
    f"SELECT reg AS regularization, '{feature}' AS feature, round(m{k},4) AS mean, round(s{k},4) AS scale, round(w{k},3) AS weight "
    "FROM fits CROSS JOIN tstats"
    for k, feature in enumerate(("textRelevance", "smoothedCtr", "logImpressions"))
)


@query(
    "fitted_parameters",
    _PARAMETERS + " UNION ALL SELECT reg, 'intercept', NULL, NULL, round(b,3) FROM fits",
)
def _(spark, sf):
    train = _split(spark, sf).where("split = 'train'").cache()
    rows, scaling = [], training.fit_scaling(train)
    for strength in (0.01, 0.1):
        found = training.model_parameters(training.fit_click_model(train, strength, scaling))
        rows += [
            (strength, name, round(m, 4), round(s, 4), round(w, 3))
            for name, m, s, w in zip(FEATURES, found["means"], found["scales"], found["coefficients"], strict=True)
        ]
        rows.append((strength, "intercept", None, None, round(found["intercept"], 3)))
    train.unpersist()
    return spark.createDataFrame(rows, "regularization DOUBLE, feature STRING, mean DOUBLE, scale DOUBLE, weight DOUBLE")


# ---- written forms and flags --------------------------------------------------------------------


def _written(spark, df: DataFrame, name: str, **settings) -> str:
    path = scratch_path(spark, name)
    tables.write_new(df, path, **settings)
    return path


@query("jsonl_round_trip", _EXAMPLES)
def _(spark, sf):
    made = _examples(spark, sf)
    path = _written(spark, made.select(*TRAINING_FIELDS), "examples-jsonl", fmt="json", options=training.JSON_TIMES)
    back = tables.read_training_jsonl(spark, path)
    return _rounded_examples(back.select(*[F.col(c).cast(made.schema[c].dataType) for c in TRAINING_FIELDS]))


@query(
    "daily_features_by_day_folder",
    """SELECT CAST("impressionTime" AS DATE) AS "eventDate", "adId", count(*) AS impressions,
    CAST(sum(label) AS BIGINT) AS "clickedImpressions" FROM examples GROUP BY 1,2""",
)
def _(spark, sf):
    path = _written(spark, attribution.daily_counts(_examples(spark, sf)), "daily-features", partition_by="eventDate")
    return spark.read.parquet(path).withColumn("eventDate", F.col("eventDate").cast("date"))


@query("catalog_ids", "SELECT id FROM ads")
def _(spark, sf):
    return tables.read_catalog_ids(spark, _written(spark, views.ads(spark, sf), "catalog", fmt="json"))


@query(
    "repeated_ads_in_snapshots",
    """SELECT DISTINCT snapshot_id, 'repeated_ad' AS problem FROM afeat WHERE i>=3""",
)
def _(spark, sf):
    features = views.ad_features(spark, sf)
    known = views.table(spark, sf, "part").select(views.named("ad", F.col("p_partkey")).alias("id"))
    twice = features.unionByName(features.where("impressions >= 3"))
    return quality.snapshot_row_violations(twice, known).where("problem = 'repeated_ad'")


@query(
    "digest_flags",
    """SELECT count(*) AS items, true AS same_rows_same_digest, count(*)>0 AS changed_row_changed_digest FROM lineitem""",
)
def _(spark, sf):
    """Digests of a table dealt anew, and of one with changed values."""
    rows = views.table(spark, sf, "lineitem")
    first = provenance.rows_sha256(rows).select("items", F.col("sha256").alias("a"))
    dealt = provenance.rows_sha256(rows.repartition(7, "l_partkey")).select(F.col("sha256").alias("b"))
    changed = F.when(F.col("l_linenumber") == 1, F.col("l_tax") + 1).otherwise(F.col("l_tax"))
    other = provenance.rows_sha256(rows.withColumn("l_tax", changed)).select(F.col("sha256").alias("c"))
    # One row each.
    return first.join(dealt).join(other).select(
        "items", (F.col("a") == F.col("b")).alias("same_rows_same_digest"), (F.col("a") != F.col("c")).alias("changed_row_changed_digest")
    )


@query(
    "request_log",
    """SELECT id, user_id, query, created_at, policy, model_version, snapshot_id, experiment_id, arm, fallback_reason
    FROM resolved WHERE policy IS NOT NULL""",
)
def _(spark, sf):
    return search.request_log(_served(spark, sf))


# ---- publication --------------------------------------------------------------------------------


@query(
    "snapshot_publication",
    f"""SELECT r.id, CASE WHEN n%7=0 OR cutoff>TIMESTAMP '2024-01-25 00:00:00' THEN 'refused' WHEN n%3=0 THEN 'replay' WHEN n%3=1 THEN 'conflict'
        WHEN bad.id IS NOT NULL THEN 'refused' ELSE 'created' END AS publication,
      CASE WHEN n%7=0 THEN 'schema_version' WHEN cutoff>TIMESTAMP '2024-01-25 00:00:00' THEN 'future_cutoff'
        WHEN n%3<2 THEN NULL WHEN bad.id IS NOT NULL THEN 'unknown_ad' END AS reason,
      CASE WHEN n%7=0 OR cutoff>TIMESTAMP '2024-01-25 00:00:00' THEN NULL WHEN n%3=0 THEN TIMESTAMP '2024-01-20 00:00:00'
        WHEN n%3=2 AND bad.id IS NULL THEN TIMESTAMP '2024-01-25 00:00:00' END AS available_at
    FROM (SELECT id, cutoff, CAST(epoch_us(cutoff)//86400000000 AS BIGINT) AS n FROM snaps) r
    LEFT JOIN (SELECT DISTINCT snapshot_id AS id FROM afeat f WHERE NOT EXISTS
      (SELECT 1 FROM part WHERE p_partkey>5 AND {o._named('ad', 'p_partkey')}=f.ad_id)) bad ON bad.id=r.id""",
)
def _(spark, sf):
    """Snapshots by day: some with another schema or from the future, some known with equal or other content."""
    now = datetime(2024, 1, 25)
    n = F.floor(F.unix_micros(F.col("cutoff").cast("timestamp")) / F.lit(86_400_000_000)).cast("long")
    made = views.snapshots(spark, sf).withColumn("n", n)
    requests = made.withColumn("schema_version", F.when(n % 7 == 0, "click-v0").otherwise(F.col("schema_version"))).select(
        "id", "schema_version", "window_start", "cutoff", "source_id"
    )
    features = views.ad_features(spark, sf)
    known = views.table(spark, sf, "part").where("p_partkey > 5").select(views.named("ad", F.col("p_partkey")).alias("id"))
    nothing = spark.createDataFrame([], "id STRING, content_hash STRING, available_at TIMESTAMP_NTZ")
    hashed = publication.publish_snapshots(requests, features, known, nothing, now)
    earlier = hashed.join(made.select("id", "n"), "id").where("n % 3 < 2").select(
        "id", F.when(F.col("n") % 3 == 0, F.col("content_hash")).otherwise("other").alias("content_hash"),
        F.lit(datetime(2024, 1, 20)).cast("timestamp_ntz").alias("available_at"),
    )
    published = publication.publish_snapshots(requests, features, known, earlier, now)
    return published.select("id", "publication", "reason", F.col("available_at").cast("timestamp_ntz").alias("available_at"))


@query(
    "model_registration",
    """SELECT version, CASE WHEN r=3 THEN 'refused' WHEN r=0 THEN 'replay' WHEN r=1 THEN 'conflict' ELSE 'created' END AS publication,
      CASE WHEN r=3 THEN 'scales' END AS reason,
      CASE WHEN r=3 OR r=1 THEN NULL WHEN r=0 THEN TIMESTAMP '2024-01-02 00:00:00' ELSE TIMESTAMP '2024-01-10 00:00:00' END AS registered_at
    FROM models""",
)
def _(spark, sf):
    models, now = views.models(spark, sf), datetime(2024, 1, 10)
    nothing = spark.createDataFrame([], "version STRING, content_hash STRING, registered_at TIMESTAMP_NTZ")
    hashed = publication.register_models(models, nothing, now).where("version IN ('model-0', 'model-1')")
    earlier = hashed.select(
        "version", F.when(F.col("version") == "model-0", F.col("content_hash")).otherwise("other").alias("content_hash"),
        F.lit(datetime(2024, 1, 2)).cast("timestamp_ntz").alias("registered_at"),
    )
    done = publication.register_models(models, earlier, now)
    return done.select("version", "publication", "reason", F.col("registered_at").cast("timestamp_ntz").alias("registered_at"))


@query(
    "deployment_violations",
    """SELECT c_custkey AS revision, concat_ws(',', CASE WHEN p<0 OR p>100 THEN 'percent' END,
      CASE WHEN m IS NULL AND p<>0 THEN 'percent_without_model' END, CASE WHEN m='model 0' THEN 'model_name' END,
      CASE WHEN m IS NOT NULL AND r IS NULL THEN 'unknown_model' END, CASE WHEN r*0.05::DOUBLE+0.5::DOUBLE>0.6::DOUBLE THEN 'gate' END) AS violations
    FROM (SELECT c_custkey, CAST(c_nationkey*5-10 AS INTEGER) AS p, CASE WHEN c_nationkey<3 THEN NULL WHEN c_nationkey=3 THEN 'model 0'
      ELSE 'model-'||CAST(c_custkey%6 AS VARCHAR) END AS m FROM customer) LEFT JOIN models ON version=m""",
)
def _(spark, sf):
    nation = F.col("c_nationkey")
    deployments = views.table(spark, sf, "customer").select(
        F.col("c_custkey").alias("revision"),
        F.when(nation < 3, F.lit(None)).when(nation == 3, "model 0")
        .otherwise(F.concat(F.lit("model-"), (F.col("c_custkey") % 6).cast("string"))).alias("model_version"),
        (nation * 5 - 10).cast("int").alias("rollout_percent"),
    )
    checked = publication.deployment_violations(deployments, views.models(spark, sf))
    return checked.select("revision", F.array_join("violations", ",").alias("violations"))
