"""Typed fixture tables; the values are fixed and given with their expected results."""

from __future__ import annotations

from clickloom.sources.tables import typed_rows

DAY, CUTOFF = "2026-09-01", "2026-09-04 00:00:00"


def at(text: str) -> str:
    return f"2026-{text}:00"


def impressions(spark):
    return typed_rows(
        spark,
        "impression_id STRING, ad_id STRING, impression_ts STRING, received_ts STRING, cost_cents BIGINT",
        [
            ("i1", "A1", at("09-01 10:00"), at("09-01 10:01"), 100),
            ("i2", "A1", at("09-01 11:00"), at("09-01 11:01"), 200),
            ("i3", "A2", at("09-01 23:50"), at("09-02 00:01"), 300),
            ("i4", "A3", at("09-01 12:00"), at("09-01 12:01"), 400),
            ("i5", "A1", at("09-02 10:00"), at("09-02 10:01"), 500),
            ("i6", "A1", at("09-01 15:00"), at("09-04 00:00"), 600),
        ],
        ("impression_ts", "received_ts"),
    )


def clicks(spark):
    return typed_rows(
        spark,
        "click_id STRING, impression_id STRING, click_ts STRING, received_ts STRING",
        [
            ("c1", "i1", at("09-01 10:05"), at("09-01 10:06")),
            ("c1", "i1", at("09-01 10:05"), at("09-01 10:06")),
            ("c2", "i1", at("09-01 10:10"), at("09-01 10:11")),
            ("c3", "i3", at("09-02 00:05"), at("09-02 00:06")),
            ("c4", "i4", at("09-02 12:00"), at("09-02 12:01")),
            ("c5", "i2", at("09-01 10:59"), at("09-01 11:01")),
            ("c6", "i2", at("09-01 11:05"), at("09-04 00:00")),
            ("c7", "missing", at("09-01 12:00"), at("09-01 12:01")),
        ],
        ("click_ts", "received_ts"),
    )


def lookup(spark):
    return typed_rows(spark, "ad_id STRING, category STRING", [("A1", "TECH"), ("A2", "HOME")])


def ranking(spark):
    return typed_rows(
        spark,
        "category STRING, ad_id STRING, impressions BIGINT, clicked BIGINT",
        [("TECH", "A1", 1000, 100), ("TECH", "A2", 1000, 100), ("TECH", "A3", 1000, 90),
         ("TECH", "A4", 1000, 80), ("TECH", "A5", 10, 9), ("HOME", "A6", 1000, 0)],
    )


def versions(spark):
    return typed_rows(
        spark,
        "event_id STRING, version BIGINT, received_ts STRING, delivery_id STRING, is_deleted BOOLEAN, value BIGINT",
        [
            ("E1", 1, at("09-01 10:00"), "d1", False, 10), ("E1", 2, at("09-01 09:00"), "d2", False, 12),
            ("E2", 1, at("09-01 08:00"), "d3", False, 20), ("E2", 2, at("09-01 09:00"), "d4", True, 0),
            ("E3", 3, at("09-02 10:00"), "d5", False, 30), ("E3", 3, at("09-02 10:00"), "d6", False, 30),
            ("E4", 1, at("09-01 08:00"), "d7", False, 40), ("E4", 2, at("09-04 00:00"), "d8", False, 42),
        ],
        ("received_ts",),
    )


def rolling(spark):
    return typed_rows(
        spark,
        "ad_id STRING, day STRING, impressions BIGINT, clicked BIGINT",
        [("A1", "2026-09-01", 100, 10), ("A1", "2026-09-03", 100, 20), ("A1", "2026-09-08", 100, 30)],
    ).selectExpr("ad_id", "to_date(day) AS day", "impressions", "clicked")


def skewed(spark):
    return typed_rows(
        spark, "event_id BIGINT, ad_id STRING, cost_cents BIGINT",
        [(i, "A1" if i < 8 else "A2" if i == 8 else "A9", 10) for i in range(10)],
    )


def batches(spark):
    return typed_rows(
        spark, "ad_id STRING, impressions BIGINT, clicked BIGINT",
        [("A1", 100, 10), ("A1", 1000, 50), ("A2", 0, 0), ("A3", 20, 4)],
    )


def assignments(spark):
    start = at("09-01 00:00")
    return typed_rows(
        spark, "user_id STRING, arm STRING, assigned_ts STRING",
        [("u1", "A", start), ("u2", "A", start), ("u3", "B", start), ("u4", "B", start)], ("assigned_ts",),
    )


def conversions(spark):
    return typed_rows(
        spark, "conversion_id STRING, user_id STRING, event_ts STRING, received_ts STRING",
        [
            ("x1", "u1", at("09-01 03:00"), at("09-01 03:01")), ("x1", "u1", at("09-01 03:00"), at("09-01 03:01")),
            ("x2", "u3", at("09-01 04:00"), at("09-01 04:01")), ("x3", "u4", at("09-01 05:00"), at("09-01 05:01")),
            ("x3", "u4", at("09-01 05:00"), at("09-01 05:01")), ("x4", "u2", at("09-02 00:00"), at("09-02 00:01")),
            ("x5", "outsider", at("09-01 06:00"), at("09-01 06:01")),
        ],
        ("event_ts", "received_ts"),
    )


def predictions(spark):
    return typed_rows(
        spark, "prediction_id STRING, user_id STRING, prediction_ts STRING",
        [("p1", "uA", at("09-03 10:00")), ("p2", "uB", at("09-03 10:00"))], ("prediction_ts",),
    )


def features(spark):
    return typed_rows(
        spark,
        "feature_record_id STRING, user_id STRING, event_ts STRING, available_ts STRING, feature_value DOUBLE",
        [
            ("f1", "uA", at("09-02 08:00"), at("09-02 08:01"), 1.0), ("f2", "uA", at("09-03 09:00"), at("09-03 11:00"), 9.0),
            ("f3", "uA", at("09-03 08:00"), at("09-03 08:01"), 3.0), ("f4", "uA", at("09-03 10:30"), at("09-03 10:31"), 4.0),
        ],
        ("event_ts", "available_ts"),
    )
