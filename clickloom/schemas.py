"""Declared schemas and fixed contract values; nothing is inferred from data."""

from __future__ import annotations

# Fixed values of the click-v1 contract.
SCHEMA_VERSION = "click-v1"
FEATURES = ("textRelevance", "smoothedCtr", "logImpressions")
ATTRIBUTION_HOURS = 24
MATURITY_HOURS = 25
LATENESS_HOURS = 1
EXPOSURE_HOURS = 1
SNAPSHOT_MAX_AGE_SECONDS = 86_400
MAX_COUNT = 1_000_000_000_000
RETRIEVAL_DEPTH = 200
MAX_RESULTS = 50
MAX_REPORT_DAYS = 31
MAX_WINDOW_DAYS = 90

TRAINING_EXAMPLE = (
    "impressionId STRING, requestId STRING, adId STRING, predictionTime TIMESTAMP, "
    "impressionTime TIMESTAMP, labelAvailableAt TIMESTAMP, schemaVersion STRING, "
    "textRelevance DOUBLE, smoothedCtr DOUBLE, logImpressions DOUBLE, label DOUBLE"
)

TRAINING_FIELDS = tuple(field.split()[0] for field in TRAINING_EXAMPLE.split(", "))

TABLES: dict[str, str] = {
    "ads": "id STRING, title STRING, category STRING, created_at TIMESTAMP",
    "feature_snapshots": (
        "id STRING, schema_version STRING, window_start TIMESTAMP, cutoff TIMESTAMP, "
        "available_at TIMESTAMP, source_id STRING, content_hash STRING"
    ),
    "ad_features": "snapshot_id STRING, ad_id STRING, impressions BIGINT, clicked_impressions BIGINT",
    "models": (
        "version STRING, schema_version STRING, feature_names ARRAY<STRING>, means ARRAY<DOUBLE>, "
        "scales ARRAY<DOUBLE>, coefficients ARRAY<DOUBLE>, intercept DOUBLE, "
        "trained_through TIMESTAMP, validation_through TIMESTAMP, evaluation_as_of TIMESTAMP, "
        "training_rows BIGINT, validation_rows BIGINT, test_rows BIGINT, "
        "validation_log_loss DOUBLE, baseline_validation_log_loss DOUBLE, test_log_loss DOUBLE, "
        "baseline_test_log_loss DOUBLE, test_brier DOUBLE, source_id STRING"
    ),
    "deployments": "revision BIGINT, model_version STRING, rollout_percent INT, changed_at TIMESTAMP",
    "experiments": (
        "id STRING, salt STRING, model_version STRING, treatment_percent INT, active BOOLEAN, "
        "created_at TIMESTAMP"
    ),
    "assignments": "experiment_id STRING, user_id STRING, arm STRING, assigned_at TIMESTAMP",
    "search_requests": (
        "id STRING, user_id STRING, query STRING, created_at TIMESTAMP, policy STRING, "
        "model_version STRING, snapshot_id STRING, experiment_id STRING, arm STRING, fallback_reason STRING"
    ),
    "search_results": (
        "request_id STRING, ad_id STRING, position INT, score DOUBLE, text_relevance DOUBLE, "
        "smoothed_ctr DOUBLE, log_impressions DOUBLE"
    ),
    "impressions": (
        "id STRING, request_id STRING, ad_id STRING, occurred_at TIMESTAMP, received_at TIMESTAMP"
    ),
    "clicks": "id STRING, impression_id STRING, occurred_at TIMESTAMP, received_at TIMESTAMP",
    "training_examples": "export_id STRING, impression_id STRING, payload STRING",
    "run_manifest": "version STRING, source_id STRING, model_sha256 STRING, snapshot_sha256 STRING",
}
