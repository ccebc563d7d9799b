"""A batch of search requests served and logged: assignments, requests, results."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.functions import text
from clickloom.operators import experiments, quality, search
from clickloom.sources import tables


@dataclass
class SearchTables:
    ads: DataFrame
    experiments: DataFrame
    deployments: DataFrame
    snapshots: DataFrame
    ad_features: DataFrame
    models: DataFrame
    assignments: DataFrame | None = None


def run(requests: DataFrame, source: SearchTables, output: str) -> DataFrame:
    """Writes below ``output`` and returns the refused requests with their violations.

    The served requests are written once; log and results are both read off that table.
    """
    checked = quality.with_violations(requests, quality.request_rules())
    valid, refused = quality.split_quarantine(checked)
    # From here on, in retrieval as in the log, a query is what is left without outer white space.
    valid = valid.withColumn("query", text.strip(F.col("query")))
    fresh = experiments.assign(valid, source.experiments, source.assignments)
    tables.write_new(fresh, f"{output}/assignments")
    resolved = search.resolve_policy(
        valid, source.experiments, source.deployments, source.snapshots, source.models, source.assignments
    )
    candidates = search.lexical_candidates(valid.select("query"), source.ads)
    served = search.serve(resolved, candidates, source.ad_features, source.models)
    tables.write_new(served, f"{output}/served")
    written = requests.sparkSession.read.schema(served.schema).parquet(f"{output}/served")
    tables.write_new(search.request_log(written), f"{output}/search_requests")
    tables.write_new(search.result_rows(written).drop("cold"), f"{output}/search_results")
    return refused
