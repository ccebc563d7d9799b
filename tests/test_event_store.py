"""Classification against stored events: batches equal one pass, a batch run again changes nothing, chains fold."""

from __future__ import annotations

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from clickloom.operators import event_store, events
from clickloom.plans.inspect import formatted_plan
from clickloom.streaming import jobs

from .conftest import rows
from .test_brute_force import START, sequential

NTZ = "TIMESTAMP_NTZ"
SHOWN = f"delivery_id BIGINT, id STRING, request_id STRING, ad_id STRING, occurred_at {NTZ}, received_at {NTZ}"
ACTED = f"delivery_id BIGINT, id STRING, impression_id STRING, occurred_at {NTZ}, received_at {NTZ}"


def made(seed, n=300):
    """Deliveries in order of receipt, with late retries, reused ids and exposures, and clicks on them."""
    rng = random.Random(seed)
    created = {f"r{i}": START + dt.timedelta(minutes=5 * i) for i in range(8)}
    returned = {(r, f"a{j}"): t for r, t in created.items() for j in range(3)}
    deliveries, clicks = [], []
    for did in range(n):
        req = rng.choice(list(created) + ["unknown"])
        occurred = created.get(req, START) + dt.timedelta(minutes=rng.choice([0, 0, 0, 1, 59, 60, -1]))
        received = occurred + dt.timedelta(minutes=rng.choice([0, 0, 1, 2, 60, 61, -1, 500]))
        eid = None if rng.random() < 0.02 else "hot" if rng.random() < 0.3 else f"e{rng.randrange(25)}"
        deliveries.append((did, eid, req, f"a{rng.randrange(3)}", occurred, received))
        if did % 6 == 0:
            deliveries.append((n + did, *deliveries[-1][1:5], received + dt.timedelta(minutes=150)))
        acted = received + dt.timedelta(minutes=rng.choice([0, 1, 30, -5]))
        clicks.append((did, f"c{rng.randrange(40)}", eid or "nowhere", acted, acted + dt.timedelta(minutes=rng.choice([0, 1, 60, 61, 700]))))
    return created, returned, sorted(deliveries, key=lambda d: (d[5], d[0])), sorted(clicks, key=lambda c: (c[4], c[0]))


def sequential_clicks(clicks, shown):
    """The contract of clicks, one delivery at a time. shown: id to (occurred, received)."""
    stored, out = {}, {}
    hour, day = dt.timedelta(hours=1), dt.timedelta(hours=24)
    for did, cid, imp, occurred, received in clicks:
        if cid in stored:
            out[did] = ("replay", None) if stored[cid] == (imp, occurred) else ("conflict", "event_id")
        elif occurred > received or occurred < received - hour:
            out[did] = ("rejected", "clock")
        elif imp not in shown or shown[imp][1] > received:
            out[did] = ("conflict", "impression_not_arrived")
        elif not shown[imp][0] <= occurred < shown[imp][0] + day:
            out[did] = ("rejected", "attribution_window")
        else:
            stored[cid] = (imp, occurred)
            out[did] = ("accepted", None)
    return out


def expected(deliveries, clicks, returned):
    stored, of_impressions = sequential(deliveries, returned)
    first = {}
    for did, eid, *_, received in deliveries:
        if of_impressions[did][0] == "accepted":
            first[eid] = (stored[eid][2], received)
    return of_impressions, sequential_clicks(clicks, first)


def context(spark, created, returned):
    requests = spark.createDataFrame(list(created.items()), f"id STRING, created_at {NTZ}")
    return requests, spark.createDataFrame(list(returned), "request_id STRING, ad_id STRING")


def outcomes(df):
    return {r["delivery_id"]: (r["outcome"], r["reason"]) for r in df.collect()}


def split(found, at, edges):
    """Rows by the batch that their receipt falls into."""
    return [[r for r in found if low <= r[at] < high] for low, high in zip(edges, edges[1:])]


EDGES = [START + dt.timedelta(minutes=m) for m in (-600, 21, 90, 5000)]


def test_batches_equal_one_pass_and_repeat_without_effect(spark, tmp_path):
    created, returned, deliveries, clicks = made(4)
    tables = context(spark, created, returned)
    of_impressions, of_clicks = expected(deliveries, clicks, returned)
    store = event_store.EventStore(spark, f"{tmp_path}/store", buckets=4)

    def run(batch, shown, acted):
        got = outcomes(event_store.classify_impression_batch(store, batch, spark.createDataFrame(shown, SHOWN), *tables))
        return got, outcomes(event_store.classify_click_batch(store, batch, spark.createDataFrame(acted, ACTED)))

    parts = list(zip(split(deliveries, 5, EDGES), split(clicks, 4, EDGES)))
    found = [run(batch, *part) for batch, part in enumerate(parts)]
    assert {k: v for shown, _ in found for k, v in shown.items()} == of_impressions
    assert {k: v for _, acted in found for k, v in acted.items()} == of_clicks
    # Late identical retries of other batches are among them.
    earlier = {did for did, (outcome, _) in found[0][0].items() if outcome == "accepted"}
    known = {d[1] for d in deliveries if d[0] in earlier}
    again = {d[0] for d in deliveries if d[1] in known}
    assert {"replay", "conflict"} <= {o for did, (o, _) in {**found[1][0], **found[2][0]}.items() if did in again}

    everything = {t: rows(store.read(t, 99)) for t in event_store.TABLES}
    assert run(1, *parts[1]) == found[1]
    assert {t: rows(store.read(t, 99)) for t in event_store.TABLES} == everything
    store.compact(1)
    store.drop_compacted(1)
    assert {t: rows(store.read(t, 99)) for t in event_store.TABLES} == everything
    assert run(2, *parts[2]) == found[2]
    with pytest.raises(ValueError):
        store.drop_compacted(2)


def test_an_attempt_that_broke_off_leaves_nothing(spark, tmp_path):
    """Rows of an attempt that ended between the tables are replaced by the next attempt."""
    created, returned, deliveries, _ = made(7, 80)
    tables = context(spark, created, returned)
    store = event_store.EventStore(spark, f"{tmp_path}/store", buckets=2)
    wrong = spark.createDataFrame([("e1", "r0", "a0", START, START, 999)], event_store.TABLES["impressions"][1])
    store.append("impressions", wrong, 0)
    got = outcomes(event_store.classify_impression_batch(store, 0, spark.createDataFrame(deliveries, SHOWN), *tables))
    assert got == sequential(deliveries, returned)[1]
    assert 999 not in {r["delivery_id"] for r in store.read("impressions", 1).collect()}


def test_a_batch_reads_only_its_buckets(spark, tmp_path):
    store = event_store.EventStore(spark, f"{tmp_path}/store", buckets=16)
    many = spark.range(400).select(
        F.concat(F.lit("e"), "id").alias("id"), F.lit("r").alias("request_id"), F.col("id").cast("string").alias("ad_id"),
        F.lit(START).cast("timestamp_ntz").alias("occurred_at"), F.lit(START).cast("timestamp_ntz").alias("received_at"), F.col("id").alias("delivery_id"),
    )
    store.append("impressions", many, 0)
    held = store.held("impressions", spark.createDataFrame([("e7",), ("e7",), (None,)], "id string"), 1)
    assert [r["id"] for r in held.collect()] == ["e7"]
    assert re.search(r"PartitionFilters: \[[^\]]*bucket#\d+ = \d+\)?\]", formatted_plan(held))
    assert store.held("impressions", spark.createDataFrame([("e7",)], "id string"), 0).isEmpty()


def test_empty_batches(spark, tmp_path):
    store = event_store.EventStore(spark, f"{tmp_path}/store")
    tables = context(spark, {"r": START}, {("r", "a"): START})
    for batch in (0, 1):
        assert outcomes(event_store.classify_impression_batch(store, batch, spark.createDataFrame([], SHOWN), *tables)) == {}
        assert outcomes(event_store.classify_click_batch(store, batch, spark.createDataFrame([], ACTED))) == {}
    assert store.read("clicks", 9).isEmpty()


def chain(n):
    """Each edge shares its id with the one before it or its exposure, in order: every second one is taken."""
    return [(f"e{k // 2}", "r", f"a{(k + 1) // 2}", (START + dt.timedelta(seconds=k), k)) for k in range(n)]


EDGE = f"id STRING, request_id STRING, ad_id STRING, _at STRUCT<received_at: {NTZ}, delivery_id: BIGINT>"


def test_a_long_chain_ends_in_few_jobs(spark):
    edges = spark.createDataFrame(chain(10_000), EDGE)
    spark.sparkContext.setJobGroup("chain", "chain of blocked edges")
    won = events.accept_impressions(edges)
    jobs_run = len(spark.sparkContext.statusTracker().getJobIdsForGroup("chain"))
    spark.sparkContext.setJobGroup("", "")
    assert sorted(r["_at"]["delivery_id"] for r in won.collect()) == list(range(0, 10_000, 2))
    assert jobs_run <= 25


@pytest.mark.parametrize("bound", (1, 40, 200))
def test_chains_beyond_the_bound(spark, bound):
    rng = random.Random(2)
    edges = chain(60) + [(f"x{rng.randrange(25)}", "q", f"b{rng.randrange(25)}", (START + dt.timedelta(seconds=rng.randrange(50)), 1000 + k)) for k in range(150)]
    ids, exposures, want = set(), set(), []
    for id, request, ad, at in sorted(edges, key=lambda e: e[3]):
        if id not in ids and (request, ad) not in exposures:
            ids.add(id)
            exposures.add((request, ad))
            want.append(at[1])
    won = events.accept_impressions(spark.createDataFrame(edges, EDGE), fold_rows=bound)
    assert sorted(r["_at"]["delivery_id"] for r in won.collect()) == sorted(want)


def test_stream_equals_one_pass_and_survives_a_failure(spark, tmp_path):
    created, returned, deliveries, clicks = made(9)
    tables = context(spark, created, returned)
    of_impressions, of_clicks = expected(deliveries, clicks, returned)
    schema = None
    for shown, acted in zip(split(deliveries, 5, EDGES), split(clicks, 4, EDGES)):
        both = spark.createDataFrame(shown, SHOWN).withColumn("event_type", F.lit("impression")).unionByName(
            spark.createDataFrame(acted, ACTED).withColumn("event_type", F.lit("click")), allowMissingColumns=True
        )
        schema = both.schema
        both.coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")

    def run():
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        jobs.classify_available(stream, *tables, store=f"{tmp_path}/store", outcomes=f"{tmp_path}/out", checkpoint=f"{tmp_path}/state", buckets=4)
        got = spark.read.parquet(f"{tmp_path}/out/batch=*").collect()
        return {(r["event_type"], r["delivery_id"]): (r["outcome"], r["reason"]) for r in got}, len(got)

    want = {**{("impression", k): v for k, v in of_impressions.items()}, **{("click", k): v for k, v in of_clicks.items()}}
    assert run() == (want, len(want))
    # The last batch's commit is lost, as in a failure after its work: it runs again and changes nothing.
    last = max((tmp_path / "state" / "commits").glob("[0-9]*"), key=lambda p: int(p.name))
    for file in (last, last.with_name(f".{last.name}.crc")):
        file.unlink(missing_ok=True)
    store = event_store.EventStore(spark, f"{tmp_path}/store", buckets=4)
    before = {t: rows(store.read(t, 99)) for t in event_store.TABLES}
    assert run() == (want, len(want))
    assert {t: rows(store.read(t, 99)) for t in event_store.TABLES} == before


def test_results_meet_their_requests_once_for_all_batches(spark, tmp_path):
    """Joined results give the same outcomes, and a batch moves neither the requests nor the results twice."""
    requests = spark.createDataFrame([("r1", dt.datetime(2024, 1, 1)), ("r2", dt.datetime(2024, 1, 1))], "id string, created_at timestamp_ntz")
    results = spark.createDataFrame([("r1", "a"), ("r1", "b"), ("r2", "a"), ("r9", "a")], "request_id string, ad_id string")
    at, late = dt.datetime(2024, 1, 1, 0, 5), dt.datetime(2024, 1, 1, 2)
    shown = [(k, f"i{k}", r, ad, t, t) for k, (r, ad, t) in enumerate([("r1", "a", at), ("r1", "a", at), ("r2", "a", late), ("r9", "a", at), ("r2", "b", at), (None, "a", at)])]
    deliveries = spark.createDataFrame(shown, SHOWN)
    joined = events.returned_results(requests, results)
    found = [outcomes(events.classify_impressions(deliveries, requests, given)) for given in (results, joined)]
    assert found[0] == found[1] and len(set(found[0].values())) == 5
    stored = event_store.EventStore(spark, str(tmp_path / "store"), 4)
    unread = requests.where("raise_error('requests are joined already') IS NULL")
    assert outcomes(event_store.classify_impression_batch(stored, 0, deliveries, unread, joined)) == found[0]
