"""Operators against plain Python on random tables with one hot key."""

from __future__ import annotations

import datetime as dt
import random
import re

import pytest
from pyspark.sql import functions as F

from clickloom.operators import asof, attribution, events, paging, search
from clickloom.sources.tables import typed_rows

START = dt.datetime(2026, 1, 1)


def moment(rng, days=4, step=600):
    return START + dt.timedelta(seconds=step * rng.randrange(days * 86_400 // step))


def key(rng):
    return "hot" if rng.random() < 0.4 else f"k{rng.randrange(6)}"


@pytest.mark.parametrize("unique", [False, True])
@pytest.mark.parametrize("hours", [1, 24])
def test_occurs_within(spark, unique, hours):
    rng = random.Random(hours)
    starts = [(i, f"k{i}" if unique else key(rng), moment(rng)) for i in range(200)]
    pool = [s[1] for s in starts]
    acts = [(rng.choice(pool), moment(rng)) for _ in range(300)]
    found = attribution.occurs_within(
        spark.createDataFrame(starts, "id INT, k STRING, t TIMESTAMP_NTZ"),
        spark.createDataFrame(acts, "k STRING, u TIMESTAMP_NTZ"),
        ["k"], start_ts="t", event_ts="u", window_hours=hours, unique=unique,
    )
    window = dt.timedelta(hours=hours)
    expected = {i: int(any(k == k2 and t <= u < t + window for k2, u in acts)) for i, k, t in starts}
    assert {r["id"]: r["clicked"] for r in found.collect()} == expected
    assert 0 < sum(expected.values()) < len(expected)


@pytest.mark.parametrize("minutes", [1, 60, 7 * 24 * 60])
@pytest.mark.parametrize("keyed", [True, False])
def test_asof_join(spark, minutes, keyed):
    rng = random.Random(minutes)
    left = [(i, key(rng), moment(rng)) for i in range(150)]
    left += [(1000 + i, *left[0][1:]) for i in range(50)]
    history = []
    for i in range(200):
        t = moment(rng)
        available = None if rng.random() < 0.1 else t + dt.timedelta(hours=rng.randrange(-2, 30))
        history.append((i, key(rng), t, available, float(i)))
    found = asof.asof_join(
        spark.createDataFrame(left, "id INT, k STRING, t TIMESTAMP_NTZ"),
        spark.createDataFrame(history, "rec INT, k STRING, e TIMESTAMP_NTZ, a TIMESTAMP_NTZ, v DOUBLE").drop(*([] if keyed else ["k"])),
        ["k"] if keyed else [], left_ts="t", clocks=["e", "a"], order=["e", "a", "rec"], values=["v"], slot_minutes=minutes,
    )
    expected = {}
    for i, k, t in left:
        seen = [h for h in history if (h[1] == k or not keyed) and h[3] is not None and h[2] <= t and h[3] <= t]
        expected[i] = max(seen, key=lambda h: (h[2], h[3], h[0]))[4] if seen else None
    got = found.collect()
    assert len(got) == len(left)
    assert {r["id"]: r["v"] for r in got} == expected


def sequential(deliveries, returned):
    """The contract, one delivery at a time."""
    stored, taken, out = {}, set(), {}
    hour = dt.timedelta(hours=1)
    for did, eid, req, ad, occurred, received in sorted(deliveries, key=lambda d: (d[5], d[0])):
        if None in (eid, req, ad, occurred):
            out[did] = ("rejected", "missing_field")
        elif eid in stored:
            out[did] = ("replay", None) if stored[eid] == (req, ad, occurred) else ("conflict", "event_id")
        elif occurred > received or occurred < received - hour:
            out[did] = ("rejected", "clock")
        elif (req, ad) not in returned:
            out[did] = ("rejected", "result_not_found")
        elif not returned[req, ad] <= occurred < returned[req, ad] + hour:
            out[did] = ("rejected", "exposure_window")
        elif (req, ad) in taken:
            out[did] = ("conflict", "exposure")
        else:
            stored[eid] = (req, ad, occurred)
            taken.add((req, ad))
            out[did] = ("accepted", None)
    return stored, out


@pytest.mark.parametrize("seed", [1, 2])
def test_impression_outcomes_match_sequential_processing(spark, seed):
    rng = random.Random(seed)
    created = {f"r{i}": START + dt.timedelta(minutes=5 * i) for i in range(8)}
    returned = {(r, f"a{j}"): t for r, t in created.items() for j in range(3)}
    deliveries = []
    for did in range(400):
        req = rng.choice(list(created) + ["unknown"])
        base = created.get(req, START)
        occurred = base + dt.timedelta(minutes=rng.choice([0, 0, 0, 1, 59, 60, -1]))
        received = occurred + dt.timedelta(minutes=rng.choice([0, 0, 1, 2, 60, 61, -1, 500]))
        eid = None if rng.random() < 0.02 else "hot" if rng.random() < 0.3 else f"e{rng.randrange(25)}"
        deliveries.append((did, eid, req, f"a{rng.randrange(3)}", occurred, received))
    ntz = "TIMESTAMP_NTZ"
    classified = events.classify_impressions(
        spark.createDataFrame(deliveries, f"delivery_id INT, id STRING, request_id STRING, ad_id STRING, occurred_at {ntz}, received_at {ntz}"),
        spark.createDataFrame(list(created.items()), f"id STRING, created_at {ntz}"),
        spark.createDataFrame(list(returned), "request_id STRING, ad_id STRING"),
    )
    _, expected = sequential(deliveries, returned)
    assert {r["delivery_id"]: (r["outcome"], r["reason"]) for r in classified.collect()} == expected
    assert {o for o, _ in expected.values()} == {"accepted", "replay", "conflict", "rejected"}


def test_click_outcomes_match_sequential_processing(spark):
    rng = random.Random(5)
    shown = {f"i{j}": (START + dt.timedelta(minutes=j), START + dt.timedelta(minutes=j + 5)) for j in range(5)}
    deliveries = []
    for did in range(300):
        imp = rng.choice(list(shown) + ["nowhere"])
        occurred = shown.get(imp, (START, START))[0] + dt.timedelta(minutes=rng.choice([0, 1, 6, 1439, 1440, -1]))
        received = occurred + dt.timedelta(minutes=rng.choice([0, 1, 6, 60, 61, -1, 900]))
        deliveries.append((did, "hot" if rng.random() < 0.3 else f"c{rng.randrange(20)}", imp, occurred, received))
    stored, expected = {}, {}
    hour, day = dt.timedelta(hours=1), dt.timedelta(hours=24)
    for did, cid, imp, occurred, received in sorted(deliveries, key=lambda d: (d[4], d[0])):
        if cid in stored:
            expected[did] = ("replay", None) if stored[cid] == (imp, occurred) else ("conflict", "event_id")
        elif occurred > received or occurred < received - hour:
            expected[did] = ("rejected", "clock")
        elif imp not in shown or shown[imp][1] > received:
            expected[did] = ("conflict", "impression_not_arrived")
        elif not shown[imp][0] <= occurred < shown[imp][0] + day:
            expected[did] = ("rejected", "attribution_window")
        else:
            stored[cid] = (imp, occurred)
            expected[did] = ("accepted", None)
    ntz = "TIMESTAMP_NTZ"
    classified = events.classify_clicks(
        spark.createDataFrame(deliveries, f"delivery_id INT, id STRING, impression_id STRING, occurred_at {ntz}, received_at {ntz}"),
        spark.createDataFrame([(k, *v) for k, v in shown.items()], f"id STRING, occurred_at {ntz}, received_at {ntz}"),
    )
    assert {r["delivery_id"]: (r["outcome"], r["reason"]) for r in classified.collect()} == expected


def test_lexical_candidates(spark):
    rng = random.Random(3)
    words = ["camera", "lens", "alpha", "beta", "tripod", "été"]
    ads = [(f"ad{i:03}", " ".join(rng.choice(words) for _ in range(rng.randrange(1, 6))), rng.choice(["Cameras", "Lens"])) for i in range(120)]
    asked = ["camera", "Camera  lens", "lens camera lens", "été-alpha", "missing camera", "beta", "..."]
    found = search.lexical_candidates(
        spark.createDataFrame([(q,) for q in asked], "query STRING"),
        spark.createDataFrame(ads, "id STRING, title STRING, category STRING"), depth=10,
    )
    expected = set()
    for q in asked:
        terms = set(q.lower().replace("-", " ").replace(".", " ").split())
        scored = []
        for ad, title, category in ads:
            have = f"{title} {category}".lower().split()
            if terms and terms <= set(have):
                raw = 0.1 * min(have.count(t) for t in terms)
                scored.append((-raw / (1 + raw), ad))
        expected |= {(q, ad, round(-s, 10), n + 1) for n, (s, ad) in enumerate(sorted(scored)[:10])}
    assert {(r["query"], r["ad_id"], round(r["relevance"], 10), r["rank"]) for r in found.collect()} == expected


def test_dense_index_and_pages(spark):
    ids = [f"{i:05d}" for i in random.Random(1).sample(range(90_000), 700)]
    df = spark.createDataFrame([(i,) for i in ids], "id STRING").repartition(5)
    position = {i: n for n, i in enumerate(sorted(ids))}
    assert {r["id"]: r["index"] for r in paging.with_dense_index(df, "id").collect()} == position
    pages = {r["id"]: r["page"] for r in paging.with_page_number(df, "id", 64).collect()}
    assert pages == {i: n // 64 for i, n in position.items()}
    read, after = [], None
    while True:
        page = paging.keyset_page(df, "id", after, 250).orderBy("id").collect()
        read += [r["id"] for r in page]
        after = page[-1]["next_after"] if page else None
        if after is None:
            break
    assert read == sorted(ids)


def test_latest_as_of_both_ways(spark):
    rng = random.Random(9)
    requests = spark.createDataFrame([(i, moment(rng)) for i in range(100)], "id INT, t TIMESTAMP_NTZ")
    rows = [(f"s{i}", moment(rng), moment(rng)) for i in range(30)]
    history = spark.createDataFrame(rows, "sid STRING, c TIMESTAMP_NTZ, a TIMESTAMP_NTZ")
    args = dict(clocks=["c", "a"], order=["c", "a", "sid"], values=["sid"], at="t")
    small = search.latest_as_of(requests, history, **args)
    large = search.latest_as_of(requests, history, broadcast_rows=0, **args)
    expected = {}
    for r in requests.collect():
        seen = [h for h in rows if h[1] <= r["t"] and h[2] <= r["t"]]
        expected[r["id"]] = max(seen, key=lambda h: (h[1], h[2], h[0]))[0] if seen else None
    for result in (small, large):
        assert {r["id"]: r["sid"] for r in result.collect()} == expected


def test_one_clock_and_a_crowded_day(spark):
    """Ten thousand publications on one day take the general join; one clock is enough for both forms."""
    rng = random.Random(10)
    day = START.replace(hour=0, minute=0, second=0, microsecond=0)
    history = spark.range(10_000).selectExpr("id AS rev", f"timestamp_ntz'{day}' + make_dt_interval(0, 0, 0, id * 8) AS c")
    asked = [(i, day + dt.timedelta(seconds=rng.randrange(-100, 100_000))) for i in range(200)]
    requests = spark.createDataFrame(asked, "id INT, t TIMESTAMP_NTZ")
    args = dict(clocks=["c"], order=["rev"], values=["rev"], at="t")
    want = {i: None if t < day else min(9_999, int((t - day).total_seconds() // 8)) for i, t in asked}
    found = search.latest_as_of(requests, history, **args)
    assert "BroadcastNestedLoopJoin" not in found._jdf.queryExecution().executedPlan().toString()
    assert {r["id"]: r["rev"] for r in found.collect()} == want
    few = history.where("rev % 500 = 0")
    both = [search.latest_as_of(requests, few, broadcast_rows=n, **args).collect() for n in (200_000, 0)]
    assert sorted(both[0]) == sorted(both[1])


def test_chain_of_blocked_ids(spark):
    """Each edge shares its id with the one before or its exposure with the one after: every second is taken."""
    n = 51
    rows = [(f"i{(k + 1) // 2}", f"r{k // 2}", "a", START, (START + dt.timedelta(seconds=k), k)) for k in range(n)]
    edges = spark.createDataFrame(
        rows, "id STRING, request_id STRING, ad_id STRING, occurred_at TIMESTAMP_NTZ, _at STRUCT<received_at: TIMESTAMP_NTZ, delivery_id: INT>"
    )
    taken = events.accept_impressions(edges).select("_at.delivery_id").collect()
    assert sorted(r[0] for r in taken) == list(range(0, n, 2))


def test_retrieval_against_every_ad(spark):
    """One token in every ad, and many queries on it."""
    rng = random.Random(3)
    names = ["red", "ring", "box", "lamp"]
    ads = [(f"a{k:03}", "thing " + " ".join(rng.choice(names) for _ in range(4)), "thing" if k % 3 else "other") for k in range(120)]
    queries = ["thing", "Thing!", "red ring", "Ring red", "thing lamp box", "nowhere", "red nowhere", "", "ring ring"] + [f"thing {x}" for x in names]
    frame = spark.createDataFrame(ads, "id STRING, title STRING, category STRING")
    asked = spark.createDataFrame([(q,) for q in queries], "query STRING")
    got = {}
    for r in search.lexical_candidates(asked, frame, 7).collect():
        got.setdefault(r["query"], {})[r["rank"]] = (r["ad_id"], round(r["relevance"], 12))
    for q in queries:
        terms = set(re.findall(r"\w+", q.lower()))
        scored = []
        for i, title, category in ads:
            words = f"{title} {category}".lower().split()
            least = min((words.count(t) for t in terms), default=0)
            if least:
                scored.append((-0.1 * least / (1 + 0.1 * least), i))
        assert got.get(q, {}) == {k + 1: (i, round(-s, 12)) for k, (s, i) in enumerate(sorted(scored)[:7])}, q


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "id INT, t TIMESTAMP_NTZ")
    history = spark.createDataFrame([], "sid STRING, c TIMESTAMP_NTZ")
    assert search.latest_as_of(none, history, clocks=["c"], order=["c"], values=["sid"], at="t").count() == 0
    one = spark.createDataFrame([(1, START)], "id INT, t TIMESTAMP_NTZ")
    assert search.latest_as_of(one, history, clocks=["c"], order=["c"], values=["sid"], at="t").first()["sid"] is None
    assert none.agg(F.count("*")).first()[0] == 0
    assert typed_rows(spark, "a STRING", []).count() == 0
