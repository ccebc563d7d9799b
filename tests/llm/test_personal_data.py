"""Personal data: base spans against plain patterns, estimation against plain Python, added spans on planted texts."""

from __future__ import annotations

import hashlib
import math
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from clickloom.llm import personal_data as pii
from clickloom.llm.common import keep

from ..conftest import rows

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for k, d in enumerate(reversed(digits)):
        d = int(d) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def plain_spans(text):
    out = []
    for k, (kind, pattern) in enumerate(PLAIN.items()):
        for m in re.finditer(pattern, text or ""):
            digits = re.sub("[^0-9]", "", m.group())
            good = {
                "email": True, "ip": all(int(p) <= 255 for p in m.group().split(".")) if kind == "ip" else False,
                "card": 12 <= len(digits) <= 19 and luhn(digits), "phone": 9 <= len(digits) <= 15,
            }[kind]
            if good:
                out.append((m.start(), k, f"{kind}:{m.start()}:{m.end()}"))
    return [said for _, _, said in sorted(out)]


def want(doc, text):
    spans = plain_spans(text)
    return (doc, *[sum(s.startswith(kind + ":") for s in spans) for kind in pii.KINDS], hashlib.sha256(",".join(spans).encode()).hexdigest())


BASE_COLUMNS = ("doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
ODD = [
    (1, None), (2, ""), (None, "x@y.z"), (3, "a@b.c%d@e.f.g@h.i"), (3, "a@b@c.d a..b@c..d e@-.- é@é.fr"), (4, "1.2.3.4.5.6.7.8 0255.1.1.1 256.1.1.1 1.2.3"),
    (5, "+1 (784) 555-9263 4539578763621486 and 4539 5787 6362 1486"), (6, "5555-555-5555-4444 1 2 3 4 5 6 7 8 9 0 1 2"), (7, "+1((((((((( +1-2 +123456789 +1234567890123456"),
    (8, "📷 é 10.0.0.1\n10.0.0.2 📷a@b.co"), (9, "4" * 5000 + " " + "a" * 20000 + "@x." + "b." * 4000 + " 1.1.1." + "0" * 300 + "7"), (10, "1.2.3.4a@b.c+49 30 1234567x"),
]


def test_base_spans_of_odd_texts_and_the_table(spark, docs, documents):
    given = docs(*ODD)
    assert rows(pii.personal_spans(given), *BASE_COLUMNS) == sorted((want(*r) for r in ODD), key=lambda r: tuple((v is None, str(v)) for v in r))
    texts = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    assert rows(pii.personal_spans(documents), *BASE_COLUMNS) == sorted((want(*r) for r in texts), key=lambda r: tuple((v is None, str(v)) for v in r))


@settings(max_examples=2, deadline=None)
@given(st.lists(st.text("a1 +@.-(%é25", max_size=60), min_size=300, max_size=400))
def test_base_spans_of_random_texts(spark, texts):
    got = pii.personal_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert rows(got, *BASE_COLUMNS) == sorted((want(*r) for r in enumerate(texts)), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.fixture(scope="module")
def planted(spark):
    """Enough plain personal data to learn from, forms that the base patterns miss, and clean texts."""
    cards = [n for n in (f"4539{k:011d}{c}" for k in range(0, 90_000_000, 1_000_003) for c in range(10)) if luhn(n)]
    texts = [(k, f"Call me: phone +1 (2{k:02d}) 555-0{k:03d} or card {cards[k % len(cards)]}, mail u{k}@mail.example.com from 10.2.{k}.7 .") for k in range(100)]
    texts += [(100 + k, f"it {cards[k]} and +1 (3{k:02d}) 555-1{k:03d} as u{k}@mail.example.com of 10.3.{k}.8 is") for k in range(80)]
    wrong = str(int(cards[3]) + 1)
    texts += [
        (200, f"so +1 (784) 555-9263 {cards[5]} it is"), (201, f"call 784-555-9263 now"), (202, "write jane.doe [at] mail [dot] example [dot] com please"),
        (203, f"order {wrong} was sent"), (204, "Version 2.0.1 of 1999, pages 12-19, 3.14"), (205, "clean text without numbers"), (206, f"number {wrong} and {wrong}"),
        (207, "host 2001:0db8:85a3:0000:0000:8a2e:0370:7334 ok"),
    ]
    got = pii.personal_spans(spark.createDataFrame(texts, "doc_id long, text string"))
    return dict(texts), {r["doc_id"]: [s for s in r["spans"].split(",") if s] for r in got.collect()}


def test_base_spans_stay_and_new_ones_are_added(planted):
    texts, found = planted
    for doc, text in texts.items():
        assert set(plain_spans(text)) <= set(found[doc]), doc
    span = lambda doc, kind, piece: f"{kind}:{texts[doc].index(piece)}:{texts[doc].index(piece) + len(piece)}"
    card = re.search("4539[0-9]{12}", texts[200]).group()
    assert not plain_spans(texts[200]) and found[200] == [span(200, "phone", "+1 (784) 555-9263"), span(200, "card", card)]
    assert found[201] == [span(201, "phone", "784-555-9263")]
    assert found[202] == [span(202, "email", "jane.doe [at] mail [dot] example [dot] com")]
    assert found[207] == [span(207, "ip", "2001:0db8:85a3:0000:0000:8a2e:0370:7334")]


def test_clean_texts_and_numbers_that_fail_their_rule_are_left_alone(planted):
    _, found = planted
    assert [found[d] for d in (203, 204, 205, 206)] == [[], [], [], []]


def test_candidates_never_touch_base_spans(spark, documents):
    spans = pii.candidates(keep(pii.find_spans(documents), "found")).collect()
    sure = [(s["row"], s["start"], s["end"]) for s in spans if s["base"] and s["valid"]]
    for s in spans:
        if not s["base"]:
            assert not any(r == s["row"] and a < s["end"] and s["start"] < b for r, a, b in sure)


def test_reliabilities_against_plain_python(spark, monkeypatch):
    monkeypatch.setattr(pii, "SETTLED", 0.0)
    patterns = [(k, (k + f) % 3 - 1, r, g, c, e, 1 + (7 * k + f + 3 * r + g * c + e) % 13) for k in (0, 2) for f in range(3) for r in (-1, 0, 1) for g in (-1, 1) for c in (0, 1) for e in (-1, 0, 1)]
    got = pii.reliabilities(spark.createDataFrame(patterns, "kind int, form int, rule int, gazetteer int, context int, edges int, n long"), rounds=4)
    for kind in (0, 2):
        mine = [(p[1:6], p[6]) for p in patterns if p[0] == kind]
        chance = {votes: 1 / (1 + math.exp(-sum(votes))) for votes, _ in mine}
        for _ in range(4):
            yes = sum(n * chance[v] for v, n in mine)
            no = sum(n for _, n in mine) - yes
            prior = math.log((yes + 1) / (no + 1))
            weight = []
            for m in range(5):
                voted = {x: [(v, n) for v, n in mine if v[m] == x] for x in (-1, 1)}
                ys = {x: sum(n * chance[v] for v, n in voted[x]) for x in voted}
                ns = {x: sum(n for _, n in voted[x]) for x in voted}
                w = {}
                for x in (-1, 1):
                    u = 10 * (ns[x] + 1) / (ns[-1] + ns[1] + 2)
                    w[x] = math.log((ys[x] + u) / (sum(ys.values()) + 10)) - math.log((ns[x] - ys[x] + u) / (sum(ns.values()) - sum(ys.values()) + 10))
                weight.append([min(0, w[-1]), 0.0, max(0, w[1])])
            chance = {v: 1 / (1 + math.exp(-prior - sum(weight[m][v[m] + 1] for m in range(5)))) for v, _ in mine}
        assert got[kind][0] == pytest.approx(prior)
        assert got[kind][1] == [pytest.approx(w) for w in weight]


def test_no_python_in_the_plan_and_no_rows_of_no_rows(spark, docs):
    from clickloom.plans.inspect import formatted_plan

    empty = pii.personal_spans(docs().limit(0))
    assert "Python" not in formatted_plan(empty) and "Pandas" not in formatted_plan(empty) and rows(empty) == []
