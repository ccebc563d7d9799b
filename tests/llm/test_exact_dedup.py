from __future__ import annotations

import hashlib
import random

from clickloom.llm import exact_dedup as ed


def test_filter_against_a_set():
    draw, live = random.Random(4), set()
    stored: dict = {}
    cuckoo = ed.CuckooFilter(lambda: stored, 8)
    digests = [hashlib.sha256(str(k).encode()).hexdigest() for k in range(3000)]
    for _ in range(9000):
        digest = draw.choice(digests)
        if digest in live:
            assert digest in cuckoo
            if draw.random() < 0.4:
                live.discard(digest)
                del stored[digest]
                cuckoo.delete(digest)
        else:
            live.add(digest)
            stored[digest] = 1
            cuckoo.insert(digest)
    assert all(d in cuckoo for d in live)
    assert sum(d in cuckoo for d in digests if d not in live) < 20  # false positives
    assert cuckoo.live == len(live) and int((cuckoo.table > 0).sum()) == len(live)


def rows_of(index):
    return {r["digest"]: (r["keep_id"], r["group_size"]) for r in index.collect()}


def test_index_inserts_and_deletes(spark):
    a, b, c = (hashlib.sha256(x).hexdigest() for x in (b"a", b"b", b"c"))
    first = spark.createDataFrame([(a, 5, "x"), (a, 3, "x"), (b, 9, "x"), (None, 1, "x")], "digest string, doc_id long, bucket string")
    index = ed.update_index(ed.empty_index(spark), first, buckets=2)
    assert rows_of(index) == {a: (3, 2), b: (9, 1)}
    gone = spark.createDataFrame([(a,), (c,), (a,)], "digest string")
    index = ed.update_index(index, removed=gone, buckets=2)
    assert rows_of(index) == {b: (9, 1)}
    index = ed.update_index(index, spark.createDataFrame([(a, 7), (b, 2), (b, None)], "digest string, doc_id long"), buckets=2)
    assert rows_of(index) == {a: (7, 1), b: (2, 3)}


def test_groups_and_edges(docs):
    long = "word " * 50_000
    rows = [(4, "a  b"), (2, "a\tb"), (9, "a b "), (5, None), (6, ""), (7, " "), (8, "\n\n"), (1, long), (3, long), (None, "a b"), (2, "a\tb"), (None, "z"), (10, "a\u00a0b")]
    got = sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["kept"]) for r in ed.exact_dedup(docs(*rows)).collect()), key=str)
    want = [
        (4, 2, 4, False), (2, 2, 4, True), (2, 2, 4, True), (None, 2, 4, False), (9, 9, 1, True), (5, 5, 2, True), (6, 5, 2, False),
        (7, 7, 2, True), (8, 7, 2, False), (1, 1, 2, True), (3, 1, 2, False), (None, None, 1, True), (10, 10, 1, True),
    ]
    assert got == sorted(want, key=str)
    sha = ed.exact_dedup(docs((1, "é \n x"))).first()["text_sha256"]
    assert sha == hashlib.sha256("é x".encode()).hexdigest()
    assert ed.exact_dedup(docs()).count() == 0


def test_drop_exact_copies(docs):
    frame = docs((3, "a b"), (1, "a  b"), (2, "c"), (None, "c"), (None, "d"))
    left = ed.drop_exact_copies(frame)
    assert left.columns == frame.columns
    assert sorted(str((r["doc_id"], r["text"])) for r in left.collect()) == ["(1, 'a  b')", "(2, 'c')", "(None, 'd')"]


def test_drop_exact_copies_keeps_one_row_a_text(docs):
    """Repeated rows and copies without an id leave one row each; equal ids of other texts stay."""
    frame = docs(*[(1, "a b")] * 5, (1, "a  b"), (2, "a b"), *[(None, "d")] * 4, (None, "e"), (7, "e"), (7, "e"), (7, "f"), (8, None), (8, ""), (None, None))
    left = [(r["doc_id"], " ".join((r["text"] or "").split())) for r in ed.drop_exact_copies(frame).collect()]
    assert sorted(map(str, left)) == sorted(map(str, [(1, "a b"), (None, "d"), (7, "e"), (7, "f"), (8, "")]))
    assert ed.drop_exact_copies(docs()).count() == 0
