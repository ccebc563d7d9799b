from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from clickloom.llm import minhash
from clickloom.llm.components import components


def shingles(text, words):
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(minhash.LOWER))
    n = min(words, len(found))
    return {tuple(found[k : k + n]) for k in range(len(found) - n + 1)} if found else set()


def brute(rows, words, percent=80):
    """Component of each id, by comparing all pairs of rows."""
    sets = [(i, shingles(t, words)) for i, t in rows]
    up = {i: i for i, _ in rows}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, x in sets:
        for b, y in sets:
            if x and y and a != b and 100 * len(x & y) >= percent * len(x | y):
                p, q = top(a), top(b)
                up[max(p, q)] = min(p, q)
    return {i: top(i) for i in up}


def variants(seed, groups=6, size=7, words=60):
    draw = random.Random(seed)
    rows, i = [], 0
    for _ in range(groups):
        base = [f"w{draw.randrange(500)}" for _ in range(words)]
        for _ in range(size):
            text = list(base)
            for _ in range(draw.randrange(9)):
                text[draw.randrange(words)] = f"x{draw.randrange(500)}"
            rows.append((i, " ".join(text)))
            i += 1
    draw.shuffle(rows)
    return rows


@pytest.mark.parametrize(("words", "seed"), [(2, 1), (5, 2)])
def test_components_are_those_of_all_pairs(docs, words, seed):
    rows = variants(seed)
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs(*rows), words=words).collect()}
    want = brute(rows, words)
    assert {i: r["component_id"] for i, r in got.items()} == want
    assert all(r["kept"] == (i == want[i]) and r["n_shingles"] == len(shingles(dict(rows)[i], words)) for i, r in got.items())


def test_documents_table(documents):
    rows = [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]
    got = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(documents, words=2).collect()}
    assert got == brute(rows, 2)


def test_edges(docs):
    long = "a b c d e f g h i j " * 3000
    rows = [(1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "ONE"), (6, "one two"), (7, long), (8, long + "zz"), (None, "one"), (9, "Émile"), (10, "émile")]
    got = {r["doc_id"]: r for r in minhash.near_duplicates(docs(*rows, rows[3]), words=2).collect()}
    assert {i: r["component_id"] for i, r in got.items()} == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6, 7: 7, 8: 7, None: None, 9: 9, 10: 10}
    assert got[1]["n_shingles"] == got[3]["n_shingles"] == 0 and got[4]["n_shingles"] == got[6]["n_shingles"] == 1
    assert got[None]["kept"] and not got[5]["kept"]
    assert minhash.near_duplicates(docs(*rows, rows[3]), words=2).count() == 12
    assert minhash.near_duplicates(docs()).count() == 0


def reached(ties, start=()):
    """Groups that pairs connect, as sorted tuples."""
    groups = [{a, b} for a, b in [*ties, *start]]
    done = []
    while groups:
        g = groups.pop()
        for other in [o for o in groups if o & g]:
            g |= other
            groups.remove(other)
            groups.append(g)
            g = None
            break
        if g:
            done.append(tuple(sorted(g)))
    return sorted(done)


def test_ties_beside_the_hub(spark):
    """Two members unlike their hub but like each other are still tied."""
    members = spark.createDataFrame([(7, 1, 1), (7, 2, 1), (7, 8, 8), (7, 9, 9)], "key long, node long, component long")
    signature = {1: b"a" * 20, 2: b"a" * 20, 8: b"b" * 20, 9: b"b" * 19 + b"c"}
    signatures = spark.createDataFrame([(n, bytearray(s)) for n, s in signature.items()], "node long, signature binary")
    got = minhash.tied_components(members, signatures, 15).collect()
    assert [(r["a"], r["b"]) for r in got] == [(9, 8)]


@pytest.mark.parametrize("block", [3, 1024])
def test_blocks_lose_no_link(spark, monkeypatch, block):
    monkeypatch.setattr(minhash, "BLOCK", block)
    draw = random.Random(8)
    base = list(range(40))
    sets = {n: sorted({x if draw.random() > 0.12 else 1000 + draw.randrange(99) for x in base}) for n in range(30)}
    # Some are joined already; all the other links between components must be found, or follow from those found.
    component = {n: 0 if n < 12 else n for n in sets}
    members = spark.createDataFrame([(7, n, c) for n, c in component.items()], "cluster long, node long, component long")
    frame = spark.createDataFrame([(n, s) for n, s in sets.items()], "node long, shingles array<long>")
    got = [(r["a"], r["b"]) for r in minhash.linked_across(members, frame, 80).collect()]
    want = [(a, b) for a in sets for b in sets if a > b and component[a] != component[b] and 100 * len({*sets[a]} & {*sets[b]}) >= 80 * len({*sets[a]} | {*sets[b]})]
    joined = [(0, n) for n in range(1, 12)]
    assert want and reached(got, joined) == reached(want, joined)
    assert len(got) <= 30 * 30


def test_drop_near_copies_keeps_columns_and_one_of_each_group(docs):
    rows = variants(5, groups=3)
    frame = docs(*rows)
    left = minhash.drop_near_copies(frame)
    assert left.columns == frame.columns
    assert {r["doc_id"] for r in left.collect()} == set(brute(rows, 5).values())


@pytest.mark.parametrize("length", [1, 2, 300])
def test_components_of_chains(spark, length):
    edges = spark.range(length).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = components(edges.union(edges)).collect()
    assert len(got) == length + 1 and {r["component"] for r in got} == {0}


def test_components_without_edges(spark):
    edges = spark.createDataFrame([(1, 1), (None, 2)], "a long, b long")
    assert components(edges).count() == 0


def test_a_column_of_any_name_passes_the_stage(spark):
    text = "one two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(1, text, "x"), (2, text, "y"), (3, "another text", "z")], "doc_id long, text string, _dropped string")
    assert sorted(tuple(r) for r in minhash.drop_near_copies(docs).collect()) == [(1, text, "x"), (3, "another text", "z")]
