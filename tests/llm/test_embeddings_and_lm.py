from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pytest

from clickloom.llm import embedding_dedup as em
from clickloom.llm import ngram_lm

SCHEMA = "vec_id long, embedding array<float>, label int, node long, vector string, component string"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 1, "v", "c") for i, v in rows], SCHEMA)


def brute(rows, least=0.9):
    good = [(i, np.array(v, float)) for i, v in rows if v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    links, up = Counter(), {i: i for i, _ in rows}

    def top(i):
        while up[i] != i:
            i = up[i]
        return i

    for k, (i, x) in enumerate(good):
        for j, y in good[k + 1 :]:
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= least:
                links[i] += 1
                links[j] += 1
                a, b = top(i), top(j)
                up[max(a, b)] = min(a, b)
    return {i: (links[i], top(i)) for i, _ in rows}


@pytest.mark.parametrize("block", [4096, 7])
def test_links_are_those_of_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(em, "BLOCK", block)
    monkeypatch.setattr(em, "TILE", 5)
    draw = np.random.default_rng(2)
    centres = draw.normal(size=(6, 20))
    rows = [(k, [float(np.float32(x)) for x in centres[k % 6] * draw.uniform(0.1, 9) + draw.normal(size=20) * (k % 4) * 0.15]) for k in range(60)]
    rows += [(100 + k, rows[k][1]) for k in range(5)]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in em.near_vectors(frame(spark, rows)).collect()}
    assert got == brute(rows)


def brute_rows(rows, least=0.9):
    """Of each row its links, the smallest id that links reach, and whether it stays; every row is a vector."""
    units = [np.array(v, float) / np.linalg.norm(v) for _, v in rows]
    near = [[j for j in range(len(rows)) if j != i and units[i] @ units[j] >= least] for i in range(len(rows))]
    out = []
    for i, (id, _) in enumerate(rows):
        reached, open_ = {i}, [i]
        while open_:
            for j in near[open_.pop()]:
                if j not in reached:
                    reached.add(j)
                    open_.append(j)
        first = min((rows[j][0] for j in reached if rows[j][0] is not None), default=None)
        out.append((id, len(near[i]), first if id is not None else None, id is None or id == first))
    return sorted(out, key=str)


def test_null_and_repeated_ids_near_others(spark):
    given = [(None, [1, 0.05]), (5, [1, 0.0]), (7, [1, 0.1])]
    others = [(1, [1, 0.0]), (1, [1, 0.1]), (2, [1, 0.2])]
    apart = [(3, [0, 1.0]), (3, [1.0, 0]), (None, [-1, 0.0]), (None, [-1, 0.1]), (9, [0.2, 1.0]), (4, [0, -1.0])]
    draw = np.random.default_rng(5)
    many = [(None if k % 4 == 0 else k % 9, list(draw.normal(size=3))) for k in range(60)]
    for rows in (given, others, apart, many):
        rows = [(i, [float(np.float32(x)) for x in v]) for i, v in rows]
        got = [(r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in em.near_vectors(frame(spark, rows)).collect()]
        assert sorted(got, key=str) == brute_rows(rows)


def test_vector_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, nan]), (5, [inf, 1.0]), (6, [1.0, None]), (7, [1.0, 0.0]), (8, [2.0, 0.0]), (9, [1.0, 0.0, 0.0]), (10, [1e-30, 0.0]), (11, [-1.0, 0.0])]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in em.near_vectors(frame(spark, rows)).collect()}
    want = {i: (0, i, True) for i in range(1, 12)} | {7: (2, 7, True), 8: (2, 7, False), 10: (2, 7, False)}
    assert got == want
    repeated = em.near_vectors(frame(spark, [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (None, [1.0, 0.0]), (None, None)])).collect()
    assert sorted((r["vec_id"] or 0, r["n_links"], r["component_id"], r["kept"]) for r in repeated if r["vec_id"]) == [(1, 2, 1, True)] * 2
    assert sorted((r["n_links"], r["component_id"], r["kept"]) for r in repeated if r["vec_id"] is None) == [(0, None, True), (2, None, True)]
    assert em.near_vectors(frame(spark, [])).count() == 0


def scores(rows, alpha=0.4, order=2):
    """Stupid backoff over all other documents, word by word."""
    found = [(i, ngram_lm.WORD.findall((t or "").translate(ngram_lm.LOWER))) for i, t in rows]
    grams = lambda w, n: Counter(tuple(w[k : k + n]) for k in range(len(w) - n + 1))
    total = {n: sum((grams(w, n) for _, w in found), Counter()) for n in range(1, order + 1)}
    corpus = sum(len(w) for _, w in found)
    out = []
    for i, w in found:
        own = {n: grams(w, n) for n in total}
        c = lambda g: total[len(g)][g] - own[len(g)][g]  # noqa: B023, E731

        def s(g):
            if len(g) == 1:
                return (c(g) or 0.5) / max(1, corpus - len(w))  # noqa: B023
            return c(g) / c(g[:-1]) if c(g) else alpha * s(g[1:])

        logs = sum(math.log(s(tuple(w[max(0, k - order + 1) : k + 1]))) for k in range(len(w)))
        out.append((i, len(w), round(logs, 6), round(logs / len(w), 6) if w else None))
    return sorted(out, key=str)


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_scores_against_word_by_word(docs, documents, order, monkeypatch):
    monkeypatch.setattr(ngram_lm, "BUCKET", 5_000)
    rows = [(r["doc_id"], r["text"]) for r in documents.limit(60).collect()]
    rows += [(1, None), (2, ""), (3, " \n"), (4, "lone"), (None, "The the THE"), (5, "w " * 20_000), rows[0]]
    got = sorted(((r[0], r[1], round(r[2], 6), None if r[3] is None else round(r[3], 6)) for r in ngram_lm.lm_scores(docs(*rows), order).collect()), key=str)
    assert len(got) == len(rows)
    for a, b in zip(got, scores(rows, order=order), strict=True):
        assert a[:2] == b[:2] and a[2] == pytest.approx(b[2], abs=1e-4)
    assert ngram_lm.lm_scores(docs()).count() == 0


def test_chunks_wait_for_their_totals_in_place(spark, docs):
    """Only n-grams and totals are shuffled; the chunks' words are read where they were written."""
    plan = ngram_lm.lm_scores(docs((1, "one two two"), (2, "two one"), (3, None)))._jdf.queryExecution().executedPlan().toString()
    moved = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert len([line for line in moved if "hashpartitioning(chunk" in line]) == 1
    assert len([line for line in moved if "hashpartitioning(bucket" in line]) == 1
    assert len(moved) == 2


def test_numbers_in_planes_of_bytes():
    for kind in (np.uint32, np.uint64):
        numbers = np.array([0, 1, 255, 256, 65_536, np.iinfo(kind).max], kind)
        assert (ngram_lm._unplanes(ngram_lm._planes(numbers), numbers.dtype.itemsize) == numbers).all()
    assert len(ngram_lm._unplanes(b"")) == 0
