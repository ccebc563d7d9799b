from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clickloom.llm import langid


@pytest.fixture(scope="module")
def trained(spark):
    from ..conftest import SF

    documents = spark.read.parquet(f"{SF.replace('0.001', '0.01')}/documents.parquet")
    return documents, langid.train(documents.where(~langid.held_out(F.col("doc_id"))))


def test_held_out_accuracy(trained):
    documents, models = trained
    found = langid.identify(documents, models).join(documents.select("doc_id", "lang"), "doc_id")
    row = found.where(langid.held_out(F.col("doc_id"))).agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.min("score"), F.max("score")).first()
    assert row[0] >= 0.98 and 0 <= row[1] <= row[2] <= 1


def test_models_are_distributions(trained):
    """The probabilities of all symbols after any context add up to one, but for what the floor lends to
    unseen symbols."""
    _, models = trained
    model = models["en"]
    letters = np.array(sorted({ord(c) for c in " abcdefghijklmnopqrstuvwxyz"}), np.uint32)
    for context in ("the", "zzz", " an"):
        codes = [np.full(len(letters), ord(c), np.uint32) for c in context] + [letters]
        by_length = [langid.hash_of(codes[-1:])]
        for n in range(2, 5):
            by_length.append((langid.hash_of(codes[-n:]), langid.hash_of(codes[-n:-1])))
        total = np.exp2(model.log2(by_length)).sum()
        assert 0.8 < total < 1 + 1e-9


def test_kneser_ney_by_hand():
    """Bigrams aa, ab, ab, ba: continuation counts for the unigrams, discounts from counts of counts."""
    a, b = ord("a"), ord("b")
    model = langid._fit([{(a,): 3, (b,): 2}, {(a, a): 1, (a, b): 2, (b, a): 1}], 4)
    # Two of the bigrams occur once and one twice: D = 2 / (2 + 2 * 1). No letter follows just one other: D = 1/2.
    d2, d1 = 2 / 4, 1 / (1 + 2 * 1)
    one = (2 - d1) / 3 + d1 * 2 / 3 / 4  # "a" follows two symbols, "b" one
    want = (1 - d2) / 3 + d2 * 2 / 3 * one
    columns = [np.array([a], np.uint32), np.array([a], np.uint32)]
    got = model.log2([langid.hash_of(columns[1:]), (langid.hash_of(columns), langid.hash_of(columns[:1]))])
    assert math.isclose(2 ** got[0], want, rel_tol=1e-12)


def test_rejection_and_edges(trained, docs):
    _, models = trained
    long = "the and of to in that with from this they " * 5000
    rows = [(1, None), (2, ""), (3, "12 ... 34"), (4, "the and of that with from this"), (5, long), (6, "жщчюя ыъэ йцукен фыва олдж"), (None, "the"), (4, "the and of that with from this")]
    got = {r["doc_id"]: r for r in langid.identify(docs(*rows), models).collect()}
    for i in (1, 2, 3):
        assert (got[i]["lang_pred"], got[i]["score"], got[i]["accepted"]) == ("und", 0.0, False)
    assert got[4]["lang_pred"] == got[5]["lang_pred"] == "en" and got[4]["accepted"] and got[5]["accepted"]
    assert not got[6]["accepted"] and got[6]["lang_pred"] in models
    kept = langid.keep_identified(docs(*rows), models)
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 4, 4, 5] and kept.columns == docs().columns
    assert langid.identify(docs(), models).count() == 0


def test_without_labels(docs):
    models = langid.train(docs((1, "text", None)))
    assert models == {}
    assert langid.identify(docs((1, "text", None)), models).first()["lang_pred"] == "und"
    assert langid.keep_identified(docs((1, "text", None), (2, None, None)), models).count() == 2


def test_clean_documents_are_kept(trained):
    documents, models = trained
    assert langid.keep_identified(documents, models).count() >= 0.995 * documents.count()


#: Pronounceable words of a made-up language; its texts are draws from them.
WORDS = [a + b + c for a in ("ka", "lo", "mi", "ru", "te") for b in ("na", "so", "vi", "pel") for c in ("", "r", "tan", "lis")]


def drawn(seed, n=150):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


@pytest.mark.parametrize("k", [1, 2, 3, 5, 9])
def test_few_labelled_texts_are_calibrated(docs, k):
    """However the texts hash, a language of few distinct ones, or of copies of one, keeps its documents."""
    for start in range(0, 60, 20):
        texts = [drawn(start + i) for i in range(k)]
        models = langid.train(docs(*((i, t, "xx") for i, t in enumerate(texts)), (90, texts[0], "xx"), (91, texts[0], "xx")))
        assert set(models) == {"xx"} and models["xx"].mean > 0
        new = docs(*((i, drawn(1000 + start + i)) for i in range(5)), *((9, t) for t in texts))
        assert langid.keep_identified(new, models).count() == 5 + k


def test_without_calibration_text_means_are_pooled(docs):
    """A language whose every fifth text has no letter takes the mean of the others, never 0."""
    plain = [(i, drawn(i), "xx") for i in range(40)]
    chosen = [(r["doc_id"], r["_n"]) for r in langid.sample(docs(*((i, str(i), "yy") for i in range(40))), 400, 20_000, "doc_id", "text", "lang").selectExpr("int(_text) AS doc_id", "_n").collect()]
    gaps = [(i, str(i) if n % 5 == 0 else drawn(200 + i), "yy") for i, n in chosen]
    models = langid.train(docs(*plain, *gaps))
    assert models["yy"].mean == models["xx"].mean > 0


def test_long_texts_are_learned_from(docs):
    """Texts above the bound count in the sample, by their first characters, beside and without short ones."""
    long = [(i, drawn(i, 300), "xx") for i in range(8)]
    short = [(i, drawn(i, 20), "yy") for i in range(10, 14)] + [(i, drawn(i, 300), "yy") for i in range(14, 20)]
    got = langid.sample(docs(*long, *short), 9, 500, "doc_id", "text", "lang").collect()
    assert sorted((r["_lang"], r["_n"], r["_k"]) for r in got) == [("xx", n, 8) for n in range(1, 9)] + [("yy", n, 9) for n in range(1, 10)]
    whole = {t for _, t, _ in long + short}
    assert all(len(r["_text"]) <= 500 and any(t[:500] == r["_text"] for t in whole) for r in got)
    models = langid.train(docs(*long), chars=500)
    assert langid.identify(docs((1, drawn(99))), models).first()["lang_pred"] == "xx"


def test_sample_bound_is_strict(docs):
    """Null and repeated ids tie; their texts are still no more than the bound."""
    rows = [*((None, drawn(i), "xx") for i in range(30)), *((5, drawn(100 + i), "yy") for i in range(30))]
    got = langid.sample(docs(*rows, *rows[:9]), 6, 20_000, "doc_id", "text", "lang").collect()
    assert sorted((r["_lang"], r["_n"], r["_k"]) for r in got) == [(lang, n, 6) for lang in ("xx", "yy") for n in range(1, 7)]
    assert len({r["_text"] for r in got}) == 12


@pytest.mark.parametrize("groups", [1, 3, 64])
def test_sample_is_that_of_one_ranking(docs, monkeypatch, groups):
    """However tasks are grouped: the texts of the smallest hashes, over more partitions than groups."""
    rows = [(i, f"text {i % 150}", "xx" if i % 3 else "yy") for i in range(400)]
    monkeypatch.setattr(langid, "GROUPS", groups)
    frame = docs(*rows).repartition(9)
    got = langid.sample(frame, 20, 100, "doc_id", "text", "lang").collect()
    ranked = frame.selectExpr("lang", "text", "xxhash64(string(doc_id), 17) AS at", "xxhash64(text) AS d").collect()
    for lang in ("xx", "yy"):
        best = {}
        for r in ranked:
            if r["lang"] == lang:
                best[r["text"]] = min(best.get(r["text"], (r["at"], r["d"])), (r["at"], r["d"]))
        assert [r["_text"] for r in sorted((g for g in got if g["_lang"] == lang), key=lambda g: g["_n"])] == sorted(best, key=best.get)[:20]
