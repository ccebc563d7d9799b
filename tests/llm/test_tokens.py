"""BPE round trip and packing, against the public library."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from clickloom.llm import bpe_trie, packing

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
ODD = [
    "", " ", "a  b   c\n\n d", "²½ Ⅷ x１２", "it's we'll I'D 'S", "<|endoftext|>x<|endoftext|> y  <|endoftext|>", "\u3000 \u00a0x\x1c\x1d\x85y  z",
    "日本語テキスト😀👍🏽 é नमस्ते", "_foo__bar 12ab_", "\t\t tabs \r\n end   ", "a" * 40 + " " + "0" * 30 + " --------========", "<|endoftext", "x" * 5000,
]


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(JSON)


def texts(count=400):
    draw = random.Random(3)
    return ODD + ["".join(draw.choice("ab cd'\n\t .,é日1²_ s😀etaoinshr") for _ in range(draw.randrange(80))) for _ in range(count)]


def test_encoder_equals_the_library(library):
    some = texts()
    for text, (n, ids, decoded) in zip(some, bpe_trie.encoder(JSON).encode(some), strict=True):
        want = library.encode(text, add_special_tokens=False).ids
        assert (n, ids, decoded) == (len(want), ",".join(map(str, want)), library.decode(want, skip_special_tokens=False)), text


def test_each_token_encodes_to_itself(library):
    vocabulary = bpe_trie.encoder(JSON).vocabulary
    found = bpe_trie.encode_words(vocabulary, vocabulary.id_of)
    assert all(found[token] == [i] for token, i in vocabulary.id_of.items())


def test_memory_of_words_is_bounded(monkeypatch, library):
    monkeypatch.setattr(bpe_trie, "MEMO", 20)
    encoder = bpe_trie.Encoder(JSON)
    for _ in range(3):
        for text in texts(60):
            (n, _, _), = encoder.encode([text])
            assert n == len(library.encode(text, add_special_tokens=False).ids)


def test_digests_of_a_table(docs, library):
    rows = [(k, t) for k, t in enumerate(ODD)] + [(None, "x"), (90, None), (3, "again")]
    got = sorted(map(tuple, bpe_trie.encode_digests(docs(*rows), JSON).collect()), key=str)
    want = []
    for i, t in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        digest = [hashlib.sha256(x.encode()).hexdigest() for x in (",".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))]
        want.append((i, len(ids), *digest))
    assert got == sorted(want, key=str)
    assert bpe_trie.encode_texts(docs(*rows), JSON).where("doc_id = 90").first()["decoded"] == ""
    assert bpe_trie.encode_digests(docs(), JSON).count() == 0


def check_packing(pieces, rows, library, window):
    by_sequence, by_doc = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_sequence[p["sequence_id"]].append(p)
        by_doc[p["doc_id"]].append(p)
    for number, own in by_sequence.items():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at and p["length"] > 0
            at += p["length"]
        assert at == window or at < window and number == max(by_sequence)
    assert set(by_sequence) == set(range(len(by_sequence)))
    for i, text in rows:
        ids, at = [*library.encode(text or "", add_special_tokens=False).ids, 1], 0
        for p in sorted(by_doc[i], key=lambda p: p["start"]):
            part = np.array(ids[at : at + p["length"]], "<u4")
            assert (p["start"], p["doc_tokens"], p["ids_crc32"]) == (at, len(ids), zlib.crc32(part.tobytes()))
            assert np.frombuffer(p["ids"], "<u2").tolist() == part.tolist()
            at += p["length"]
        assert at == len(ids)
    return by_sequence


@pytest.mark.parametrize("quantum", [1, 32, 256])
def test_every_window_has_the_proportions_of_the_table(documents, library, quantum):
    rows = [(r["doc_id"], r["text"]) for r in documents.collect()]
    pieces = packing.pack(documents, RANKS, 1, window=256, quantum=quantum).collect()
    by_sequence = check_packing(pieces, rows, library, 256)
    total = defaultdict(int)
    for p in pieces:
        total[p["source"]] += p["length"]
    everything = sum(total.values())
    dealt = defaultdict(int)
    for number in sorted(by_sequence)[:-1]:
        for p in by_sequence[number]:
            dealt[p["source"]] += p["length"]
        for source, n in total.items():
            assert abs(dealt[source] - n / everything * 256 * (number + 1)) <= quantum * (len(total) / 2 + 1)


def test_targets_and_edges(docs, library):
    draw = random.Random(1)
    words = lambda n: " ".join(draw.choice("red green blue".split()) for _ in range(n))
    rows = [(k, words(draw.randrange(1, 90)), None, draw.choice(["a", "b", None])) for k in range(60)] + [(60, None, None, "a"), (61, "", None, "a"), (62, words(3000), None, "b")]
    pieces = packing.pack(docs(*rows), RANKS, 1, window=64, targets={"a": 1, "b": 2, None: 1}, quantum=1).collect()
    by_sequence = check_packing(pieces, [(r[0], r[1]) for r in rows], library, 64)
    first = defaultdict(int)
    for p in by_sequence[0]:
        first[p["source"]] += p["length"]
    assert abs(first["b"] - 32) <= 1 and abs(first["a"] - 16) <= 1 and abs(first[None] - 16) <= 1
    assert packing.pack(docs(), RANKS, 1).count() == 0
    with pytest.raises(ValueError):
        packing.pack(docs(*rows), RANKS, 1, targets={"a": 1})


def test_repeated_and_null_ids_are_packed(docs):
    rows = [(1, "one two", None, "a"), (1, "one two", None, "a"), (None, "three", None, "a")]
    pieces = packing.pack(docs(*rows), RANKS, 1, window=4).collect()
    assert sum(p["length"] for p in pieces) == 8 and {p["doc_id"] for p in pieces} == {1, None}


@pytest.mark.parametrize("quantum", [1, 3, 8])
def test_schedule_equals_dealing_one_by_one(quantum):
    """Against a loop that deals the quantum that falls due first, over shares with ties."""
    totals, shares = np.array([7, 1, 40, 12, 33]), np.array([3.0, 1.0, 0.01, 3.0, 1.5])
    mixture = packing.Mixture(totals, shares, quantum)
    every = [((c + 0.5) / mixture.shares[s], s, c) for s in range(5) for c in range(-(-totals[s] // quantum))]
    at = 0
    for _, s, c in sorted(every):
        assert mixture.before(s, np.array([c])).tolist() == [at]
        at += min(quantum, totals[s] - c * quantum)
    assert at == totals.sum()


def test_a_tiny_source_of_a_huge_corpus_is_packed_in_little_memory():
    """A million tokens among 10^12: the work is that of its own quanta, and pieces are no shreds."""
    import tracemalloc

    draw = np.random.default_rng(3)
    counts = draw.integers(200, 1800, 1000)
    mixture = packing.Mixture(np.array([10**12, int(counts.sum()), 3 * 10**11]), np.array([10**12, counts.sum(), 3 * 10**11], float), 256)
    tracemalloc.start()
    doc, start, length, sequence, offset = packing._pieces(mixture, 1, 0, counts, 2048)
    assert tracemalloc.get_traced_memory()[1] < 5_000_000
    tracemalloc.stop()
    assert np.bincount(doc, length, 1000).tolist() == counts.tolist()
    assert (offset + length <= 2048).all() and np.median(length) >= 128 and len(length) < counts.sum() / 256 * 2 + 1000
    assert sequence[0] < sequence[-1] <= mixture.totals.sum() // 2048 and (np.diff(sequence * 2048 + offset) > 0).all()
    # Whole quanta but for ends of documents and windows.
    whole = packing._pieces(mixture, 1, 0, np.array([counts.sum()]), 2048)[2]
    assert np.median(whole) == 256


def test_many_sources(docs):
    rows = [(k, "one two three", None, f"s{k}") for k in range(300)]
    pieces = packing.pack(docs(*rows), RANKS, 1, window=64).collect()
    assert sum(p["length"] for p in pieces) == 300 * 4
    assert sorted({p["sequence_id"] for p in pieces}) == list(range(-(-1200 // 64)))


def test_too_many_sources_or_too_large_a_quantum(docs, monkeypatch):
    rows = [(k, "one", None, f"s{k}") for k in range(5)]
    with pytest.raises(ValueError):
        packing.pack(docs(*rows), RANKS, 1, window=64, quantum=65)
    monkeypatch.setattr(packing, "SOURCES", 4)
    with pytest.raises(ValueError):
        packing.pack(docs(*rows), RANKS, 1)


def test_offsets_are_shuffled_beyond_the_bound(docs, monkeypatch):
    rows = [(k, "one two three four " * k, None, "ab"[k % 2]) for k in range(40)]
    picked = ["doc_id", "start", "length", "sequence_id", "offset"]
    sent = sorted(map(tuple, packing.pack(docs(*rows), RANKS, 1, window=64).select(picked).collect()))
    monkeypatch.setattr(packing, "SENT_ROWS", 0)
    shuffled = packing.pack(docs(*rows), RANKS, 1, window=64)
    assert "SortMergeJoin" in shuffled._jdf.queryExecution().toString()
    assert len(shuffled.collect()) >= 40 and sum(p["length"] for p in shuffled.collect()) == sum(x[2] for x in sent)
