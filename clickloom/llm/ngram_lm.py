"""Stupid-backoff scores of documents by a language model of the whole corpus without themselves.

``S(w | h) = c(h w) / c(h)`` where ``h w`` occurs outside the document, else ``alpha * S(w | h')`` with a
word less of history; counts are those of all other documents. The n-grams of the corpus are too many to
send a row each, so they travel packed: a chunk of documents sends each hash bucket its distinct n-grams
with their counts, the bucket sums them over the chunks, and each chunk gets its n-grams' totals back, is
joined to its words, and sums per document. The words are written once, as a bucketed table of chunks, and
wait there for the totals; only n-grams and totals are shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import re
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.session import scratch_path
from clickloom.sources.bucketed import write_bucketed_in_place

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
#: Characters of a chunk, unless one document alone has more; n-grams of a bucket, about.
CHUNK, BUCKET = 8_000_000, 4_000_000
CHUNKS = "chunk string, doc_ids array<long>, sizes array<int>, words binary, ids binary, grams long"
MEMO = 500_000


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers byte by byte, all the high ones first: those hardly change, if sorted or small, and compress."""
    size = numbers.dtype.itemsize
    return numbers.astype(f">u{size}").view(np.uint8).reshape(-1, size).T.tobytes()


def _unplanes(raw: bytes, size: int = 8) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, -1).T).view(f">u{size}").ravel().astype(f"<u{size}")


def _chunks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Documents as places in a chunk's own sorted word list; words as hashes, both in planes of bytes."""
    from pyspark import TaskContext

    part, number, known = TaskContext.get().partitionId(), 0, {}
    for frame in frames:
        bound = (frame["text"].str.len().cumsum() // CHUNK).to_numpy()
        for _, rows in frame.groupby(bound, sort=True):
            found = [WORD.findall(t.translate(LOWER)) for t in rows["text"]]
            if len(known) > MEMO:
                known.clear()
            for words in found:
                for word in words:
                    if word not in known:
                        known[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
            hashes = np.concatenate([np.zeros(0, np.uint64), *(np.fromiter(map(known.__getitem__, w), np.uint64, len(w)) for w in found)])
            words, ids = np.unique(hashes, return_inverse=True)
            yield pd.DataFrame(
                {
                    "chunk": [f"{part}-{number}"], "doc_ids": [[None if pd.isna(x) else int(x) for x in rows["doc_id"]]],
                    "sizes": [[len(w) for w in found]], "words": [_planes(words)], "ids": [_planes(ids.astype(np.uint32))],
                    "grams": [len(hashes)],
                }
            )
            number += 1


def _grams(row, order: int) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """A chunk's document number of each word, word's place in its document, and for each length the
    hashes of the n-grams that end at each word; 0 where the document has no such n-gram."""
    sizes = np.array(row.sizes, np.int64)
    doc = np.repeat(np.arange(len(sizes)), sizes)
    place = np.arange(len(doc)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    words = _unplanes(row.words)[_unplanes(row.ids, 4)]
    out = []
    for n in range(1, order + 1):
        h = np.full(len(words), n, np.uint64)
        for back in range(n - 1, -1, -1):
            h = (h ^ np.concatenate([np.zeros(min(back, len(words)), np.uint64), words[: max(0, len(words) - back)]])) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(32)
        h[h == 0] = 1
        out.append(np.where(place >= n - 1, h, np.uint64(0)))
    return doc, place, out


def _send(order: int, buckets: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for row in frame.itertuples(index=False):
                h, c = np.unique(np.concatenate(_grams(row, order)[2]), return_counts=True)
                h, c = (h[1:], c[1:]) if len(h) and h[0] == 0 else (h, c)
                # Buckets are ranges of hashes, so that the parts of a chunk follow each other in order.
                cut = np.searchsorted(h, _edges(buckets))
                some = [k for k in range(buckets) if cut[k] < cut[k + 1]]
                yield pd.DataFrame(
                    {
                        "bucket": some, "chunk": row.chunk,
                        "hashes": [_planes(h[cut[k] : cut[k + 1]]) for k in some],
                        "counts": [_planes(c[cut[k] : cut[k + 1]].astype(np.uint32)) for k in some],
                    }
                )

    return run


def _edges(buckets: int) -> np.ndarray:
    return np.array([(k << 64) // buckets for k in range(buckets)] + [(1 << 64) - 1], np.uint64)


def _total(frame: pd.DataFrame) -> pd.DataFrame:
    """The bucket's count table, and from it each chunk's n-grams' totals."""
    parts = [_unplanes(x) for x in frame["hashes"]]
    _, at = np.unique(np.concatenate(parts), return_inverse=True)
    totals = np.bincount(at, weights=np.concatenate([_unplanes(x, 4) for x in frame["counts"]]))[at].astype(np.uint64)
    ends = np.cumsum([len(p) for p in parts])
    sent = [_planes(t) for t in np.split(totals, ends[:-1])]
    return pd.DataFrame({"chunk": frame["chunk"], "bucket": frame["bucket"], "totals": sent})


def _score(order: int, alpha: float, corpus: int):
    def run(chunks: pd.DataFrame, totals: pd.DataFrame) -> pd.DataFrame:
        row = next(chunks.itertuples(index=False))
        doc, place, grams = _grams(row, order)
        n_docs, sizes = len(row.sizes), np.array(row.sizes, np.int64)
        total = np.zeros(len(doc))
        if len(doc):
            keys = np.unique(np.concatenate(grams))
            keys = keys[keys != 0]
            sums = np.concatenate([_unplanes(x) for x in totals.sort_values("bucket")["totals"]]).astype(np.int64)
            others = corpus - sizes[doc]
            counts = []  # of the n-gram that ends at each word, in other documents
            for g in grams:
                at = np.where(g != 0, np.searchsorted(keys, g), len(keys))
                pair, own = np.unique(doc * np.int64(len(keys) + 1) + at, return_inverse=True)
                counts.append(np.where(g != 0, sums[np.minimum(at, len(keys) - 1)] - np.bincount(own, minlength=len(pair))[own], 0))
            s = np.where(counts[0] > 0, counts[0], 0.5) / np.maximum(others, 1)
            for n in range(2, order + 1):
                history = np.concatenate([[1], counts[n - 2][:-1]])
                seen = counts[n - 1] > 0
                s = np.where(seen, counts[n - 1] / np.where(seen, history, 1), np.where(place >= n - 1, alpha * s, s))
            total = np.log(s)
        logs = np.bincount(doc, weights=total, minlength=n_docs) if n_docs else np.zeros(0)
        return pd.DataFrame(
            {
                "doc_id": pd.array([None if pd.isna(x) else int(x) for x in row.doc_ids], "Int64"), "n_tokens": sizes,
                "log_score": logs, "score": np.where(sizes > 0, logs / np.maximum(sizes, 1), np.nan),
            }
        )

    return run


def lm_scores(docs: DataFrame, order: int = 2, alpha: float = 0.4, id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_tokens, log_score, score`` (natural log, sum and mean).

    Words are what lies between blanks, tabs and line ends, with A-Z in lower case. Every document is
    counted and every one is scored, each against all others; a copy elsewhere makes a text likely. A word
    that occurs nowhere else counts as half an occurrence. Null text, and text without a word, has no
    tokens, log score 0 and a null score. Null and repeated ids stay as they are, as documents of their
    own; other columns are not read; an empty table gives no rows.
    """
    if order < 1 or not 0 < alpha <= 1:
        raise ValueError("The order must be 1 or more, alpha above 0 and at most 1")
    rows = docs.select(docs[id].cast("long").alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    chunks = write_bucketed_in_place(rows.mapInPandas(_chunks, CHUNKS), "chunk", "chunks", scratch_path(spark, "chunks"), parts)
    corpus = chunks.agg(F.coalesce(F.sum("grams"), F.lit(0))).first()[0]
    buckets = corpus * order // BUCKET + 1
    sent = chunks.mapInPandas(_send(order, buckets), "bucket int, chunk string, hashes binary, counts binary")
    totals = sent.groupBy("bucket").applyInPandas(_total, "chunk string, bucket int, totals binary")
    scored = chunks.groupBy("chunk").cogroup(totals.groupBy("chunk")).applyInPandas(
        _score(order, alpha, corpus), "doc_id long, n_tokens long, log_score double, score double"
    )
    return scored.withColumn("score", F.when(~F.isnan("score"), F.col("score")))
