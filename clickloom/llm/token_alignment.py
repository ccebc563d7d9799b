"""Alignment of two tokenizers' tokens by coalescing their byte intervals, and how often token pairs meet.

All tokens of both sides of a batch of texts are lexsorted by start; the running maximum of their ends is
accumulated, and a group ends where the next start has reached that maximum. Tokens of a group overlap or are
chained by overlaps; each token of side A is linked to each of side B in its group. The distinct id pairs of
each document are written once. Counts of documents by id pair come from that table; the most frequent
pairs, up to a fixed number, are sent to all tasks, all other pairs are joined by a shuffle.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import public_tokenizers
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import discard, keep

#: An id pair is one number: id of A times this, plus id of B. Vocabularies of B are smaller.
WIDTH = 32_768
#: Code points of a batch of texts, and id pairs of one written row: bounds of a task's memory.
BATCH_CHARS, ROW_PAIRS = 1_000_000, 200_000
#: Id pairs whose counts are sent to all tasks; the others are joined by a shuffle, with the same result.
SENT_PAIRS = 1 << 18


class Sides:
    """Both vocabularies: encoders, and of each id its bytes, their number, and its decimal with a mark behind it."""

    def __init__(self, ranks_path: str, pieces_path: str) -> None:
        with open(ranks_path, "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        self.a = tiktoken.Encoding("a", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = sentencepiece.SentencePieceProcessor(model_file=pieces_path)
        of_a = {rank: token for token, rank in ranks.items()}
        self.bytes_a = [of_a.get(i, b"") for i in range(max(of_a) + 1)]
        self.bytes_b = [piece_bytes(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        assert len(self.bytes_b) <= WIDTH
        self.size_a, self.size_b = (np.array([len(x) for x in side], np.int64) for side in (self.bytes_a, self.bytes_b))
        self.said_a, self.said_b = ({end: np.array([f"{i}{end}" for i in range(len(side))], object) for end in ends} for side, ends in ((self.bytes_a, ",|"), (self.bytes_b, ",;")))

    def encode(self, texts: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides; none on either side where the joined bytes of one are not a blank and the text."""
        ids_a = [self.a.encode_ordinary(" " + t) if t else [] for t in texts]
        ids_b = self.b.encode(texts, num_threads=1)
        for k, text in enumerate(texts):
            raw = (" " + text).encode("utf-8", "surrogatepass") if text else b""
            if b"".join(map(self.bytes_a.__getitem__, ids_a[k])) != raw or b"".join(map(self.bytes_b.__getitem__, ids_b[k])) != raw:
                ids_a[k], ids_b[k] = [], []
        return ids_a, ids_b


def piece_bytes(piece: str) -> bytes:
    """The bytes a piece stands for: U+2581 is a blank, ``<0xHH>`` one byte."""
    byte = re.fullmatch("<0x([0-9A-F]{2})>", piece)
    return bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()


@lru_cache(maxsize=2)
def sides(ranks_path: str, pieces_path: str) -> Sides:
    return Sides(ranks_path, pieces_path)


def coalesce(size_a: np.ndarray, size_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The group of each token of A and of B, from 0; sizes in bytes, none of them 0.

    Both sides cover the same bytes, so texts behind one another never share a group.
    """
    end_a, end_b = np.cumsum(size_a), np.cumsum(size_b)
    start, end = np.concatenate([end_a - size_a, end_b - size_b]), np.concatenate([end_a, end_b])
    side = np.repeat(np.arange(2), [len(size_a), len(size_b)])
    order = np.lexsort((side, start))
    reach = np.maximum.accumulate(end[order])
    group = np.empty(len(order), np.int64)
    group[order] = np.concatenate([[0], np.cumsum(start[order][1:] >= reach[:-1])]) if len(order) else 0
    return group[: len(size_a)], group[len(size_a) :]


def _lasts(group: np.ndarray) -> np.ndarray:
    """Whether a token is its side's last one in its group."""
    return np.append(group[1:] != group[:-1], np.ones(min(1, len(group)), bool))


def linked(ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, most: int = 1 << 21) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index of A's token and id of B's token of each link, at most about ``most`` links at once."""
    first = np.searchsorted(group_b, group_a)
    many = np.searchsorted(group_b, group_a, side="right") - first
    total = np.cumsum(many)
    at = 0
    while at < len(ids_a):
        until = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most)))
        n = many[at:until]
        index = np.repeat(np.arange(at, min(until, len(ids_a))), n)
        step = np.arange(len(index)) - np.repeat(np.cumsum(n) - n, n)
        yield index, ids_b[np.repeat(first[at:until], n) + step]
        at = until


def digests(sides: Sides, ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, doc_a: np.ndarray, doc_b: np.ndarray, docs: int) -> list[str]:
    """Of each document the sha256 of its groups, ``a1,a2|b1;a3|b2,b3``; empty without tokens."""
    said_a = np.where(_lasts(group_a), sides.said_a["|"][ids_a], sides.said_a[","][ids_a])
    said_b = np.where(_lasts(group_b), sides.said_b[";"][ids_b], sides.said_b[","][ids_b])
    order = np.lexsort((np.repeat(np.arange(2), [len(ids_a), len(ids_b)]), np.concatenate([group_a, group_b])))
    said = np.concatenate([said_a, said_b])[order]
    bounds = np.cumsum(np.bincount(doc_a, minlength=docs) + np.bincount(doc_b, minlength=docs))
    out, before = [], 0
    for bound in bounds.tolist():
        text = "".join(said[before:bound].tolist())[:-1]
        out.append(hashlib.sha256(text.encode()).hexdigest() if text else "")
        before = bound
    return out


LINKS = pa.schema([
    ("row", pa.int64()), ("doc_id", pa.int64()), ("main", pa.bool_()), ("several", pa.bool_()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()),
    ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("pairs", pa.list_(pa.int32())), ("times", pa.list_(pa.int32())),
])
LINKS_DDL = (
    "row long, doc_id long, main boolean, several boolean, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, "
    "pairs array<int>, times array<int>"
)


def _links(both: Sides, rows: list[int], ids: list[int | None], texts: list[str]) -> Iterator[pa.RecordBatch]:
    docs = len(texts)
    tokens_a, tokens_b = both.encode(texts)
    n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in (tokens_a, tokens_b))
    ids_a, ids_b = (np.fromiter((i for x in side for i in x), np.int64, int(n.sum())) for side, n in ((tokens_a, n_a), (tokens_b, n_b)))
    doc_a, doc_b = np.repeat(np.arange(docs), n_a), np.repeat(np.arange(docs), n_b)
    group_a, group_b = coalesce(both.size_a[ids_a], both.size_b[ids_b])
    n_groups = np.bincount(doc_a[_lasts(group_a)], minlength=docs)
    in_b = np.bincount(group_b, minlength=int(group_a[-1]) + 1 if len(group_a) else 0)
    n_links = np.zeros(docs, np.int64)
    np.add.at(n_links, doc_a, in_b[group_a])
    shas = digests(both, ids_a, ids_b, group_a, group_b, doc_a, doc_b, docs)

    # Distinct pairs of each document; what one slice of links has of a document is a row of its own.
    found: list[tuple[int, np.ndarray, np.ndarray]] = []
    for index, of_b in linked(ids_a, ids_b, group_a, group_b):
        key, times = np.unique(doc_a[index] * (WIDTH << 16) + ids_a[index] * WIDTH + of_b, return_counts=True)
        doc = key // (WIDTH << 16)
        pair = (key - doc * (WIDTH << 16)).astype(np.int32)
        for k in np.unique(doc).tolist():
            low, high = np.searchsorted(doc, [k, k + 1])
            for at in range(low, high, ROW_PAIRS):
                found.append((k, pair[at : min(at + ROW_PAIRS, high)], times[at : min(at + ROW_PAIRS, high)].astype(np.int32)))
    main = [(k, np.empty(0, np.int32), np.empty(0, np.int32)) for k in range(docs)]
    extra = []
    for k, pair, times in found:
        if len(main[k][1]):
            extra.append((k, pair, times))
        else:
            main[k] = (k, pair, times)
    several = {k for k, _, _ in extra}
    for mains, some in ((True, main), (False, extra)):
        for at in range(0, len(some), 4096):
            part = some[at : at + 4096]
            k = np.array([x[0] for x in part], np.int64)
            offsets = np.concatenate([[0], np.cumsum([len(x[1]) for x in part])]).astype(np.int32)
            lists = (pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([x[c] for x in part]), pa.int32())) for c in (1, 2))
            yield pa.RecordBatch.from_arrays([
                pa.array([rows[i] for i in k], pa.int64()), pa.array([ids[i] for i in k], pa.int64()), pa.array([mains] * len(k)), pa.array([x[0] in several for x in part]),
                *(pa.array(x[k], pa.int64()) for x in (n_a, n_b, n_groups, n_links)), pa.array([shas[i] for i in k], pa.string()), *lists,
            ], schema=LINKS)


def token_links(docs: DataFrame, ranks_path: str, pieces_path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``row, doc_id, main, several, n_a, n_b, n_groups, n_links, groups_sha256, pairs, times`` of each row of ``docs``.

    A is the byte-level vocabulary of ``ranks_path`` on a blank and the text, B the pieces of ``pieces_path``
    on the text. ``pairs``: distinct linked id pairs, with the number of their links in ``times``; a document
    with very many has further rows that are not ``main``, and ``several`` on all of them. Null and empty texts, and texts that one side does
    not give back byte by byte, have no tokens. Nothing but the two columns is read; ids may be null or repeat.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = sides(ranks_path, pieces_path)
        for batch in batches:
            rows, ids, texts = (batch.column(name).to_pylist() for name in ("row", "doc_id", "text"))
            low, chars = 0, 0
            for at, value in enumerate(texts):
                chars += len(value)
                if chars > BATCH_CHARS or at + 1 == len(texts):
                    yield from _links(both, rows[low : at + 1], ids[low : at + 1], texts[low : at + 1])
                    low, chars = at + 1, 0

    numbered = docs.select(
        F.monotonically_increasing_id().alias("row"), docs[id].cast("long").alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text")
    )
    return numbered.mapInArrow(run, LINKS_DDL)


def pair_counts(links: DataFrame) -> DataFrame:
    """``pair, n_docs, best``: documents that hold each id pair linked, and whether that is the most of its id of A.

    A document whose pairs lie in several rows counts once.
    """
    whole = links.where("NOT several").select(F.explode("pairs").alias("pair"))
    parts = links.where("several").select("row", F.explode("pairs").alias("pair")).distinct().select("pair")
    counts = keep(whole.union(parts).groupBy("pair").agg(F.count(F.lit(1)).alias("n_docs")), "pair-counts")
    most = counts.groupBy(F.floor(F.col("pair") / WIDTH).alias("_a")).agg(F.max("n_docs").alias("_most"))
    # One row for each id of A: the vocabulary bounds it.
    joined = counts.withColumn("_a", F.floor(F.col("pair") / WIDTH)).join(F.broadcast(most), "_a")
    return joined.select("pair", "n_docs", (F.col("n_docs") == F.col("_most")).alias("best"))


def _sent_from(counts: DataFrame, room: int) -> int:
    """The least power of two so that at most ``room`` pairs are in that many documents or more."""
    by_power = counts.groupBy(F.floor(F.log2("n_docs")).cast("int").alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    least, total = 62, 0
    for power, n in sorted(((r["p"], r["n"]) for r in by_power), reverse=True):
        total += n
        if total > room:
            break
        least = power
    return 1 << least


def align(docs: DataFrame, ranks_path: str, pieces_path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` of each row of ``docs``.

    An id pair counts the documents of ``docs`` that hold it linked. ``n_best``: links whose pair counts as
    much as any pair of its id of A; ``count_sum``: the counts of all links. Rows without tokens have zeros
    and an empty digest. Repeated rows are documents of their own; an empty table gives no rows.
    """
    links = keep(token_links(docs, ranks_path, pieces_path, id, text), "links")
    counts = keep(pair_counts(links), "pairs")
    least = _sent_from(counts, SENT_PAIRS)
    sums = [F.sum(F.when(F.col("best"), F.col("t")).otherwise(0)).alias("n_best"), F.sum(F.col("t") * F.col("n_docs")).alias("count_sum")]
    each = links.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("_l")).select(
        "row", F.col("_l.pairs").alias("pair"), F.col("_l.times").cast("long").alias("t")
    )
    sent = F.broadcast(counts.where(F.col("n_docs") >= least))
    frequent = each.join(sent, "pair").groupBy("row").agg(*sums)
    others = each.join(sent.select("pair"), "pair", "left_anti").join(counts.where(F.col("n_docs") < least), "pair").groupBy("row").agg(*sums)
    total = frequent.union(others).groupBy("row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return links.where("main").join(total, "row", "left").select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"),
        F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256",
    )
