"""Mixture-controlled packing by deficit round-robin over source queues.

The documents of a source form a queue of tokens, cut into quanta. After r tokens have been dealt, source s is
owed ``r * share(s)``; what it has not received of that is its deficit. A queue whose deficit has grown to half a
quantum is due and gets a whole one, and the rest of its deficit is carried on: quantum c falls due at
``(c + 1/2) / share(s)``, and quanta are dealt in this order, ties by the queue's number. So the place of a quantum
among all tokens is a count of earlier quanta, a function of the shares and of nothing else: tasks need no schedule
from each other, and deficits carry over windows and partitions because all tasks evaluate the same function. A
queue that is empty leaves the rotation. A task's work depends on its own quanta, not on the windows they span.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clickloom.llm.common import keep

END_OF_TEXT = "<|endoftext|>"
#: Rows of queue offsets that are sent to all tasks; beyond, tokens are joined to them by a shuffle.
SENT_ROWS = 1_000_000
#: Sources of a mixture at most: their totals are a list in every task. And the cells of a matrix of quanta by sources.
SOURCES, CELLS = 100_000, 1 << 21
PIECES = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
    "source string, ids binary"
)


@lru_cache(maxsize=2)
def byte_bpe(path: str):
    """Encoder of one text to ids, for a byte-level vocabulary in rank form."""
    import base64
    import re

    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}

    def encoding(pattern: str):
        return tiktoken.Encoding("words", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_ordinary

    # The published pattern without its look-ahead, which costs half of the time; only a text with two
    # white-space characters in a row needs that, and the encoder for it is built when one turns up.
    quick = encoding(public_tokenizers.PATTERN.replace(r"|\s+(?!\S)", ""))
    exact = lru_cache(maxsize=1)(lambda: encoding(public_tokenizers.PATTERN))
    double = re.compile(r"\s\s")
    special = len(ranks)

    def ids(text: str) -> list[int]:
        out: list[int] = []
        for k, part in enumerate(text.split(END_OF_TEXT)):
            if k:
                out.append(special)
            out += exact()(part) if double.search(part) else quick(part)
        return out

    return ids


def tokenise(docs: DataFrame, ranks_path: str, end_id: int, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """``doc_id, source, n, ids`` and the row's place: ``part, row, before`` (tokens of its source before
    it in its part). Kept in the shared folder, so that places never change."""

    def encode(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids_of = byte_bpe(ranks_path)
        from pyspark import TaskContext

        part, row, sums = TaskContext.get().partitionId(), 0, {}
        for frame in frames:
            for at in range(0, len(frame), 200):  # bounds what Python holds at once
                some, out = frame.iloc[at : at + 200], []
                for doc_id, content, queue in zip(some["doc_id"], some["text"], some["source"], strict=True):
                    ids = np.array([*ids_of(content), end_id], np.uint16)
                    before = sums.get(queue, 0)
                    sums[queue] = before + len(ids)
                    out.append((doc_id, queue, len(ids), ids.tobytes(), part, row, before))
                    row += 1
                yield pd.DataFrame(out, columns=["doc_id", "source", "n", "ids", "part", "row", "before"]).astype({"doc_id": "Int64"})

    rows = docs.select(
        docs[id].cast("long").alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"), docs[source].cast("string").alias("source")
    )
    return keep(
        rows.mapInPandas(encode, "doc_id long, source string, n long, ids binary, part int, row long, before long"), "tokens"
    )


class Mixture:
    """The schedule of some queues: ``totals`` tokens each, dealt by quanta in proportion to ``shares``."""

    def __init__(self, totals: np.ndarray, shares: np.ndarray, quantum: int = 1) -> None:
        self.totals, self.shares, self.quantum = totals.astype(np.int64), shares / shares.sum(), quantum
        self.quanta = -(-self.totals // quantum)

    def before(self, queue: int, numbers: np.ndarray) -> np.ndarray:
        """Tokens of all queues dealt before each of the quanta ``numbers`` of one queue."""
        due, out = (numbers + 0.5) / self.shares[queue], np.empty(len(numbers), np.int64)
        lower = np.arange(len(self.shares)) < queue
        rows = max(1, CELLS // len(self.shares))
        for k in range(0, len(numbers), rows):
            at = due[k : k + rows, None]
            count = np.clip(np.floor(at * self.shares + 0.5), 0, self.quanta).astype(np.int64)
            # A product may round to either side of a due time; the due times themselves decide.
            count -= (count > 0) & ~self._sooner(count - 1, at, lower)
            count += (count < self.quanta) & self._sooner(count, at, lower)
            out[k : k + rows] = np.minimum(count * self.quantum, self.totals).sum(axis=1)
        return out

    def _sooner(self, numbers: np.ndarray, at: np.ndarray, lower: np.ndarray) -> np.ndarray:
        due = (numbers + 0.5) / self.shares
        return (due < at) | (due == at) & lower


def _pieces(mixture: Mixture, queue: int, first: int, counts: np.ndarray, window: int):
    """For consecutive documents of one queue from its token ``first`` on: the piece's document, start in
    the document, length, window and offset there. Windows are no shorter than a quantum."""
    edges = first + np.concatenate([[0], np.cumsum(counts)])
    numbers = np.arange(edges[0] // mixture.quantum, (edges[-1] - 1) // mixture.quantum + 1)
    heads, before = numbers * mixture.quantum, mixture.before(queue, numbers)
    # A quantum is cut where a window ends in it.
    ends = heads + -before % window
    ends = ends[ends < heads + mixture.quantum]
    cuts = np.concatenate([heads, ends])
    cuts = np.unique(np.concatenate([edges, cuts[(cuts > edges[0]) & (cuts < edges[-1])]]))
    begin, length = cuts[:-1], np.diff(cuts)
    doc = np.searchsorted(edges, begin, side="right") - 1
    number = begin // mixture.quantum - numbers[0]
    place = before[number] + begin - heads[number]
    # Quanta of a document that follow each other inside a window are one piece.
    apart = np.ones(len(begin), bool)
    apart[1:] = (doc[1:] != doc[:-1]) | (place[1:] != place[:-1] + length[:-1]) | (place[1:] % window == 0)
    kept = np.flatnonzero(apart)
    begin, doc, place, length = begin[kept], doc[kept], place[kept], np.add.reduceat(length, kept)
    return doc, begin - edges[doc], length, place // window, place % window


def pack(
    docs: DataFrame,
    ranks_path: str,
    end_id: int,
    window: int = 2048,
    targets: dict[str, float] | None = None,
    quantum: int | None = None,
    id: str = "doc_id",
    text: str = "text",
    source: str = "source",
) -> DataFrame:
    """One row per piece of a document: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, source, ids`` (unsigned little-endian 16-bit), in sequences of ``window`` tokens.

    ``targets`` are the token proportions of sources; by default those of the table itself, so that all
    queues end together. A due queue gets ``quantum`` tokens at once, an eighth of a window unless given and never more
    than a window: pieces are that long, but for ends of documents, windows and queues, and after any number of
    windows a source departs from its share by a quantum for every two sources and one at most. More than
    ``SOURCES`` sources are an error: no list of sources, but ids, are in the column then. All tokens are packed: only the last sequence is padded. Null text is empty and
    gives the end token alone; null ids and repeated rows are packed like others; a null source is a queue
    of its own. With ``targets`` every source needs a positive one, under ``None`` for the null source. Ids
    must be below 65 536. Other columns are not read; an empty table gives no rows.
    """
    quantum = max(1, window // 8) if quantum is None else quantum
    if not 1 <= quantum <= window:
        raise ValueError(f"A quantum of {quantum} does not fit a window of {window} tokens")
    tokens = tokenise(docs, ranks_path, end_id, id, text, source)
    by_part = tokens.groupBy("source", "part").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    queues = by_part.select(
        F.col("source").alias("_source"), F.col("part").alias("_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("queue_before")
    )
    found = by_part.groupBy("source").agg(F.sum("n").alias("n")).limit(SOURCES + 1).collect()
    if len(found) > SOURCES:
        raise ValueError(f"More than {SOURCES} sources")
    totals = {row["source"]: row["n"] for row in found}
    names = sorted(totals, key=lambda name: (name is not None, name))
    if targets is not None and any(not targets.get(name, 0) > 0 for name in names):
        raise ValueError("Every source needs a positive target")
    sizes = np.array([totals[name] for name in names], np.int64)
    shares = sizes.astype(float) if targets is None else np.array([targets[name] for name in names], float)

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mixture, number = Mixture(sizes, shares, quantum), {name: k for k, name in enumerate(names)}
        for frame in frames:
            frame["at"] = frame["queue_before"] + frame["before"]
            for name, rows in frame.groupby("source", dropna=False):
                rows = rows.sort_values("at")
                queue = number[None if pd.isna(name) else name]
                at, n, ids = rows["at"].to_numpy(), rows["n"].to_numpy(), rows["ids"].to_numpy()
                # Documents that follow each other in the queue are cut together.
                for run in np.split(np.arange(len(rows)), np.flatnonzero(at[1:] != at[:-1] + n[:-1]) + 1):
                    doc, start, length, sequence, offset = _pieces(mixture, queue, int(at[run[0]]), n[run], window)
                    doc = run[doc]
                    parts = [ids[d][2 * s : 2 * (s + k)] for d, s, k in zip(doc, start, length, strict=True)]
                    yield pd.DataFrame(
                        {
                            "doc_id": rows["doc_id"].astype("Int64").to_numpy()[doc], "start": start, "length": length,
                            "ids_crc32": [zlib.crc32(np.frombuffer(x, "<u2").astype("<u4").tobytes()) for x in parts],
                            "doc_tokens": n[doc], "sequence_id": sequence, "offset": offset, "source": name, "ids": parts,
                        }
                    ).astype({"doc_id": "Int64", "source": object}).replace({"source": {np.nan: None}})

    # A row per part and source goes to all tasks, up to a bound, so that ids stay where they were written.
    queues = F.broadcast(queues) if by_part.count() <= SENT_ROWS else queues.hint("merge")
    placed = tokens.join(queues, (F.col("part") == F.col("_part")) & F.col("source").eqNullSafe(F.col("_source")))
    return placed.select("doc_id", "source", "n", "ids", "before", "queue_before").mapInPandas(cut, PIECES)
