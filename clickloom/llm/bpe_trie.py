"""Byte-level BPE over a trie of distinct words, and its inverse.

The words of a batch that are new to a task enter a trie of their bytes. The BPE encoding of a prefix is
fixed by its last token: that token t is the one suffix of the prefix for which the last token before t
and t would not merge across their border. A depth-first walk therefore hands each node the last tokens
of its ancestors and finds its own; what words share is encoded once, and a word's ids are read by
following last tokens back from its end.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The byte-level split of words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Words a worker remembers before it starts anew.
MEMO = 800_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Tokens, merges and special tokens of a byte-level tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        self.byte = {s: b for b, s in enumerate(byte_symbols())}
        self.bytes_of = {i: bytes(map(self.byte.__getitem__, t)) for t, i in told["model"]["vocab"].items()}
        self.id_of = {b: i for i, b in self.bytes_of.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(told["model"]["merges"]):
            a, b = (told["model"]["vocab"][x] for x in (merge if isinstance(merge, list) else merge.split(" ")))
            self.rank[a, b] = rank
            self.halves.setdefault(self.id_of[self.bytes_of[a] + self.bytes_of[b]], (rank, a, b))
        # Lengths of the tokens that may end a prefix, by its last three bytes, longest first.
        lengths: dict[bytes, set[int]] = {}
        for token in self.id_of:
            if len(token) > 2:
                lengths.setdefault(token[-3:], set()).add(len(token))
        self.lengths = {last: (*sorted(x, reverse=True), 2, 1) for last, x in lengths.items()}
        self.special = {t["content"]: t["id"] for t in told.get("added_tokens", [])}
        self.kept_apart: dict[tuple[int, int], bool] = {}

    def apart(self, left: int, right: int) -> bool:
        """Whether BPE leaves a border between these two neighbouring tokens.

        Goes back through the merges of both, latest first; a pair at the border that could have merged
        before the merges still undone would have been taken.
        """
        if (known := self.kept_apart.get((left, right))) is not None:
            return known
        a, b, undone = left, right, 1 << 60
        while True:
            if self.rank.get((a, b), undone) < undone:
                result = False
                break
            of_a, of_b = self.halves.get(a), self.halves.get(b)
            if of_a is None and of_b is None:
                result = True
                break
            # A merge on the left goes first at equal rank, so it is undone last.
            if of_b is None or of_a is not None and of_a[0] > of_b[0]:
                undone, a = of_a[0], of_a[2]
            else:
                undone, b = of_b[0] + 1, of_b[1]
        if len(self.kept_apart) > 2_000_000:
            self.kept_apart.clear()
        self.kept_apart[left, right] = result
        return result


def encode_words(vocabulary: Vocabulary, words: Iterable[bytes]) -> dict[bytes, list[int]]:
    """Ids of distinct words, through one trie.

    The trie is kept in its compact form, as the sorted words with the length that each shares with the
    one before. That order is the depth-first walk: ``last`` holds the states of the path from the root,
    a word keeps those of its shared prefix and computes those of its own nodes.
    """
    out: dict[bytes, list[int]] = {}
    id_of, lengths, apart = vocabulary.id_of, vocabulary.lengths, vocabulary.apart
    ordered = sorted(words)
    longest = max(map(len, ordered), default=0)
    last, size = [-1] * (longest + 1), [0] * (longest + 1)  # last token, and its length, of the path's prefixes
    before = b""
    for word in ordered:
        shared, most = 0, min(len(word), len(before))
        while shared < most and word[shared] == before[shared]:
            shared += 1
        for depth in range(shared + 1, len(word) + 1):
            for n in lengths.get(word[max(0, depth - 3) : depth], (2, 1)):
                if n <= depth and (token := id_of.get(word[depth - n : depth])) is not None:
                    if n == depth or apart(last[depth - n], token):
                        last[depth], size[depth] = token, n
                        break
        ids, at = [], len(word)
        while at:
            ids.append(last[at])
            at -= size[at]
        out[word] = ids[::-1]
        before = word
    return out


class Encoder:
    """Splits texts to words and remembers the encoding of each word it has met."""

    def __init__(self, path: str) -> None:
        self.vocabulary = Vocabulary(path)
        special = self.vocabulary.special
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.exact = regex.compile(WORDS)
        # The same split by the faster standard module, for texts without letters or numbers on which they differ.
        import re
        import sys
        import unicodedata

        self.quick = re.compile(r"'(?:[stmd]|re|ve|ll)| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")
        self.odd = {c for c in map(chr, range(sys.maxunicode + 1)) if unicodedata.category(c) in ("Nl", "No")} | set("\x1c\x1d\x1e\x1f")
        self.known: dict[str, tuple[str, str]] = {}
        self.older: dict[str, tuple[str, str]] = {}

    def words(self, text: str) -> list[str]:
        plain = self.odd.isdisjoint(text) if not text.isascii() else not (self.odd & set(text) if "\x1c" <= min(text, default=" ") <= "\x1f" else set())
        return (self.quick if plain else self.exact).findall(text)

    def parts(self, text: str) -> list[list[str] | str]:
        """The text's words, with special tokens between them as plain strings."""
        if self.special is None or not any(s in text for s in self.vocabulary.special):
            return [self.words(text)]
        return [x if k % 2 else self.words(x) for k, x in enumerate(self.special.split(text))]

    def learn(self, words: set[str]) -> None:
        """``known[word]``: the ids joined by commas, and what they decode to.

        Two generations bound the memory: words in use move to the younger one, the older one is let go.
        """
        if len(self.known) > MEMO // 2:
            self.known, self.older = {}, self.known
        known, older = self.known, self.older
        new = {}
        for word in words:
            if word not in known:
                if (found := older.get(word)) is not None:
                    known[word] = found
                else:
                    new[word.encode("utf-8", "surrogatepass")] = word
        bytes_of = self.vocabulary.bytes_of
        for raw, ids in encode_words(self.vocabulary, new).items():
            word, back = new[raw], b"".join(map(bytes_of.__getitem__, ids))
            known[word] = (",".join(map(str, ids)), word if back == raw else back.decode("utf-8", "replace"))

    def encode(self, texts: list[str]) -> Iterator[tuple[int, str, str]]:
        """Of each text: number of ids, ids joined by commas, decoded text."""
        split = [self.parts(t) for t in texts]
        self.learn({w for parts in split for part in parts if not isinstance(part, str) for w in part})
        known, special = self.known, self.vocabulary.special
        for parts in split:
            found: list[tuple[str, str]] = []
            for part in parts:
                found += [(str(special[part]), part)] if isinstance(part, str) else map(known.__getitem__, part)
            ids = ",".join([x[0] for x in found])
            yield ids.count(",") + bool(ids), ids, "".join([x[1] for x in found])


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def _batches(frame: pd.DataFrame, chars: int = 2_000_000) -> Iterator[pd.DataFrame]:
    """Row ranges of bounded text, so that a batch of long documents needs no more memory than others."""
    part = (frame["text"].str.len().cumsum() // chars).to_numpy()
    for _, rows in frame.groupby(part, sort=True):
        yield rows


def encode_texts(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of each row: the ids joined by commas and the text they decode to.

    Special tokens are found in texts. Null and empty texts have no ids. Rows keep their null and repeated
    ids; nothing but the two columns is read; an empty table gives no rows.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for rows in _batches(frame):
                found = list(encoder(path).encode(list(rows["text"])))
                yield pd.DataFrame({"doc_id": rows["doc_id"].astype("Int64").to_numpy(), "n_tokens": [x[0] for x in found], "ids": [x[1] for x in found], "decoded": [x[2] for x in found]}).astype({"doc_id": "Int64"})

    rows = docs.select(docs[id].cast("long").alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    return rows.mapInPandas(run, "doc_id long, n_tokens long, ids string, decoded string")


def encode_digests(docs: DataFrame, path: str, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256``: ``encode_texts`` with the long columns digested
    where they arise."""

    def sha(value: str) -> str:
        return hashlib.sha256(value.encode("utf-8", "surrogatepass")).hexdigest()

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for rows in _batches(frame):
                found = [(n, sha(ids), sha(decoded)) for n, ids, decoded in encoder(path).encode(list(rows["text"]))]
                out = pd.DataFrame(found, columns=["n_tokens", "ids_sha256", "decoded_sha256"])
                out.insert(0, "doc_id", rows["doc_id"].astype("Int64").to_numpy())
                yield out.astype({"doc_id": "Int64"})

    rows = docs.select(docs[id].cast("long").alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text"))
    return rows.mapInPandas(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
