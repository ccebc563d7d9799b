"""Language identification by interpolated Kneser-Ney character models in sorted hash arrays.

A text is reduced to its letters in lower case, with one blank for whatever lies between words. Each
language has a model of character n-grams up to ``order``. A text goes to the language of the lowest
cross-entropy per character, and is rejected when that is too high for the language, by a bound that is
calibrated on the training texts and widens for short ones.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

UNKNOWN = "und"
BLANK = 32
JUDGED = "lang_pred string, score double, accepted boolean, cross_entropy double, n_letters long"
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: Scored n-grams that a worker remembers before it starts anew.
MEMO = 2_000_000
#: One of so many texts calibrates; languages of fewer than FEW texts are calibrated by leaving out as many parts.
PARTS, FEW = 5, 25
#: Groups of tasks that find the sample's texts before they are ranked as a whole.
GROUPS = 64


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(sys.maxunicode + 1)])


def symbols(text: str) -> np.ndarray:
    """Code points of the lower-case letters, with one blank around each run of letters; empty without any."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[np.minimum(codes, sys.maxunicode)]
    if not letter.any():
        return codes[:0]
    after_letter = np.concatenate([[True], letter[:-1]])
    return np.where(letter, codes, np.uint32(BLANK))[letter | after_letter]


def hash_of(columns: list[np.ndarray]) -> np.ndarray:
    """Hash of n-grams, given as one column of code points for each of their n places."""
    out = np.zeros(len(columns[0]), np.uint64)
    for c in columns:
        out = (out + c.astype(np.uint64) + np.uint64(1)) * MULTIPLIER
        out ^= out >> np.uint64(29)
    return out


@dataclass
class Model:
    """One language: for each length, sorted hashes with their discounted probability, and for each
    context its weight for the next shorter length."""

    hashes: list[np.ndarray]
    kept: list[np.ndarray]
    contexts: list[np.ndarray]
    weights: list[np.ndarray]
    floor: float
    mean: float = 0.0
    spread: float = 1.0

    def log2(self, by_length: list[np.ndarray]) -> np.ndarray:
        """Log probability of symbols; ``by_length[n - 1]`` has the hashes of the n-grams that end in them."""
        p = np.full(len(by_length[0]), self.floor)
        for n in range(1, len(self.hashes) + 1):
            weight = np.full(len(p), self.weights[0][0]) if n == 1 else _found(self.contexts[n - 1], self.weights[n - 1], by_length[n - 1][1], 1.0)
            gram = by_length[0] if n == 1 else by_length[n - 1][0]
            p = _found(self.hashes[n - 1], self.kept[n - 1], gram, 0.0) + weight * p
        return np.log2(p)


def _found(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, default: float) -> np.ndarray:
    if not len(keys):
        return np.full(len(wanted), default)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], default)


def _fit(counts: list[dict[tuple, int]], alphabet: int) -> Model:
    """Interpolated Kneser-Ney, with one discount per length, from the counts of each length's n-grams.

    The longest n-grams are counted as they occur, shorter ones by how many symbols they follow.
    """
    order, hashes, kept, contexts, weights = len(counts), [], [], [], []
    for n in range(1, order + 1):
        if n == order:
            used = counts[n - 1]
        else:
            used = {}
            for gram in counts[n]:
                used[gram[1:]] = used.get(gram[1:], 0) + 1
        ones = sum(1 for c in used.values() if c == 1)
        twos = sum(1 for c in used.values() if c == 2)
        discount = ones / (ones + 2 * twos) if ones and twos else 0.5
        total: dict[tuple, int] = {}
        kinds: dict[tuple, int] = {}
        for gram, c in used.items():
            total[gram[:-1]] = total.get(gram[:-1], 0) + c
            kinds[gram[:-1]] = kinds.get(gram[:-1], 0) + 1
        for keys, values, of in (
            (hashes, kept, {g: (c - discount) / total[g[:-1]] for g, c in used.items()}),
            (contexts, weights, {h: discount * kinds[h] / total[h] for h in total}),
        ):
            places = np.array(list(of), np.uint32).reshape(len(of), -1).T
            h = hash_of(list(places)) if len(places) else np.zeros(1, np.uint64)
            rank = np.argsort(h)
            keys.append(h[rank])
            values.append(np.array(list(of.values()), float)[rank])
    return Model(hashes, kept, contexts, weights, 1.0 / alphabet)


def held_out(id, parts: int = 4, part: int = 2):
    return F.pmod(F.crc32(id.cast("string")), F.lit(parts)) == part


def sample(docs: DataFrame, texts: int, chars: int, id: str, text: str, lang: str) -> DataFrame:
    """The bounded training sample ``_lang, _text, _n, _k``: per language the ``texts`` distinct texts of the
    smallest id hash, with their rank from 1 on and the number of ranks. Of a text of more than ``chars``
    characters the first ``chars`` are taken. Equal hashes go by a hash of the text. The smallest are found for each
    of ``GROUPS`` groups of tasks first: a group meets ``texts`` of a language from each of its tasks, and the last
    ranking ``GROUPS * texts`` at most."""
    start = F.substring(docs[text], 1, chars)
    labelled = docs.where(docs[lang].isNotNull() & docs[text].isNotNull()).select(docs[lang].alias("_lang"), start.alias("_text"), docs[id].cast("string").alias("_id"))
    rows = labelled.withColumn("_digest", F.xxhash64("_text"))
    # Copies collapse in each task before the shuffle, and no text is moved for the ranks.
    distinct, each = rows.groupBy("_lang", "_digest").agg(F.min(F.xxhash64("_id", F.lit(17))).alias("_at")), Window.partitionBy("_lang")
    order = ["_at", "_digest"]
    grouped = distinct.withColumn("_group", F.spark_partition_id() % GROUPS)
    nearly = grouped.withColumn("_n", F.row_number().over(Window.partitionBy("_lang", "_group").orderBy(*order))).where(F.col("_n") <= texts)
    first = nearly.drop("_group").withColumn("_n", F.row_number().over(each.orderBy(*order))).where(F.col("_n") <= texts)
    first = first.withColumn("_k", F.count(F.lit(1)).over(each)).drop("_at")
    return rows.join(F.broadcast(first), ["_lang", "_digest"]).dropDuplicates(["_lang", "_n"]).select("_lang", "_text", "_n", "_k")


def _add_grams(found: dict[str, int], codes: np.ndarray, order: int, sign: int = 1) -> None:
    s = "".join(map(chr, codes))
    for n in range(1, order + 1):
        for k in range(len(s) - n + 1):
            found[s[k : k + n]] = found.get(s[k : k + n], 0) + sign


def _model(counts: dict[str, int], order: int, alphabet: int) -> Model:
    by_length: list[dict[tuple, int]] = [{} for _ in range(order)]
    for gram, c in counts.items():
        by_length[len(gram) - 1][tuple(map(ord, gram))] = c
    # A language with a handful of symbols may lack the longest n-grams.
    while len(by_length) > 1 and not by_length[-1]:
        by_length.pop()
    return _fit(by_length, alphabet)


def _left_out(counts: dict[str, int], texts: list[np.ndarray], order: int, alphabet: int) -> tuple[np.ndarray, np.ndarray]:
    """Bits and lengths of a language's few training texts, each under the counts of the other parts."""
    if len(texts) == 1:  # a single text is left out by fifths
        texts = [s for s in np.array_split(texts[0], PARTS) if len(s)]
    bits, lengths = [np.zeros(0)], [np.zeros(0)]
    for part in (texts[k::PARTS] for k in range(min(PARTS, len(texts)))):
        rest = dict(counts)
        for s in part:
            _add_grams(rest, s, order, -1)
        if rest := {gram: c for gram, c in rest.items() if c > 0}:
            bits.append(Scorer({"": _model(rest, order, alphabet)}, order).bits(part)[:, 0])
            lengths.append(np.array([len(s) for s in part], float))
    return np.concatenate(bits), np.concatenate(lengths)


def train(docs: DataFrame, order: int = 4, texts: int = 400, chars: int = 20_000, id: str = "doc_id", text: str = "text", lang: str = "lang") -> dict[str, Model]:
    """A model per language, from at most ``texts`` distinct texts of each, and of those at most the first ``chars`` characters.

    n-grams are counted by Spark; what comes to the driver is bounded by the sample. Every fifth text by
    rank calibrates what cross-entropies are usual. A language of fewer than ``FEW`` texts learns from all
    of them, and is calibrated by leaving out a fifth at a time, with a spread not below that of the other
    languages. Without any text to calibrate on, mean and spread are those of the other languages, or else
    those of the uniform distribution. Languages without a letter in their sample get no model.
    """

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for language, rows in frame.groupby("_lang"):
                found: dict[str, int] = {}
                for content in rows["_text"]:
                    _add_grams(found, symbols(content), order)
                yield pd.DataFrame({"_lang": language, "gram": list(found), "c": list(found.values())})

    chosen = sample(docs, texts, chars, id, text, lang).withColumn("_check", (F.col("_k") >= FEW) & (F.col("_n") % PARTS == 0)).cache()
    try:
        counted = chosen.where(~F.col("_check")).mapInPandas(count, "_lang string, gram string, c long").groupBy("_lang", "gram").agg(F.sum("c").alias("c")).toPandas()
        checks = chosen.where(F.col("_check") | (F.col("_k") < FEW)).toPandas().sort_values("_n")
    finally:
        chosen.unpersist()
    models, alphabet = {}, 2 + int((counted["gram"].str.len() == 1).sum())
    few, deviations, all_bits, all_letters = set(), [], 0.0, 0.0
    for language, rows in sorted(counted.groupby("_lang"), key=lambda x: x[0]):
        counts = dict(zip(rows["gram"], rows["c"], strict=True))
        model = models[language] = _model(counts, order, alphabet)
        mine = checks[checks["_lang"] == language]
        own = [s for s in map(symbols, mine["_text"]) if len(s)]
        if not own:
            few.add(language)
            continue
        if mine["_check"].any():
            bits, n = Scorer({language: model}, order).bits(own)[:, 0], np.array([len(s) for s in own])
        else:
            few.add(language)
            bits, n = _left_out(counts, own, order, alphabet)
        if len(n):
            model.mean = float(bits.sum() / n.sum())
            squares = (bits / n - model.mean) ** 2 * n
            model.spread = float(max(0.05, np.sqrt(np.mean(squares))))
            if language not in few:
                deviations.append(squares)
                all_bits, all_letters = all_bits + bits.sum(), all_letters + n.sum()
    for language in few:
        model = models[language]
        if all_letters:
            model.spread = max(model.spread if model.mean else 0.05, float(np.sqrt(np.mean(np.concatenate(deviations)))))
        model.mean = model.mean or (float(all_bits / all_letters) if all_letters else float(np.log2(alphabet)))
    return models


class Scorer:
    """Bits of texts under every model; each distinct n-gram is looked up once and remembered."""

    def __init__(self, models: dict[str, Model], order: int) -> None:
        self.names, self.models, self.order = list(models), list(models.values()), order
        self.keys, self.logs = np.zeros(0, np.uint64), np.zeros((0, len(self.models)))

    def _score(self, codes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Log probability, under every model, of the symbols at ``ends``."""
        by_length: list = [hash_of([codes[ends]])]
        for n in range(2, self.order + 1):
            columns = [codes[ends - k] for k in range(n - 1, -1, -1)]
            by_length.append((hash_of(columns), hash_of(columns[:-1])))
        return np.column_stack([m.log2(by_length[: len(m.hashes)]) for m in self.models])

    def bits(self, texts: list[np.ndarray]) -> np.ndarray:
        """A row per text (none empty), a column per model."""
        # Blanks in front let every symbol have a whole context and keep texts apart.
        pad = np.full(self.order - 1, BLANK, np.uint32)
        codes = np.concatenate([x for t in texts for x in (pad, t)])
        lengths = np.array([len(t) for t in texts])
        starts = np.cumsum(lengths + self.order - 1) - lengths
        ends = np.arange(lengths.sum()) + np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
        ids, distinct = pd.factorize(hash_of([codes[ends - k] for k in range(self.order - 1, -1, -1)]))
        distinct = np.asarray(distinct, np.uint64)
        at = np.searchsorted(self.keys, distinct)
        new = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] != distinct) if len(self.keys) else np.arange(len(distinct))
        if len(new):
            if len(self.keys) + len(new) > MEMO:
                self.keys, self.logs, new = self.keys[:0], self.logs[:0], np.arange(len(distinct))
            first = np.zeros(len(distinct), np.int64)
            first[ids[::-1]] = np.arange(len(ids))[::-1]
            logs = self._score(codes, ends[first[new]])
            keys = np.concatenate([self.keys, distinct[new]])
            rank = np.argsort(keys)
            self.keys, self.logs = keys[rank], np.concatenate([self.logs, logs])[rank]
            at = np.searchsorted(self.keys, distinct)
        per_symbol = self.logs[at][ids]
        return -np.add.reduceat(per_symbol, np.cumsum(lengths) - lengths, axis=0)


def judge(models: dict[str, Model], order: int, limit: float, excess: float):
    """A column function from text to ``lang_pred, score, accepted, cross_entropy, n_letters``."""

    @F.pandas_udf(JUDGED)
    def run(series: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        scorer = Scorer(models, order)
        mean, spread = np.array([m.mean for m in scorer.models]), np.array([m.spread for m in scorer.models])
        for texts in series:
            # Ranges of bounded text: long documents need no more memory than others.
            part = np.cumsum([len(t or "") for t in texts]) // 2_000_000
            outs = []
            for _, rows in texts.groupby(part, sort=True):
                found = [symbols(t or "") for t in rows]
                n = np.array([len(s) for s in found])
                out = pd.DataFrame({"lang_pred": UNKNOWN, "score": 0.0, "accepted": False, "cross_entropy": np.nan, "n_letters": n})
                if (some := np.flatnonzero(n)).size and models:
                    rate = scorer.bits([found[k] for k in some]) / n[some, None]
                    best = rate.argmin(axis=1)
                    lowest = rate[np.arange(len(some)), best]
                    evidence = np.exp2(-(rate - lowest[:, None]) * np.minimum(n[some], 50)[:, None])
                    out.loc[some, "lang_pred"] = np.array(scorer.names, object)[best]
                    out.loc[some, "score"] = 1.0 / evidence.sum(axis=1)
                    out.loc[some, "cross_entropy"] = lowest
                    out.loc[some, "accepted"] = lowest <= mean[best] + excess + limit * spread[best] / np.sqrt(n[some])
                outs.append(out)
            yield pd.concat(outs, ignore_index=True) if outs else pd.DataFrame(columns=["lang_pred", "score", "accepted", "cross_entropy", "n_letters"])

    return run


def identify(docs: DataFrame, models: dict[str, Model], order: int = 4, limit: float = 4.0, excess: float = 1.5, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, lang_pred, score, accepted, cross_entropy, n_letters`` of each row, over whole texts.

    ``score`` is the share of the best language in the evidence, by the cross-entropies of the text taken
    over at most 50 symbols, so that it does not saturate with length. ``accepted`` is false when the
    cross-entropy exceeds the language's usual one by more than ``excess`` bits, which junk and mixed text
    of known languages stay below, and ``limit`` calibrated deviations of the mean of so many symbols. A text that is null, empty or without a letter is ``und`` with score 0 and
    not accepted; so is every text when there is no model. Ties go to the first language by name. Null
    and repeated ids stay as they are; other columns are not read.
    """
    rows = docs.select(docs[id].cast("long").alias("doc_id"), judge(models, order, limit, excess)(docs[text]).alias("_judged"))
    return rows.select("doc_id", "_judged.*")


def keep_identified(docs: DataFrame, models: dict[str, Model], order: int = 4, limit: float = 4.0, excess: float = 1.5, text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose text is accepted; nothing is shuffled and no column changes.

    Null texts and those without a letter go, repeated rows stay as often as they are. Without any model, as
    where no document has a label, nothing can be judged and all rows stay.
    """
    if not models:
        return docs
    return docs.where(judge(models, order, limit, excess)(docs[text])["accepted"])
