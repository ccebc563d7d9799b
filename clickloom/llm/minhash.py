"""Near-duplicate documents: universal hash minima, banding, verification, connected components.

1. Each text becomes its set of word shingles; equal sets collapse to one representative.
2. A representative has ``bands * rows`` minima under universal hashes. ``rows`` minima make a band's key,
   and a byte of each minimum goes to the signature.
3. In each bucket of equal keys every member is compared with the smallest one: by signature first, and
   then exactly, on the full sets.
4. Components of these links leave few buckets with several components. Members of such a bucket that
   are not in its largest component meet the rest of it by signature, block by block; what agrees across
   components ties the components to a cluster, by at most one tie per member and block.
5. In a cluster of several components the members of all but the largest meet the rest of it once more,
   block by block, now on the full sets; what is similar enough gives the remaining links.
6. Components of all links, and from representatives back to documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import re
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import keep
from clickloom.llm.components import components, join_labels

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
#: Deviations of a signature's estimate below the threshold at which a pair is still checked exactly.
SLACK = 5.0
#: Members in a block of steps 4 and 5.
BLOCK = 1024
#: Pairs whose signatures are compared at once.
PAIRS = 100_000
#: Ids that are sent to all tasks to pick texts; beyond, texts are joined to them by a shuffle.
SENT_IDS = 4_000_000
#: Distinct words that a worker remembers the hash of before it starts anew.
MEMO = 500_000


class Shingler:
    """Sets of word shingles as sorted 64-bit hashes."""

    def __init__(self, words: int) -> None:
        self.words, self.known = words, {}

    def __call__(self, text: str | None) -> np.ndarray:
        found = WORD.findall(text.translate(LOWER)) if text else []
        if not found:
            return np.zeros(0, np.uint64)
        if len(self.known) > MEMO:
            self.known.clear()
        known = self.known
        for word in found:
            if word not in known:
                known[word] = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        hashes = np.fromiter(map(known.__getitem__, found), np.uint64, len(found))
        n = min(self.words, len(hashes))
        out = np.full(len(hashes) - n + 1, n, np.uint64)
        for k in range(n):
            out = (out ^ hashes[k : k + len(out)]) * np.uint64(0x9E3779B97F4A7C15)
            out ^= out >> np.uint64(32)
        return np.unique(out)


def universal(count: int, seed: int = 20_240_101) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers, odd, and addends of ``count`` multiply-add hashes modulo 2^32."""
    draw = np.random.default_rng(seed)
    return draw.integers(0, 1 << 31, count, np.uint32) * np.uint32(2) + np.uint32(1), draw.integers(0, 1 << 32, count, np.uint32)


def minima(shingles: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least value of each hash over a set that is not empty."""
    x = (shingles >> np.uint64(32)).astype(np.uint32) ^ shingles.astype(np.uint32)
    out = np.full(len(a), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(x), 2048):
        values = a[:, None] * x[None, at : at + 2048] + b[:, None]
        np.minimum(out, values.min(axis=1), out=out)
    return out


def sign(docs: DataFrame, words: int, bands: int, rows: int, id: str, text: str) -> DataFrame:
    """``doc_id, n_shingles, set_id, keys, signature`` of each row; the last three are null for empty sets."""
    a, b = universal(bands * rows)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(words)
        for frame in frames:
            out = []
            for doc_id, content in zip(frame["doc_id"], frame["text"], strict=True):
                shingles = shingler(content)
                if not len(shingles):
                    out.append((doc_id, 0, None, None, None))
                    continue
                least = minima(shingles, a, b)
                keys = [xxhash.xxh64_intdigest(band.tobytes(), k) - (1 << 63) for k, band in enumerate(least.reshape(bands, rows))]
                out.append((doc_id, len(shingles), xxhash.xxh128_digest(shingles.tobytes()), keys, (least & 255).astype(np.uint8).tobytes()))
            yield pd.DataFrame(out, columns=["doc_id", "n_shingles", "set_id", "keys", "signature"]).astype({"doc_id": "Int64"})

    rows_in = docs.select(docs[id].cast("long").alias("doc_id"), docs[text].alias("text"))
    return rows_in.mapInPandas(run, "doc_id long, n_shingles long, set_id binary, keys array<long>, signature binary")


def least_agreement(hashes: int, threshold: float) -> int:
    """Equal bytes that a pair of signatures shows at least, but for ``SLACK`` deviations."""
    p = threshold + (1 - threshold) / 256
    return int(np.floor(hashes * p - SLACK * np.sqrt(hashes * p * (1 - p))))


def _agreeing(pairs: DataFrame, least: int) -> DataFrame:
    """The pairs ``a, b`` whose signatures ``sa, sb`` agree in ``least`` places."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if len(frame):
                left, right = (np.frombuffer(b"".join(frame[c]), np.uint8).reshape(len(frame), -1) for c in ("sa", "sb"))
                yield frame.loc[(left == right).sum(axis=1) >= least, ["a", "b"]]

    return pairs.mapInPandas(run, "a long, b long")


def shingle_sets(nodes: DataFrame, docs: DataFrame, words: int, id: str, text: str) -> DataFrame:
    """``node, shingles`` of the rows whose id is among ``nodes``: only their texts are shingled again."""
    wanted = keep(nodes.select("node").distinct(), "wanted")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shingler = Shingler(words)
        for frame in frames:
            for at in range(0, len(frame), 500):
                some = frame.iloc[at : at + 500]
                yield pd.DataFrame({"node": some["node"], "shingles": [shingler(t).astype("<i8") for t in some["text"]]})

    rows = docs.select(docs[id].cast("long").alias("node"), docs[text].alias("text")).where("node IS NOT NULL")
    # Either way the same rows: eight bytes an id go to every task, up to a bound, or all texts are shuffled.
    picked = F.broadcast(wanted) if wanted.count() <= SENT_IDS else wanted.hint("merge")
    return keep(rows.join(picked, "node", "left_semi").mapInPandas(run, "node long, shingles array<long>"), "sets")


def linked(pairs: DataFrame, docs: DataFrame, words: int, percent: int, id: str, text: str) -> DataFrame:
    """Of the distinct pairs ``a, b`` those whose full sets are similar enough."""
    sets = shingle_sets(pairs.select(F.col("a").alias("node")).union(pairs.select("b")), docs, words, id, text)
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("y"))
    shared = F.size(F.array_intersect("x", "y"))
    compared = pairs.join(left, "a").join(right, "b").select("a", "b", shared.alias("n"), (F.size("x") + F.size("y")).alias("m"))
    return compared.where(F.expr(f"100 * n >= {percent} * (m - n)")).select("a", "b")


def _meetings(members: DataFrame, group: str) -> DataFrame:
    """Deals the rows ``group, node, component`` of groups with several components to block pairs.

    Adds ``h, v, home``: rows of home block ``h`` meet the visitors of block ``v``, which are the members
    outside the group's largest component. A member goes once to each visitor block as a host, and a
    visitor once to each home block, so a group of n with s visitors makes about ``(n * s) / BLOCK`` rows
    beyond its own n, and no meeting is larger than two blocks.
    """
    wide = [F.xxhash64("node", F.lit(k)).cast("decimal(38,0)") for k in (1, 2)]
    by_component = members.groupBy(group, "component").agg(
        F.count(F.lit(1)).alias("n"), F.sum(wide[0]).alias("_x"), F.sum(wide[1]).alias("_y")
    )
    most = by_component.groupBy(group).agg(
        F.sum("n").alias("n"), F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "component")).alias("largest"),
        F.sum("_x").alias("_x"), F.sum("_y").alias("_y"),
    )
    # Groups of the same members, as copies make them in all bands they share, meet once.
    once = most.where("parts > 1").groupBy("n", "_x", "_y").agg(F.min(F.struct(group, "largest")).alias("_one"))
    groups = once.select("n", "_one.*").select(
        group, F.col("largest.component").alias("largest"),
        F.ceil(F.col("n") / BLOCK).cast("int").alias("homes"), F.ceil((F.col("n") - F.col("largest.n")) / BLOCK).cast("int").alias("visits"),
    )
    rows = members.join(groups, group)
    home, visit = F.pmod(F.xxhash64("node"), F.col("homes")).cast("int"), F.pmod(F.xxhash64("node", F.lit(7)), F.col("visits")).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    as_host = F.transform(upto("visits"), lambda v: F.struct(home.alias("h"), v.alias("v"), F.lit(True).alias("home")))
    as_visitor = F.transform(upto("homes"), lambda h: F.struct(h.alias("h"), visit.alias("v"), F.lit(False).alias("home")))
    places = F.when(F.col("component") == F.col("largest"), as_host).otherwise(F.concat(as_host, as_visitor))
    return rows.select(group, "node", "component", F.explode(places).alias("_at")).select(group, "node", "component", "_at.*")


def _ties(frame: pd.DataFrame, alike) -> pd.DataFrame:
    """One tie per row at most, between what ``alike(visitor, hosts)`` finds across components."""
    node, component, home = (frame[c].to_numpy() for c in ("node", "component", "home"))
    hosts, label = np.flatnonzero(home), np.arange(len(frame))
    visitors, found = np.flatnonzero(~home), []
    for k in visitors:
        near = hosts[alike(k, hosts)]
        found.append(near[component[near] != component[k]])
    # Once for the meeting: its pairs are no more than its two blocks allow.
    join_labels(label, np.repeat(visitors, [len(near) for near in found]), np.concatenate([hosts[:0], *found]))
    return _label_ties(node, label)


def _label_ties(node: np.ndarray, label: np.ndarray) -> pd.DataFrame:
    """A tie ``a, b`` from each row to the first of its group, where they are two nodes."""
    tied = np.flatnonzero(node != node[label])
    a, b = node[tied], node[label[tied]]
    return pd.DataFrame({"a": np.maximum(a, b), "b": np.minimum(a, b)})


def _whole_groups(frames: Iterator[pd.DataFrame], names: list[str]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Sorted rows cut where a group of ``names`` ends, with the number of each row's group."""
    held: list[pd.DataFrame] = []
    for frame in frames:
        if not len(frame):
            continue
        rows = pd.concat([*held, frame], ignore_index=True)
        begins = np.concatenate([[0], np.any([rows[c].to_numpy()[1:] != rows[c].to_numpy()[:-1] for c in names], axis=0)])
        cut = int(np.flatnonzero(begins)[-1]) if begins.any() else 0
        if cut:
            yield rows.iloc[:cut], np.cumsum(begins[:cut])
        held = [rows.iloc[cut:]]
    for rows in held:
        yield rows, np.zeros(len(rows), np.int64)


def _alike_pairs(group: np.ndarray, home: np.ndarray, component: np.ndarray, signature: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Visitors and hosts of one group and different components whose signatures agree in ``least`` places."""
    rank = np.lexsort([~home, group])  # hosts first in each group
    first = np.searchsorted(group[rank], group)
    hosts = np.bincount(group, weights=home, minlength=group.max() + 1).astype(np.int64)[group]
    visitors = np.flatnonzero(~home)
    ends, found = np.cumsum(hosts[visitors]), [(visitors[:0], visitors[:0])]
    for some in np.split(visitors, np.flatnonzero(np.diff(ends // PAIRS)) + 1):
        n = hosts[some]
        i = np.repeat(some, n)
        j = rank[np.repeat(first[some] - np.cumsum(n) + n, n) + np.arange(n.sum())]
        apart = component[i] != component[j]
        i, j = i[apart], j[apart]
        near = (signature[i] == signature[j]).sum(axis=1) >= least
        found.append((i[near], j[near]))
    return np.concatenate([i for i, _ in found]), np.concatenate([j for _, j in found])


def tied_components(members: DataFrame, signatures: DataFrame, least: int) -> DataFrame:
    """Ties ``a, b`` across components among ``members`` (``key, node, component``) by signature; step 4.

    Most meetings are of a few rows, so a task takes as many at once as a batch holds. Their number of
    partitions is the session's: adaptive execution would deal by bytes what costs by pairs.
    """

    def compare(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows, group in _whole_groups(frames, ["key", "h", "v"]):
            signature = np.frombuffer(b"".join(rows["signature"]), np.uint8).reshape(len(rows), -1)
            node, label = rows["node"].to_numpy(), np.arange(len(rows))
            join_labels(label, *_alike_pairs(group, rows["home"].to_numpy(bool), rows["component"].to_numpy(), signature, least))
            yield _label_ties(node, label)

    met = _meetings(members, "key").join(signatures, "node")
    parts = int(members.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = met.repartition(parts, "key", "h", "v").sortWithinPartitions("key", "h", "v")
    return dealt.mapInPandas(compare, "a long, b long").distinct()


def linked_across(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links ``a, b`` across components among ``members`` (``cluster, node, component``) on full sets; step 5.

    Of the links in a meeting as many are returned as connect what they connect.
    """

    def compare(_: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        home, size = frame["home"].to_numpy(), frame["shingles"].str.len().to_numpy()
        hosts = np.flatnonzero(home)
        owner = np.repeat(np.arange(len(hosts)), size[hosts])
        values = np.concatenate([np.zeros(0, np.int64), *frame["shingles"].to_numpy()[hosts]])
        rank = np.argsort(values, kind="stable")
        values, owner = values[rank], owner[rank]

        def alike(k: int, hosts: np.ndarray) -> np.ndarray:
            own = np.asarray(frame["shingles"].iat[k])
            first, end = np.searchsorted(values, own), np.searchsorted(values, own, side="right")
            found = np.repeat(first - np.concatenate([[0], np.cumsum(end - first)[:-1]]), end - first) + np.arange((end - first).sum())
            shared = np.bincount(owner[found], minlength=len(hosts))
            return 100 * shared >= percent * (size[hosts] + size[k] - shared)

        return _ties(frame, alike)

    met = _meetings(members, "cluster").join(sets, "node")
    return met.groupBy("cluster", "h", "v").applyInPandas(compare, "a long, b long").distinct()


def _links_in_clusters(links: DataFrame, ties: DataFrame, first: DataFrame, docs: DataFrame, words: int, percent: int, id: str, text: str) -> DataFrame:
    """Step 5: ``ties`` join the components ``first`` of ``links`` to clusters."""
    clusters = components(links.union(ties), "clusters").withColumnRenamed("component", "cluster")
    apart = clusters.join(first, "node", "left").select("cluster", "node", F.coalesce("component", "node").alias("component"))
    open_ = apart.groupBy("cluster").agg(F.min("component").alias("_p"), F.max("component").alias("_q")).where("_p <> _q").select("cluster")
    apart = keep(apart.join(open_, "cluster"), "open-clusters")
    return linked_across(apart, shingle_sets(apart, docs, words, id, text), percent)


def near_duplicates(
    docs: DataFrame, words: int = 5, percent: int = 80, bands: int = 36, rows: int = 5, id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, n_shingles, component_id, kept``.

    Words are what lies between blanks, tabs and line ends, with A-Z in lower case. Documents are linked
    when ``100 * shared >= percent * united`` shingles of ``words`` words; a text of fewer words is one
    shingle. ``component_id`` is the smallest id that links reach. The default bands miss a pair at the
    threshold with a probability below one in a million, and more similar ones less. A text that is null
    or without a word has no shingle and no link. Rows of one id are one node with several texts. Rows
    with a null id are linked with nothing: their component is null and they are kept. Repeated rows stay;
    other columns are not read; an empty table gives no rows.
    """
    count = bands * rows
    least = least_agreement(count, percent / 100)
    signed = keep(sign(docs, words, bands, rows, id, text), "signed")
    members = signed.where("doc_id IS NOT NULL AND set_id IS NOT NULL").groupBy("set_id").agg(F.min("doc_id").alias("rep"))
    # A representative's row is the one of its set with the smallest id; repeated rows leave one.
    chosen = signed.join(members, "set_id").where("doc_id = rep").select("doc_id", "keys", "signature", "set_id").dropDuplicates(["doc_id", "set_id"])
    chosen = keep(chosen.select(F.col("doc_id").alias("node"), "keys", "signature"), "representatives")
    keyed = chosen.select("node", F.explode("keys").alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("node").alias("hub"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    shared = keep(keyed.join(hubs, "key"), "buckets")
    signatures = chosen.select("node", "signature")
    star = shared.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    signed_pairs = star.join(signatures.select(F.col("node").alias("a"), F.col("signature").alias("sa")), "a").join(
        signatures.select(F.col("node").alias("b"), F.col("signature").alias("sb")), "b"
    )
    pairs = keep(_agreeing(signed_pairs, least), "pairs")
    links = keep(linked(pairs, docs, words, percent, id, text), "links")
    first = components(links, "first")
    component: Column = F.coalesce("component", "node").alias("component")
    placed = shared.join(first, "node", "left").select("key", "node", component)
    ties = keep(tied_components(placed, signatures, least), "ties")
    all_links = links.union(_links_in_clusters(links, ties, first, docs, words, percent, id, text)) if not ties.isEmpty() else links
    # Rows of a set without an own signature follow their representative.
    follows = signed.join(members, "set_id").where("doc_id <> rep").select(F.col("doc_id").alias("a"), F.col("rep").alias("b"))
    final = components(all_links.union(follows), "final")
    out = signed.select("doc_id", "n_shingles").join(final, F.col("doc_id") == F.col("node"), "left")
    component = F.coalesce("component", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_copies(docs: DataFrame, id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``docs`` with one document of each group, that of the smallest id."""
    dropped = near_duplicates(docs, id=id, text=text, **settings).where("NOT kept").select(F.col("doc_id").alias("_dropped")).distinct()
    # By the column, not its name: ``docs`` may have one of that name too.
    return docs.join(dropped, docs[id].cast("long") == dropped["_dropped"], "left_anti")
