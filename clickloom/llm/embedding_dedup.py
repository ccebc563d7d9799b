"""Near-duplicate embeddings by PCA-ordered tiled comparison.

Vectors are brought to length one and rotated to the principal axes of all of them, which keeps every
cosine and gathers most of it in the leading coordinates. Blocks of vectors are compared as tiles: the
product of the leading coordinates first; what the rest can add is at most the product of the two suffix
norms, and a pair whose sum cannot reach the threshold is dropped, a tile as soon as no pair is left. What
remains gets its cosine in double precision from the vectors as given.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import keep
from clickloom.llm.components import components, join_labels

#: Vectors in a block, and the tile's side inside a task.
BLOCK, TILE = 4096, 1024
#: Coordinates added by each step.
STEP = 16
#: More than the rounding of single-precision products of unit vectors.
MARGIN = 1e-4


def _valid(vectors: pd.Series) -> np.ndarray:
    """Which vectors take part: not null, without null or non-finite components, not zero."""

    def good(v) -> bool:
        if v is None or not len(v):
            return False
        x = np.asarray(v, float)
        return bool(np.isfinite(x).all() and x.any())

    return np.fromiter(map(good, vectors), bool, len(vectors))


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one; scaled first, so that no square overflows or vanishes."""
    scaled = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    return scaled / np.sqrt((scaled * scaled).sum(axis=1, keepdims=True))


def principal_axes(vectors: DataFrame, dims: int) -> np.ndarray:
    """Axes of the second moments of all unit vectors with ``dims`` components, the largest first."""

    def moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((dims, dims))
        for frame in frames:
            x = _unit(np.stack(list(frame["vector"])).astype(float))
            total += x.T @ x
        row, column = np.triu_indices(dims)
        yield pd.DataFrame({"i": row, "j": column, "s": total[row, column]})

    sums = vectors.where(F.size("vector") == dims).mapInPandas(moments, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas()
    matrix = np.zeros((dims, dims))
    matrix[sums["i"], sums["j"]] = matrix[sums["j"], sums["i"]] = sums["s"]
    return np.linalg.eigh(matrix)[1][:, ::-1]


def close_pairs(a: np.ndarray, b: np.ndarray, rotated_a: np.ndarray, rotated_b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of a tile whose cosine, in double precision, reaches ``least``."""
    dims = rotated_a.shape[1]
    rows, columns = np.arange(len(a)), np.arange(len(b))
    done = np.zeros((len(a), len(b)), np.float32)
    for at in range(0, dims, STEP):
        end = min(dims, at + STEP)
        done += rotated_a[rows, at:end] @ rotated_b[columns, at:end].T
        rest_a = np.sqrt((rotated_a[rows, end:] ** 2).sum(axis=1))
        rest_b = np.sqrt((rotated_b[columns, end:] ** 2).sum(axis=1))
        # One bound for a row against its tile first: cheaper than the bound of each pair.
        live = done.max(axis=1, initial=-2) + rest_a * rest_b.max(initial=0) >= least - MARGIN
        rows, done, rest_a = rows[live], done[live], rest_a[live]
        if not len(rows):
            return rows, rows
        open_ = done + rest_a[:, None] * rest_b[None, :] >= least - MARGIN
        some_rows, some_columns = open_.any(axis=1), open_.any(axis=0)
        if open_.sum() <= 4 * (len(rows) + len(columns)) or end == dims:
            i, j = np.nonzero(open_)
            i, j = rows[i], columns[j]
            break
        rows, columns, done = rows[some_rows], columns[some_columns], done[np.ix_(some_rows, some_columns)]
        if not len(rows):
            return rows, rows
    hit = np.zeros(len(i), bool)
    for at in range(0, len(i), 65_536):
        part = slice(at, at + 65_536)
        hit[part] = np.einsum("ij,ij->i", a[i[part]], b[j[part]]) >= least
    return i[hit], j[hit]


def _compare(least: float, axes: np.ndarray):
    def run(frame: pd.DataFrame) -> pd.DataFrame:
        """Links in a pair of blocks: ``node, links, other``; rows for a node's count, and rows that tie a
        node to the first member of its group, so that the output stays within the blocks' size."""
        same = bool(frame["diagonal"].iloc[0])
        side = frame["left"].to_numpy()
        node, copies = frame["node"].to_numpy(), frame["copies"].to_numpy()
        x = _unit(np.stack(list(frame["vector"])).astype(float))
        y = (x @ axes).astype(np.float32)
        left = np.arange(len(x)) if same else np.flatnonzero(side)
        right = left if same else np.flatnonzero(~side)
        count, label = np.zeros(len(x), np.int64), np.arange(len(x))
        for p in range(0, len(left), TILE):
            for q in range(p if same else 0, len(right), TILE):
                l, r = left[p : p + TILE], right[q : q + TILE]
                i, j = close_pairs(x[l], x[r], y[l], y[r], least)
                i, j = l[i], r[j]
                if same and p == q:
                    once = i < j
                    i, j = i[once], j[once]
                np.add.at(count, i, copies[j])
                np.add.at(count, j, copies[i])
                join_labels(label, i, j)
        some, joined = np.flatnonzero(count), np.flatnonzero(label != np.arange(len(x)))
        return pd.DataFrame(
            {
                "node": np.concatenate([node[some], node[joined]]),
                "links": np.concatenate([count[some], np.zeros(len(joined), np.int64)]),
                "other": pd.array([None] * len(some) + list(node[label[joined]]), "Int64"),
            }
        )

    return run


def near_vectors(vectors: DataFrame, least: float = 0.9, id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per row of ``vectors``: ``vec_id, n_links, component_id, kept``.

    Vectors are linked when their cosine is ``least`` or more; it must be positive. Equal vectors collapse
    to the smallest id first and count as linked with each other. ``component_id`` is the smallest id that
    links reach. Vectors that are null, empty, zero or hold a null or non-finite component link with
    nothing, nor do vectors of different lengths. Rows with a null id count as others' links and carry links
    on, but are never the smallest; they have a null component and stay. Rows that repeat an id are vectors of
    their own, each with its own links and component. Other columns are not read; an empty table gives no rows.
    """
    if not 0 < least <= 1:
        raise ValueError("The least cosine must be positive and at most 1")
    spark = vectors.sparkSession

    def check(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            good = _valid(frame["vector"])
            frame["vector"] = [v if ok else None for v, ok in zip(frame["vector"], good, strict=True)]
            yield frame.astype({"vec_id": "Int64"})

    rows = vectors.select(vectors[id].cast("long").alias("vec_id"), vectors[vector].cast("array<double>").alias("vector"))
    checked = keep(rows.mapInPandas(check, "vec_id long, vector array<double>").select(
        "*", F.xxhash64("vector").alias("copy_of"), F.monotonically_increasing_id().alias("row")
    ), "vectors")
    # Equal vectors meet by value: a group is one row, however many copies it counts, under its first row's number.
    groups = keep(checked.where("vector IS NOT NULL").groupBy("copy_of", "vector").agg(
        F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.min("row").alias("node")
    ), "distinct-vectors")
    found = []
    for dims in [r[0] for r in groups.select(F.size("vector")).distinct().collect()]:
        own = groups.where(F.size("vector") == dims)
        axes = principal_axes(own, dims)
        blocks = int(own.count() // BLOCK + 1)
        dealt = own.select("node", "copies", "vector", F.pmod(F.xxhash64("copy_of", "node"), F.lit(blocks)).cast("int").alias("block"))
        other = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))
        met = dealt.withColumn("other", other).select(
            F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"),
            (F.col("block") <= F.col("other")).alias("left"), (F.col("block") == F.col("other")).alias("diagonal"),
            "node", "copies", "vector",
        )
        found.append(met.groupBy("p", "q").applyInPandas(_compare(least, axes), "node long, links long, other long"))
    links = spark.createDataFrame([], "node long, links long, other long")
    for part in found:
        links = links.union(part)
    links = keep(links, "vector-links")
    counts = links.groupBy("node").agg(F.sum("links").alias("links"))
    parts = components(links.where("other IS NOT NULL").select(F.col("node").alias("a"), F.col("other").alias("b")), "vector-components")
    placed = groups.join(counts, "node", "left").join(parts, "node", "left").withColumn("part", F.coalesce("component", "node"))
    # The smallest id of a part, null ids aside. Keyed by a value of its own, so that a part with a third of all
    # groups is split by the join.
    ids = placed.groupBy("part").agg(F.min("least_id").alias("first_id"), F.min("part").alias("_part")).drop("part")
    of_group = placed.join(ids, F.col("part") == F.col("_part")).select(
        "copy_of", "vector", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.col("first_id").alias("component")
    )
    out = checked.join(of_group, ["copy_of", "vector"], "left")
    component = F.when(F.col("vec_id").isNotNull(), F.coalesce("component", "vec_id"))
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept")
    )
