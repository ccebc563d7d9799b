"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clickloom.llm.common import discard, keep


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node goes to the smallest of the node and its neighbours."""
    both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
    return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")


def _small_star(edges: DataFrame) -> DataFrame:
    """A node and its smaller neighbours go to the smallest of these. Edges run from larger to smaller."""
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    joined = edges.join(least, "a")
    return joined.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").union(least.select("a", F.col("m").alias("b")))


def _mark(edges: DataFrame) -> tuple:
    """Number of edges and a sum of their hashes: changes whenever a round changes something."""
    return tuple(edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """``node, component`` for each node of an edge: the smallest node that it reaches.

    ``edges`` are the pairs ``a, b`` of comparable nodes; loops, repeats and null ends say nothing. A
    round is one large-star and one small-star; each round is kept as a table, and rounds end when one
    changes nothing, after about the logarithm of the longest chain. A hub's edges are joined to its one
    minimum, which adaptive execution splits; nothing is gathered by node.
    """
    spark = edges.sparkSession
    clean = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a IS NOT NULL AND a <> b")
    now = keep(clean.distinct(), name)
    mark = _mark(now)
    while mark[0]:
        after = keep(_small_star(_large_star(now).distinct()).distinct(), name)
        seen = _mark(after)
        discard(spark, now)
        now = after
        if seen == mark:
            break
        mark = seen
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())


def join_labels(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the groups of the pairs ``i, j``; ``label`` holds the first member of each one's group."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while (label[label] != label).any():
            label[:] = label[label]
