"""Connected components, in one task's memory and as Spark jobs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, functions as F

from plantpulse.llm.common import settled



def local_components(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least member of the component of each of 0 .. n - 1, given edges (a, b)."""
    label = np.arange(n)
    while len(a):
        low = np.minimum(label[a], label[b])
        before = label.copy()
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while True:  # pointers to the end of their chains
            short = label[label]
            if np.array_equal(short, label):
                break
            label = short
        if np.array_equal(before, label):
            return label
        apart = label[a] != label[b]
        a, b = a[apart], b[apart]
    return label


def merged(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after edges (a, b) have joined components; every label is its component's least member."""
    if not len(a):
        return label
    roots, place = np.unique(np.concatenate([label[a], label[b]]), return_inverse=True)
    joined = local_components(len(roots), place[: len(a)], place[len(a) :])
    to = np.arange(len(label))
    to[roots] = roots[joined]
    return to[label]


def components(edges: DataFrame) -> DataFrame:
    """node, label of every node of the edges (a, b) of longs; the label is the component's least node.

    Alternating large and small stars: every node's neighbours are moved to the
    least of them until only stars are left, in a number of rounds that grows with
    the logarithm of the longest path. Minima are aggregated before the shuffle
    and neighbours are joined to them, so a node with very many neighbours is no
    bottleneck. Each round is written to the checkpoint folder. No edges give no rows.
    """
    now = settled(edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = None
    while True:
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == seen or mark[0] == 0:
            break
        seen = mark
        both = now.unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = (
            both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .filter("a <> b").distinct()
        )
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = (
            large.join(least, "a").filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
            .unionByName(least.select("a", F.col("m").alias("b")))
            .distinct()
        )
        now = settled(small)
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return stars.unionByName(stars.select(F.col("label").alias("node"), "label").distinct())
