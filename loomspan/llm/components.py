"""Connected components by alternating stars, with every round written to the shared folder."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.llm._common import column, stored

#: Links (16 MB) that one task joins by itself; more are joined by rounds over all tasks.
MOST_ALONE = 1 << 20


def _least(pairs: DataFrame) -> DataFrame:
    return pairs.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))


def joined(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of links and the least node that each reaches: roots are hooked to the least root beside them, until none moves."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    left, right = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[left], root[right]
        least = np.minimum(x, y)
        if (x == y).all():
            return nodes, nodes[root]
        np.minimum.at(root, x, least)
        np.minimum.at(root, y, least)
        while (root[root] != root).any():
            root = root[root]


def _alone(links: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(column(b, "a").to_numpy(), column(b, "b").to_numpy()) for b in batches]
        if held:
            found = joined(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in found], ["node", "component"])

    return links.select("a", "b").coalesce(1).mapInArrow(run, "node long, component long")


def components(links: DataFrame) -> DataFrame:
    """(node, component) for the ends of stored links (a, b); component is the least node reached.

    Up to MOST_ALONE links are joined in one task. More go by rounds: a round joins every node's larger
    neighbours to its least neighbour, then every node and its smaller neighbours to their least. Links
    only come closer to their least node, so the rounds grow with the logarithm of a chain's length. A
    node with very many neighbours is a key with many rows on one side of a join only, which adaptive
    execution splits.
    """
    links = links.where("a <> b")
    if links.count() <= MOST_ALONE:
        return _alone(links)
    edges = stored(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(_least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = stored(large)
        least = _least(large)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
        edges = stored(small.where("u <> v").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == state:
            break
        state = now
    found = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
