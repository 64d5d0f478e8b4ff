"""Connected components by alternating large and small stars, as DataFrame jobs."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from growthpanel.llm.shared import Shelf


def spanning_links(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fewer links that connect what the links (a, b) of one comparison connect: one per end but the first."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    if len(a) < len(nodes):
        return a, b
    x, y, top = places[: len(a)], places[len(a) :], np.arange(len(nodes))
    while True:
        new = top.copy()
        np.minimum.at(new, x, top[y])
        np.minimum.at(new, y, top[x])
        new = new[new]
        if (new == top).all():
            break
        top = new
    moved = np.flatnonzero(top != np.arange(len(nodes)))
    return nodes[moved], nodes[top[moved]]


def _large_star(edges: DataFrame) -> DataFrame:
    """Every larger neighbour of a node is linked to the smallest node beside it."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    """Every smaller neighbour of a node, and the node, are linked to the smallest of them. Rows have u > v."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    moved = edges.join(least, "u").where("v > m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def connected_components(edges: DataFrame, shelf: Shelf) -> DataFrame:
    """(node, root) for every node in ``edges`` (a, b: long) but the roots; root is the smallest node of a component.

    Loops, repeated and null ends do no harm; no edges give no rows. Every round is written to the shared folder and
    its predecessor deleted, so neither plan nor disk grow with the rounds. A hub's minimum is aggregated before the
    shuffle, and its rows meet that minimum in a plain join, which adaptive execution splits; nothing is collected but
    two numbers per round.
    """
    clean = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = shelf.keep(clean, "edges"), None
    while (mark := tuple(now.agg(F.count("u"), F.bit_xor(F.xxhash64("u", "v"))).first())) != before and mark[0]:
        after = shelf.keep(_small_star(_large_star(now)), "edges")
        shelf.forget(now)
        now, before = after, mark
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
