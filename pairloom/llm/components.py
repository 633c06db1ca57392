"""Connected components by repeated contraction, as Spark joins over staged edge tables."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pairloom.llm.common import staged


def local_roots(n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """For nodes 0..n-1 and links ``left[i] - right[i]``: the smallest node each can reach."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[left], root[right])
        after = root.copy()
        np.minimum.at(after, left, low)
        np.minimum.at(after, right, low)
        np.minimum.at(after, root[left], low)
        np.minimum.at(after, root[right], low)
        after = after[after]
        if np.array_equal(after, root):
            return root
        root = after


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(a, b)`` links between longs to ``(node, root)``, one row per node that has a link.

    In each round every node moves to the neighbour (or itself) of lowest hashed rank, and the
    links are rewritten to the new names; equal links fold. Hashed ranks make long chains
    shrink by a constant share per round, so the number of rounds is logarithmic. A node's
    choice is a partial aggregate, and the rewriting joins can be split where a node is hot.
    Every round is a staged table, so a lost executor costs one round at most. No links: no
    rows; links from a node to itself and null ends are ignored.
    """
    links = staged(edges.select("a", "b").where("a != b").distinct(), "links")
    steps: list[DataFrame] = []
    for _ in range(rounds):
        if links.isEmpty():
            break
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        rank = lambda c: F.struct(F.xxhash64(F.col(c), F.lit(len(steps))).alias("h"), F.col(c).alias("v"))
        step = staged(
            both.groupBy("a")
            .agg(F.min(rank("b")).alias("low"))
            .select(F.col("a").alias("node"), F.least(rank("a"), F.col("low")).getField("v").alias("to")),
            "step",
        )
        steps.append(step)
        moved_a = links.join(step.select(F.col("node").alias("a"), F.col("to").alias("ta")), "a").select("ta", "b")
        moved = moved_a.join(step.select(F.col("node").alias("b"), F.col("to").alias("tb")), "b")
        links = staged(
            moved.select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).where("a != b").distinct(),
            "links",
        )
    else:
        if not links.isEmpty():
            raise RuntimeError(f"links remain after {rounds} rounds")
    if not steps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    roots = steps[-1].select("node", F.col("to").alias("root"))
    for step in reversed(steps[:-1]):
        later = roots.select(F.col("node").alias("to"), "root")
        roots = step.join(later, "to", "left").select("node", F.coalesce("root", "to").alias("root"))
    return staged(roots, "roots")
