"""Connected components of a graph that no single machine holds."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def forest(left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges to (node, smallest node of its component) for all nodes but those smallest: as many edges as a forest has."""
    nodes, place = np.unique(np.concatenate([left, right]), return_inverse=True)
    a, b = place[: len(left)], place[len(left) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        while not np.array_equal(new, jumped := new[new]):
            new = jumped
        if np.array_equal(new, label):
            break
        label = new
    child = label != np.arange(len(nodes))
    return nodes[child], nodes[label[child]]


class Forest:
    """Edges as they come, folded into a forest whenever many have gathered, so that memory follows the nodes."""

    def __init__(self, limit: int = 1 << 20):
        self.limit, self.left, self.right, self.held, self.after = limit, [], [], 0, limit

    def add(self, left: np.ndarray, right: np.ndarray) -> None:
        if len(left):
            self.left.append(left)
            self.right.append(right)
            self.held += len(left)
            if self.held > self.after:
                self.fold()
                self.after = self.held + self.limit

    def fold(self) -> tuple[np.ndarray, np.ndarray]:
        if not self.left:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = forest(np.concatenate(self.left), np.concatenate(self.right))
        self.left, self.right, self.held = [a], [b], len(a)
        return a, b


def components(edges: DataFrame, scratch: common.Scratch, name: str = "edges") -> DataFrame:
    """(u, v) links to (node, root): root is the smallest node reachable, for every node of a link but the roots.

    Large-star and small-star rounds (Kiveris et al., 2014) until nothing changes. Minima are combined before they
    are shuffled, and a hub only meets its one minimum in a join, whose skewed side Spark splits. Every round is
    written to the shared folder.
    """
    pairs = edges.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now, seen, i = scratch.save(pairs, f"{name}0"), None, 0
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = scratch.apart(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{name}-low")
        large = scratch.save(both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), f"{name}-large")
        low = scratch.apart(large.groupBy("u").agg(F.min("v").alias("m")), f"{name}-least")
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        small = small.select("e.u", "e.v").filter("u <> v").distinct()
        i += 1
        new = scratch.save(small, f"{name}{i}")
        state = new.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        scratch.drop(f"{name}{i - 1}")
        if state == seen or not state[0]:
            return new.select(F.col("u").alias("node"), F.col("v").alias("root"))
        now, seen = new, state
