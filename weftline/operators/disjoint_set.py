"""Union-find within a task, with undo.

Three ways to shorten paths while finding (full compression, halving,
splitting); all give the same sets.  With ``undo`` every write is logged, path
shortening included, so a restored state is exactly the saved one.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import cut
from .components import components
from .graph import dense_ids

PART = 100_000  # arcs of one graph that a task takes at once


class DisjointSet:
    def __init__(self, n: int, find_mode: str = "halving", undo: bool = False):
        if find_mode not in ("compression", "halving", "splitting"):
            raise ValueError(f"unknown find mode {find_mode}")
        self.parent, self.rank = list(range(n)), [0] * n
        self.components, self.mode = n, find_mode
        self.log: list | None = [] if undo else None

    def _write(self, array: list, i: int, value: int) -> None:
        if self.log is not None:
            self.log.append((array, i, array[i]))
        array[i] = value

    def find(self, i: int) -> int:
        parent = self.parent
        if self.mode == "compression":
            root = i
            while parent[root] != root:
                root = parent[root]
            while parent[i] != root:
                i, up = parent[i], i
                self._write(parent, up, root)
            return root
        while parent[i] != i:
            up = parent[parent[i]]
            if up != parent[i]:
                self._write(parent, i, up)
            i = up if self.mode == "halving" else parent[i]
        return i

    def union(self, a: int, b: int) -> bool:
        """Join two sets; False if they were one already."""
        a, b = self.find(a), self.find(b)
        if a == b:
            return False
        if self.rank[a] < self.rank[b]:
            a, b = b, a
        self._write(self.parent, b, a)
        if self.rank[a] == self.rank[b]:
            self._write(self.rank, a, self.rank[a] + 1)
        self.components -= 1
        return True

    def are_connected(self, a: int, b: int) -> bool:
        return self.find(a) == self.find(b)

    def save(self) -> tuple[int, int]:
        if self.log is None:
            raise ValueError("made without undo")
        return len(self.log), self.components

    def restore(self, state: tuple[int, int]) -> None:
        at, self.components = state
        while len(self.log) > at:
            array, i, old = self.log.pop()
            array[i] = old

    def copy(self) -> DisjointSet:
        twin = DisjointSet(0, self.mode)
        twin.parent, twin.rank, twin.components = self.parent[:], self.rank[:], self.components
        return twin

    def labels(self) -> list[int]:
        return [self.find(i) for i in range(len(self.parent))]

    def __repr__(self) -> str:
        return f"DisjointSet(parents={self.parent}, ranks={self.rank}, components={self.components})"


def grouped_labels(edges: DataFrame, find_mode: str = "halving", undo: bool = False, limit: int = PART) -> DataFrame:
    """``edges`` (grp, u, v), many small graphs -> (grp, id, label): the smallest id
    of each vertex's set, one graph a task.  With ``undo`` all sets are joined in
    between and restored, which leaves the labels as they are.

    A graph of more than ``limit`` arcs is dealt out: each task joins the sets of
    about ``limit`` of its arcs and gives one pair (id, label) a vertex, and the pairs
    of all its tasks are joined as components.  Arcs with a null end or group are
    left out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        names, ends = np.unique(pdf[["u", "v"]].to_numpy(), return_inverse=True)
        sets = DisjointSet(len(names), find_mode, undo)
        for a, b in ends.reshape(-1, 2).tolist():
            sets.union(a, b)
        if undo:
            state = sets.save()
            for i in range(1, len(names)):
                sets.union(0, i)
            sets.labels()
            sets.restore(state)
        of = np.array(sets.labels())
        least = np.full(len(names), len(names))
        np.minimum.at(least, of, np.arange(len(names)))
        return pd.DataFrame({"grp": pdf["grp"].iloc[0], "id": names, "label": names[least[of]]})

    schema = "grp long, id long, label long"
    edges = edges.select(*(F.col(c).cast("long").alias(c) for c in ("grp", "u", "v"))).dropna()
    large = edges.groupBy("grp").agg(F.ceil(F.count(F.lit(1)) / limit).alias("parts")).filter("parts > 1")
    if large.isEmpty():
        return edges.groupBy("grp").applyInPandas(run, schema)
    large = cut(large, "large")
    whole = edges.join(large, "grp", "left_anti").groupBy("grp").applyInPandas(run, schema)
    dealt = edges.join(large, "grp").distinct().withColumn("part", F.pmod(F.xxhash64("u", "v"), "parts"))
    pairs = cut(dealt.groupBy("grp", "part").applyInPandas(run, schema), "pairs")
    # numbered in the order of (grp, id), so the least number of a component is its least id
    number = cut(dense_ids(pairs.select(F.struct("grp", "id").alias("key")), "key"), "numbers")
    u, v = (number.select(F.col("key.grp").alias("grp"), F.col("key.id").alias(c), F.col("vertex").alias(x)) for c, x in (("id", "u"), ("label", "v")))
    joined = components(pairs.join(u, ["grp", "id"]).join(v, ["grp", "label"]).select("u", "v"))
    least = number.join(joined.toDF("vertex", "component"), "vertex", "left").select("key", F.coalesce("component", "vertex").alias("component"))
    label = number.select(F.col("vertex").alias("component"), F.col("key.id").alias("label"))
    return whole.unionByName(least.join(label, "component").select("key.grp", "key.id", "label"))
