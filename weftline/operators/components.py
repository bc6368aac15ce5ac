"""Connected components of an edge table, all in DataFrames.

Alternating stars: every vertex hooks its larger neighbours (then its smaller
ones and itself) to the smallest vertex it sees, until only stars are left; the
number of rounds follows the logarithm of the size.  Minima are pre-aggregated
in each task, so a vertex of any degree is safe.  Before the first round every task
makes stars of the edges it reads, a bounded number at a time, so what lies
together there (a customer's orders) takes no round and dense tables move a forest
only.  Joins are kept from broadcasts: compressed tables look small, and
rows would pass through the driver every round.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import cut, drop
from . import small
from .graph import Graph


#: Edges that a task joins at a time before the first round.
LOCAL = 1 << 20


def least_ends(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all ends in order, and the least id that each is joined to."""
    names, ends = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = ends[: len(u)], ends[len(u) :]
    label = np.arange(len(names))
    while len(a):  # roots hook to smaller ones, then all go to their root
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not ((up := label[label]) == label).all():
            label = up
        a, b = label[a], label[b]
        a, b = a[a != b], b[a != b]
    return names, names[label]


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges (u, v) as stars around the least vertex, ``LOCAL`` edges at a time."""

    def stars(held):
        names, least = least_ends(*(np.concatenate([b.column(i).to_numpy() for b in held]) for i in (0, 1)))
        far = names != least
        return pa.RecordBatch.from_arrays([pa.array(names[far]), pa.array(least[far])], ["u", "v"])

    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += len(batch)
        if rows >= LOCAL:
            yield stars(held)
            held, rows = [], 0
    if rows:
        yield stars(held)


def _star(edges: DataFrame, both: bool) -> DataFrame:
    """``edges`` (u, v), u > v.  Large star (``both``): larger neighbours of u go
    to the least of u and its neighbours.  Small star: the smaller ones and u."""
    seen = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if both else edges
    least = seen.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
    near = seen.join(least.hint("merge"), "u")
    if both:
        out = near.filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = near.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))
    return out.filter("u <> v").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether ``edges`` (u, v), u > v, are stars around their least vertices: no u
    has two edges or is the v of another."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("out")).unionByName(edges.select(F.col("v").alias("x"), F.lit(0).alias("out")))
    seen = ends.groupBy("x").agg(F.sum("out").alias("outs"), F.min("out").alias("least"))
    return not seen.filter("outs > 1 or outs > least").agg(F.count(F.lit(1))).first()[0]


def stars(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """``edges`` (u long, v long) in any order -> (id, component), stored, for every
    vertex that reaches a smaller one; component is the smallest.  Edges with a
    null end are left out.  Fails if ``most_rounds`` do not settle it."""
    ends = edges.filter("u <> v").select("u", "v").mapInArrow(_contracted, "u long, v long")
    e = cut(ends.distinct(), "cc")
    for _ in range(most_rounds):
        if _stars(e):
            return _renamed(e)
        big = cut(_star(e, True), "cc")
        drop(e)
        e = cut(_star(big, False), "cc")
        drop(big)
    raise RuntimeError("components did not settle")


def _renamed(e: DataFrame) -> DataFrame:
    out = e.select(F.col("u").alias("id"), F.col("v").alias("component"))
    out.path = e.path
    return out


def components(edges: DataFrame, most_rounds: int = 40) -> DataFrame:
    """:func:`stars` and the smallest vertices themselves: a row for every vertex that
    has an edge to another."""
    found = stars(edges, most_rounds)
    return found.unionByName(found.select(F.col("component").alias("id"), "component").distinct())


def connected_components(g: Graph) -> DataFrame:
    """(vertex, component) for all vertices of g; arcs count both ways."""
    if 0 < g.n <= small.SMALL:
        return small.with_matrix(g.inside(), g.n, lambda m: (np.arange(len(m)), _least_reachable(m | m.T)), "vertex long, component long")
    found = stars(g.inside().select(F.col("src").alias("u"), F.col("dst").alias("v")))
    return g.vertices.join(found.withColumnRenamed("id", "vertex").hint("merge"), "vertex", "left").select("vertex", F.coalesce("component", "vertex").alias("component"))


def _least_reachable(matrix: np.ndarray) -> np.ndarray:
    src, dst = np.nonzero(matrix)
    label = np.arange(len(matrix))
    while True:
        new = label.copy()
        np.minimum.at(new, src, label[dst])
        new = new[new]
        if (new == label).all():
            return label
        label = new


def are_connected(labels: DataFrame, pairs: DataFrame) -> DataFrame:
    """``pairs`` (a, b) with ``connected``, by the labels of both ends."""
    left, right = (labels.select(F.col("vertex").alias(x), F.col("component").alias(f"c{x}")) for x in "ab")
    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", (F.col("ca") == F.col("cb")).alias("connected"))


def component_count(labels: DataFrame) -> DataFrame:
    return labels.agg(F.count_distinct("component").alias("components"))
