"""Clustering coefficients over out-arcs.

For an eligible vertex j (``min_degree`` distinct out-neighbours or more, two at
least) the coefficient is the share of ordered pairs of different out-neighbours
(u, w) with an arc u -> w.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import jenkins64
from ..plans.storage import cut
from .graph import Graph


#: Arcs of a cell on average: a task holds up to four cells.
CELL = 1 << 18
#: Pairs that a task looks up at a time.
LOOKED_UP = 1 << 22


def _closed(table: pa.Table) -> pa.Table:
    """Arcs (src, dst, near) of a cube -> (j, closed): how many ordered pairs of the ends of j's
    arcs that are near are joined by arcs that are not."""
    src, dst, near = (table.column(x).to_numpy() for x in ("src", "dst", "near"))
    names, ends = np.unique(np.concatenate([src[near], dst[near]]), return_inverse=True)
    n = len(names)
    j, x = ends[: near.sum()], ends[near.sum() :]
    order = np.lexsort((j, x))
    j, x = j[order], x[order]
    begin = np.searchsorted(x, np.arange(n + 1))
    count, places = np.diff(begin), x * n + j
    u, v = src[~near], dst[~near]
    at_u, at_v = (np.minimum(np.searchsorted(names, e), max(n - 1, 0)) for e in (u, v))
    both = (names[at_u] == u) & (names[at_v] == v) if n else np.zeros(len(u), bool)
    u, v = at_u[both], at_v[both]
    few = count[u] <= count[v]
    u, v = np.where(few, u, v), np.where(few, v, u)
    order = np.argsort(v, kind="stable")  # look-ups that lie together
    u, v = u[order], v[order]
    many, closed = count[u], np.zeros(n, np.int64)
    ends = np.cumsum(many)
    start = 0
    while start < len(u):
        past = max(start + 1, int(np.searchsorted(ends, (ends[start - 1] if start else 0) + LOOKED_UP, side="right")))
        m = many[start:past]
        own = j[np.repeat(begin[u[start:past]] - (np.cumsum(m) - m), m) + np.arange(m.sum())]
        key = np.repeat(v[start:past], m) * n + own
        at = np.minimum(np.searchsorted(places, key), len(places) - 1)
        closed += np.bincount(own[places[at] == key], minlength=n)
        start = past
    some = closed > 0
    return pa.table([pa.array(names[some]), pa.array(closed[some])], ["j", "closed"])


def _closed_pairs(near: DataFrame, arcs: DataFrame, parts: int) -> DataFrame:
    """(j, closed): ordered pairs of out-neighbours of j, by ``near`` (src, dst), that an arc of
    ``arcs`` joins.  Vertices are hashed to ``parts``, arcs lie in cells by both ends.  A cube
    (part of j, two parts of neighbours) holds the four cells that its pairs need, so an
    arc goes to ``parts`` cubes in each of its roles and a pair is no row."""
    part = lambda x: F.pmod(F.xxhash64(x), F.lit(parts))
    other = F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("y")
    rows = near.select("src", "dst", F.lit(True).alias("near"), part("src").alias("a"), part("dst").alias("x"), other)
    rows = rows.unionByName(arcs.select("src", "dst", F.lit(False).alias("near"), part("src").alias("x"), part("dst").alias("y"), other.alias("a")))
    cube = (F.col("a") * parts + F.least("x", "y")) * parts + F.greatest("x", "y")
    found = rows.select(cube.alias("cube"), "src", "dst", "near").groupBy("cube").applyInArrow(_closed, "j long, closed long")
    return found.groupBy("j").agg(F.sum("closed").alias("closed"))


def local_clustering(g: Graph, min_degree: int = 3) -> DataFrame:
    """(vertex, degree, closed, coefficient) of eligible vertices.

    An arc u -> w closes a pair of every j with arcs to both.  Arcs are dealt to cubes
    (:func:`_closed_pairs`) and such j looked for in a task, among those of that end which has
    fewer: what moves is the arcs, times the square root of their number by ``CELL``."""
    simple = cut(g.simple(), "simple")
    degree = simple.groupBy("src").agg(F.count(F.lit(1)).alias("degree")).filter(F.col("degree") >= max(2, min_degree))
    near = simple.join(degree.select("src"), "src", "left_semi").filter("dst is not null")
    parts = max(2, math.ceil(math.sqrt(simple.count() / CELL)))
    closed = _closed_pairs(near, simple.filter("src <> dst"), parts)
    rows = degree.join(closed.withColumnRenamed("j", "src"), "src", "left").select(F.col("src").alias("vertex"), "degree", F.coalesce("closed", F.lit(0)).cast("long").alias("closed"))
    return rows.withColumn("coefficient", F.col("closed") / (F.col("degree") * (F.col("degree") - 1)))


def clustering_exact(g: Graph, min_degree: int = 3) -> DataFrame:
    """One row: mean coefficient of the eligible vertices (0.0 if none), and their number."""
    return local_clustering(g, min_degree).agg(F.coalesce(F.avg("coefficient"), F.lit(0.0)).alias("clustering"), F.count(F.lit(1)).alias("eligible"))


def numbered_arcs(arcs: DataFrame) -> DataFrame:
    """(place, src, dst): arcs numbered from 0 in the order of (src, dst), so those
    of a source stand together.  Sorted by range, numbered within partitions and
    shifted by what the earlier ones hold (one count a partition reaches the driver)."""
    parts = cut(arcs.repartitionByRange("src", "dst").sortWithinPartitions("src", "dst").withColumn("at", F.monotonically_increasing_id()), "arcs")
    part = F.shiftright("at", 33)
    counts = sorted(parts.groupBy(part.alias("part")).count().collect())
    before = np.cumsum([0, *(n for _, n in counts)]).tolist()
    shift = F.create_map(*(F.lit(x).cast("long") for (p, _), n in zip(counts, before) for x in (p, n))) if counts else F.create_map(F.lit(0).cast("long"), F.lit(0).cast("long"))
    return parts.select((F.col("at").bitwiseAND(F.lit((1 << 33) - 1)) + shift[part]).alias("place"), "src", "dst")


def clustering_sampled(g: Graph, k: int, seed: int, min_degree: int = 3) -> DataFrame:
    """One row: share of ``k`` sampled neighbour pairs that are arcs; NULL for
    k = 0, 0.0 if no vertex is eligible.

    A trial's hashes pick the rank of an eligible vertex, then two different of its
    arcs by their places in the table of all arcs: neighbours are never gathered,
    and draws from one hub go to as many tasks as it has arcs.  Draw i of trial t
    is the 64-bit mix of 3 t + i."""
    from .graph import dense_ids

    arcs = cut(numbered_arcs(g.simple().filter("src is not null and dst is not null")), "places")
    near = arcs.groupBy("src").agg(F.count(F.lit(1)).alias("degree"), F.min("place").alias("first")).filter(F.col("degree") >= max(2, min_degree))
    near = cut(near, "near")
    ranks = dense_ids(near, "src")
    total = near.count()
    if not total:
        return g.spark.range(1).select(F.lit(0.0 if k else None).cast("double").alias("clustering"), F.lit(k).cast("long").alias("samples"))
    draws = g.spark.range(k).select("id", *(F.shiftrightunsigned(jenkins64(F.col("id") * 3 + i, seed), 1).alias(f"draw_{i}") for i in range(3)))
    picked = draws.withColumn("vertex", F.col("draw_0") % total).join(ranks, "vertex").join(near.withColumnRenamed("src", "key"), "key")
    a = F.col("draw_1") % F.col("degree")
    b = (a + 1 + F.col("draw_2") % (F.col("degree") - 1)) % F.col("degree")
    places = picked.select("id", (F.col("first") + a).alias("place"), (F.col("first") + b).alias("other"))
    ends = places.join(arcs.select("place", F.col("dst").alias("u")), "place").join(arcs.select(F.col("place").alias("other"), F.col("dst").alias("w")), "other")
    hits = ends.select("id", F.col("u").alias("src"), F.col("w").alias("dst")).join(arcs.select("src", "dst"), ["src", "dst"], "left_semi").agg(F.count(F.lit(1)).alias("hits"))
    return hits.select((F.col("hits") / F.lit(k if k else None)).alias("clustering"), F.lit(k).cast("long").alias("samples"))
