"""Components of few vertices as they are: many to a task, in arrays.

A component is dealt to a task whole, so a search of any number of rounds ends
there.  Only its number of vertices decides (``small.SMALL``); larger ones are left
to the distributed way, with the same results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import cut
from . import small
from .components import stars

#: Rows (arcs and vertices) that a task searches at a time, whole pieces each.
ROWS = 1 << 18
#: Pairs of vertices of the pieces searched at a time, and vertices of those that share arrays.
PAIRS, FEW = 1 << 22, 64


def split(arcs: DataFrame, links: DataFrame, vertices: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Distinct arcs (src, dst) dealt to small and large components.  ``links`` are the
    same arcs as they were read, where those of a component may still lie together.

    Rows (piece, src, dst, weight) of small ones, with dst -1 for each of
    ``vertices`` (vertex, weight); and the arcs of large ones, None if there are none."""
    found = stars(links.select(F.col("src").alias("u"), F.col("dst").alias("v")))
    sizes = found.groupBy(F.col("component").alias("piece")).agg((F.count(F.lit(1)) + 1).alias("n"))
    rows = arcs.select("src", "dst", F.lit(0).cast("long").alias("weight"))
    if vertices is not None:
        rows = rows.unionByName(vertices.select(F.col("vertex").alias("src"), F.lit(-1).cast("long").alias("dst"), F.col("weight").cast("long")))
    rows = rows.join(found.select(F.col("id").alias("src"), "component").hint("merge"), "src", "left").select(F.coalesce("component", "src").alias("piece"), "src", "dst", "weight")
    large = cut(sizes.filter(F.col("n") > small.SMALL).select("piece"), "large")
    if large.isEmpty():
        return rows, None
    rows = cut(rows, "pieces")
    return rows.join(large, "piece", "left_anti"), rows.join(large, "piece", "left_semi").filter("dst >= 0").select("src", "dst")


def search(rows: DataFrame, fn: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], Iterator[list]], schema: str, most: int | None = None) -> DataFrame:
    """``fn(piece, src, dst, weight)`` over whole pieces, about ``most`` (``ROWS``) rows at
    a time; it yields the columns of ``schema``."""
    names, most = [c.split()[0] for c in schema.split(", ")], most or ROWS

    def results(held):
        for columns in fn(*np.concatenate(held, axis=1)):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names)

    def run(batches):
        held, count = [], 0
        for batch in batches:
            rows = np.stack([c.to_numpy() for c in batch.columns])
            held.append(rows)
            count += rows.shape[1]
            if count >= most:  # the last piece may go on
                whole = np.concatenate(held, axis=1)
                last = np.searchsorted(whole[0], whole[0, -1])
                if last:
                    yield from results([whole[:, :last]])
                held, count = [whole[:, last:]], whole.shape[1] - last
                if not last:
                    held = [whole]
        if count:
            yield from results(held)

    return rows.select("piece", "src", "dst", "weight").repartition("piece").sortWithinPartitions("piece").mapInArrow(run, schema)


def pair_levels(piece: np.ndarray, src: np.ndarray, dst: np.ndarray, weight: np.ndarray) -> Iterator[list]:
    """(dist, pairs, first, both): of ordered pairs of different vertices, how many lie
    ``dist`` apart, and the sums of the first one's weight and of both multiplied."""
    vertex = np.unique(np.concatenate([src, dst[dst >= 0]]))
    n = len(vertex)
    u = np.searchsorted(vertex, src)
    of, load, arc = np.empty(n, np.int64), np.zeros(n, np.int64), dst >= 0
    of[u] = piece
    load[u[~arc]] = weight[~arc]
    u, v = u[arc], np.searchsorted(vertex, dst[arc])
    of[v] = piece[arc]
    order = np.argsort(of, kind="stable")  # vertices of a piece stand together
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    of, load, u, v = of[order], load[order], place[u], place[v]
    u, v = (x[np.argsort(u, kind="stable")] for x in (u, v))
    _, first, size = np.unique(of, return_index=True, return_counts=True)
    for i in np.flatnonzero(size > FEW).tolist():
        yield _dense(first[i], size[i], u, v, load)
    few = np.flatnonzero((size <= FEW) & (size > 1))
    group = np.cumsum(size[few] ** 2) // PAIRS
    for g in np.unique(group).tolist():
        yield _sparse(first[few[group == g]], size[few[group == g]], u, v, load)


def _dense(first: int, size: int, u: np.ndarray, v: np.ndarray, load: np.ndarray) -> list:
    a, b = np.searchsorted(u, [first, first + size])
    matrix = np.zeros((size, size), bool)
    matrix[u[a:b] - first, v[a:b] - first] = True
    dist, w = small.distances(matrix), load[first : first + size]
    levels = np.arange(1, dist.max() + 1)
    rows = [((at := dist == k).sum(), (w * at.sum(1)).sum(), (w * (at @ w)).sum() if w.any() else 0) for k in levels]
    return [levels.astype(np.int64), *np.array(rows, np.int64).reshape(-1, 3).T]


def _sparse(first: np.ndarray, size: np.ndarray, u: np.ndarray, v: np.ndarray, load: np.ndarray) -> list:
    """All searches of many pieces together: a byte a pair says whether it was reached."""
    base = np.cumsum(size**2) - size**2  # of a piece's pairs
    s = np.repeat(first, size) + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    own = np.repeat(np.arange(len(size)), size)
    begin, end = (np.searchsorted(u, np.arange(s[-1] + 1), side) for side in ("left", "right"))
    seen = np.zeros((size**2).sum(), bool)

    def at(s, d, p):
        return base[p] + (s - first[p]) * size[p] + d - first[p]

    d, levels = s, []
    seen[at(s, d, own)] = True
    while True:
        many = end[d] - begin[d]
        on = np.repeat(begin[d] - (np.cumsum(many) - many), many) + np.arange(many.sum())
        s, own, d = np.repeat(s, many), np.repeat(own, many), v[on]
        key = at(s, d, own)
        _, new = np.unique(np.where(seen[key], -1, key), return_index=True)
        new = new[~seen[key[new]]]
        if not len(new):
            return [np.arange(1, len(levels) + 1), *np.array(levels, np.int64).reshape(-1, 3).T]
        s, d, own = s[new], d[new], own[new]
        seen[key[new]] = True
        levels.append((len(s), load[s].sum(), (load[s] * load[d]).sum()))
