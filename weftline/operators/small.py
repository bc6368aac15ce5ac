"""Graphs of few vertices: one task over a dense matrix in place of a job a round.

Only the number of vertices decides (distinct arcs are at most its square), so
what the task holds is bounded; larger graphs take the distributed way, with
the same results.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: 2,048 vertices: a byte matrix of 4 MB, distances of 16 MB.
SMALL = 2048


def with_matrix(arcs: DataFrame, n: int, fn, schema: str) -> DataFrame:
    """``fn(matrix)`` in one task, over the n x n matrix of distinct arcs (src,
    dst), which all lie inside; ``fn`` returns the columns of ``schema`` in order."""
    names = [c.split()[0] for c in schema.split(", ")]
    marker = arcs.sparkSession.range(1).select(F.lit(-1).cast("long").alias("src"), F.lit(-1).cast("long").alias("dst"))

    def run(table: pa.Table) -> pa.Table:
        src, dst = table.column("src").to_numpy(), table.column("dst").to_numpy()
        real = src >= 0
        matrix = np.zeros((n, n), bool)
        matrix[src[real], dst[real]] = True
        return pa.table([pa.array(c) for c in fn(matrix)], names)

    return arcs.select("src", "dst").distinct().unionByName(marker).groupBy().applyInArrow(run, schema)


def distances(matrix: np.ndarray, sources: np.ndarray | None = None) -> np.ndarray:
    """Levels from every source (all vertices), -1 where there is no way: all
    frontiers advance together by one matrix product a level."""
    n = len(matrix)
    at = np.arange(n) if sources is None else sources
    dist = np.full((len(at), n), -1, np.int32)
    dist[np.arange(len(at)), at] = 0
    front, steps, level = dist == 0, matrix.astype(np.float32), 0
    while front.any():
        level += 1
        front = (front.astype(np.float32) @ steps > 0) & (dist < 0)
        dist[front] = level
    return dist
