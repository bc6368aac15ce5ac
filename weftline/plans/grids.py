"""Grids of generated graphs, one graph a task: what single-machine kernels are
usually timed on.  The graphs are small and many, so they are the parallel axis."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import generators, mincut, paths, small

SEED = 0xBAD5EED
#: Vertices and chance of an arc: fixed values.
PAIRS = [(20, 0.6), (30, 0.4), (30, 0.8), (40, 0.6), (70, 0.2), (40, 0.8), (50, 0.6), (50, 0.8), (60, 0.6), (60, 0.8), (70, 0.6), (70, 0.8), (80, 0.8)]
#: Triads that each new vertex closes: fixed values.
TRIADS = [1, 2, 3, 5, 8, 12, 50]


def gnp_grid(spark: SparkSession) -> DataFrame:
    """(graph, n, src, dst) of a random graph a pair."""
    rows = [(k, n, p, SEED + k) for k, (n, p) in enumerate(PAIRS)]
    return generators.gnp_grid(spark.createDataFrame(rows, "graph long, n long, p double, seed long").repartition(min(len(rows), spark.sparkContext.defaultParallelism)))


def clustered_grid(spark: SparkSession, sizes=range(500, 4001, 500)) -> DataFrame:
    """(graph, src, dst): preferential attachment with 10 arcs a vertex."""
    rows = [(1000 * n + o, n, 10, o, SEED) for n in sizes for o in TRIADS]
    frame = spark.createDataFrame(rows, "graph long, n long, d long, o long, seed long")
    return generators.clustered_grid(frame.repartition(min(len(rows), spark.sparkContext.defaultParallelism)))


def program_grid(spark: SparkSession, sizes=range(200_000, 800_001, 100_000), triads=TRIADS) -> DataFrame:
    """(graph, src, dst) of large graphs, each grown by many tasks."""
    rows = [(1000 * n + o, n, 10, o, SEED) for n in sizes for o in triads]
    return generators.attached_grid(spark.createDataFrame(rows, "graph long, n long, d long, o long, seed long"))


def each_graph(graphs: DataFrame, fn: Callable[[np.ndarray, int], float]) -> DataFrame:
    """(graph, value): ``fn(matrix, n)`` of every graph."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        n = int(pdf["n"].iloc[0])
        matrix = np.zeros((n, n), bool)
        matrix[pdf["src"], pdf["dst"]] = True
        return pd.DataFrame({"graph": pdf["graph"].iloc[:1], "value": [float(fn(matrix, n))]})

    return graphs.groupBy("graph").applyInPandas(run, "graph long, value double")


def path_length(matrix: np.ndarray, n: int) -> float:
    """Sum over ordered pairs by n (n - 1) / 2; NaN if not connected."""
    dist = small.distances(matrix | matrix.T)
    return dist.sum() / (n * (n - 1) / 2) if (dist >= 0).all() else float("nan")


def ball_estimate(b: int) -> Callable[[np.ndarray, int], float]:
    return lambda matrix, n: paths._ball_rounds(matrix, b, SEED, False)[0][0]


def cut_size(strategy: str = "copy", find_mode: str = "halving") -> Callable[[np.ndarray, int], float]:
    """The smallest cut that as many trials find as follow from the low ones of n."""

    def run(matrix: np.ndarray, n: int) -> float:
        weight = np.triu(matrix.astype(int) + matrix.T.astype(int), 1)
        u, v = np.nonzero(weight)
        return mincut.least_cut(n, np.column_stack([u, v, weight[u, v]]), mincut.low_ones_trials(n), SEED, strategy, find_mode)

    return run


def wedge_shares(graphs: DataFrame, samples: int) -> DataFrame:
    """(graph, value): the share of sampled pairs of a vertex's out-neighbours that are
    arcs, in every graph (graph, src, dst) of a few thousand vertices, one a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        src, dst = pdf["src"].to_numpy(), pdf["dst"].to_numpy()
        order = np.lexsort((dst, src))
        src, dst = src[order], dst[order]
        first, degree = np.unique(src, return_index=True, return_counts=True)[1:]
        own = np.flatnonzero(degree >= 3)
        rng = np.random.default_rng([SEED, int(pdf["graph"].iloc[0])])
        v = own[rng.integers(0, len(own), samples)]
        a = rng.integers(0, degree[v])
        b = (a + 1 + rng.integers(0, degree[v] - 1)) % degree[v]
        n = int(max(src.max(), dst.max())) + 1
        hit = np.isin(dst[first[v] + a] * n + dst[first[v] + b], src * n + dst)
        return pd.DataFrame({"graph": pdf["graph"].iloc[:1], "value": [hit.mean()]})

    return graphs.groupBy("graph").applyInPandas(run, "graph long, value double")
