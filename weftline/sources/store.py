"""A graph kept in buckets of its sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.graph import Graph
from ..plans.storage import bucketed, drop


class EdgeStore:
    """Arcs bucketed and sorted by ``src``.  Joins on the source, as in searches and
    look-ups of many rows, move only the other side; rows of given vertices are
    read from their buckets alone."""

    def __init__(self, g: Graph):
        self.n, self._table = g.n, bucketed(g.edges, "src", "store")

    @property
    def graph(self) -> Graph:
        return Graph(self._table, self.n)

    def rows(self, vertices: list[int]) -> DataFrame:
        """Arcs of the vertices named."""
        return self._table.filter(F.col("src").isin(*vertices))

    def rows_of(self, vertices: DataFrame) -> DataFrame:
        """Arcs of all ``vertices`` (vertex)."""
        return self._table.join(vertices.select(F.col("vertex").alias("src")), "src", "left_semi")

    def drop(self) -> None:
        drop(self._table)
