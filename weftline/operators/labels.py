"""Component labels kept under batches of arcs, with every state to return to.

A batch only joins labels: its arcs are taken to the labels of their ends, and
components of these pairs say which labels move.  Moves are a table of their own,
so the work follows the batch and nothing is written for vertices it does not
touch.  A handle names the moves up to it; as tables do not change, a handle kept is
a save point, and going on from it leaves what came after aside.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.storage import cut
from .components import stars

#: Tables of moves that a look-up passes before they are put together.
MOST = 6


@dataclass(frozen=True)
class Labels:
    """Labels of vertices 0 .. n - 1: the least vertex of each component."""

    spark: SparkSession
    n: int
    moves: tuple[DataFrame, ...] = ()
    components: int | None = None

    def _labelled(self, rows: DataFrame, column: str) -> DataFrame:
        """``rows`` with ``column`` taken to its label."""
        for m in self.moves:
            rows = rows.join(m.select(F.col("old").alias(column), "new").hint("merge"), column, "left").withColumn(column, F.coalesce("new", column)).drop("new")
        return rows

    def joined(self, arcs: DataFrame) -> Labels:
        """After a batch of arcs (src, dst); those with an end outside take no part."""
        ends = arcs.select(F.col("src").alias("u"), F.col("dst").alias("v")).filter(F.col("u").between(0, self.n - 1) & F.col("v").between(0, self.n - 1))
        links = self._labelled(self._labelled(ends, "u"), "v")
        moved = stars(links).toDF("old", "new")
        left = self.count() - moved.count()
        moves = (*self.moves, moved)
        if len(moves) > MOST:
            moves = (_composed(moves),)
        return Labels(self.spark, self.n, moves, left)

    def count(self) -> int:
        """How many components there are; no label is read for it."""
        return self.n if self.components is None else self.components

    def of(self, vertices: DataFrame) -> DataFrame:
        """(vertex, component) of the vertices given."""
        return self._labelled(vertices.select("vertex", F.col("vertex").alias("component")), "component").select("vertex", "component")

    def all(self) -> DataFrame:
        return self.of(self.spark.range(self.n).withColumnRenamed("id", "vertex"))

    def connected(self, pairs: DataFrame) -> DataFrame:
        """``pairs`` (a, b) with ``connected``."""
        both = self._labelled(self._labelled(pairs.select("a", "b", F.col("a").alias("label_a"), F.col("b").alias("label_b")), "label_a"), "label_b")
        return both.select("a", "b", (F.col("label_a") == F.col("label_b")).alias("connected"))


def _composed(moves: tuple[DataFrame, ...]) -> DataFrame:
    """One table of moves in place of many; these stay for the handles that hold them."""
    whole = moves[0]
    for m in moves[1:]:
        on = m.select(F.col("old").alias("new"), F.col("new").alias("next"))
        whole = whole.join(on.hint("merge"), "new", "left").select("old", F.coalesce("next", "new").alias("new")).unionByName(m)
    return cut(whole, "moves")
