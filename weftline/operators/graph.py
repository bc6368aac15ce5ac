"""The graph handle: an edge table (src, dst[, weight]) and a vertex count.

Vertices are 0 .. n-1.  Arcs are kept as given: duplicates are parallel arcs,
self loops stay, directions matter to the operators that say so.  DataFrames
do not change, so adding links or vertices gives a new handle.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..plans.storage import cut


@dataclass(frozen=True)
class Graph:
    edges: DataFrame
    n: int

    @staticmethod
    def from_edges(df: DataFrame, src: str = "src", dst: str = "dst", weight: str | None = None, n: int | None = None, validate: bool = False) -> Graph:
        """Canonical edge table from any two id columns.  ``n`` defaults to the
        largest endpoint + 1; ``validate`` checks that both ends lie in [0, n)."""
        columns = [F.col(src).cast("long").alias("src"), F.col(dst).cast("long").alias("dst")]
        if weight:
            columns.append(F.col(weight).alias("weight"))
        edges = df.select(*columns)
        if n is None:
            top = edges.agg(F.max(F.greatest("src", "dst")).alias("m")).first().m
            n = 0 if top is None else top + 1
        if validate and edges.filter(~(F.col("src").between(0, n - 1) & F.col("dst").between(0, n - 1)) | F.col("src").isNull() | F.col("dst").isNull()).limit(1).count():
            raise ValueError(f"an endpoint lies outside 0..{n - 1}")
        return Graph(edges, n)

    @staticmethod
    def literal(spark: SparkSession, n: int, arcs: list[tuple], weighted: bool = False) -> Graph:
        """A graph written out: (src, dst) or (src, dst, weight) tuples; ``weighted``
        says so where there are none yet."""
        schema = "src long, dst long" + (", weight int" if weighted or (arcs and len(arcs[0]) == 3) else "")
        return Graph(spark.createDataFrame(arcs, schema), n)

    @property
    def spark(self) -> SparkSession:
        return self.edges.sparkSession

    @property
    def vertices(self) -> DataFrame:
        return self.spark.range(self.n).withColumnRenamed("id", "vertex")

    def edge_count(self) -> int:
        return self.edges.count()

    def out_degrees(self) -> DataFrame:
        """(vertex, degree) for vertices with an arc; parallel arcs count."""
        return self.edges.groupBy(F.col("src").alias("vertex")).agg(F.count(F.lit(1)).alias("degree"))

    def neighbours(self, vertex: int) -> DataFrame:
        return self.edges.filter(F.col("src") == vertex).drop("src")

    def adjacency(self, all_vertices: bool = True) -> DataFrame:
        """(vertex, neighbours): one row a vertex, neighbours in ascending order;
        with ``all_vertices`` also those without arcs, as empty arrays."""
        record = F.struct("dst", "weight") if "weight" in self.edges.columns else F.struct("dst")
        rows = self.edges.groupBy(F.col("src").alias("vertex")).agg(F.sort_array(F.collect_list(record)).alias("neighbours"))
        if not all_vertices:
            return rows
        kind = rows.schema["neighbours"].dataType.simpleString()
        return self.vertices.join(rows, "vertex", "left").withColumn("neighbours", F.coalesce("neighbours", F.array().cast(kind)))

    def arcs_of(self, adjacency: DataFrame) -> DataFrame:
        """Flatten an adjacency table to arcs again."""
        return adjacency.select(F.col("vertex").alias("src"), F.explode("neighbours").alias("e")).select("src", "e.*")

    def has_link(self, pairs: DataFrame) -> DataFrame:
        """The (src, dst) rows of ``pairs`` that are arcs."""
        return pairs.join(self.edges, ["src", "dst"], "left_semi")

    def lacks_link(self, pairs: DataFrame) -> DataFrame:
        return pairs.join(self.edges, ["src", "dst"], "left_anti")

    def with_links(self, more: DataFrame) -> Graph:
        top = more.agg(F.max(F.greatest("src", "dst")).alias("m")).first().m
        return Graph(self.edges.unionByName(more), max(self.n, (top if top is not None else -1) + 1))

    def with_vertex(self, vertex: int) -> Graph:
        """Room for ``vertex``; never fewer vertices than before."""
        return Graph(self.edges, max(self.n, vertex + 1))

    def lines(self) -> DataFrame:
        """(vertex, line): ``v: a -> b -> c`` for each vertex."""
        names = F.array_join(F.transform("neighbours", lambda e: e["dst"].cast("string")), " -> ")
        return self.adjacency().select("vertex", F.concat(F.col("vertex").cast("string"), F.lit(": "), names).alias("line"))

    def inside(self) -> DataFrame:
        """The arcs with both ends in 0 .. n-1; others (null ends too) take no part
        in paths, components and cuts."""
        return self.edges.filter(F.col("src").between(0, self.n - 1) & F.col("dst").between(0, self.n - 1))

    def simple(self) -> DataFrame:
        """Distinct arcs without weights."""
        return self.edges.select("src", "dst").distinct()

    def exactly(self, size: int) -> DataFrame:
        """The first ``size`` arcs in order; fails if there are fewer."""
        out = cut(self.edges.orderBy("src", "dst").limit(size), "exactly")
        if out.count() < size:
            raise ValueError(f"fewer than {size} arcs")
        return out


COUNTS = "arcs long, loops long, outside long, ascend boolean, first long, last long, low long, high long"


def tally(n: int, blocks) -> pa.RecordBatch:
    """Arrays (src, dst) of arcs, block by block -> one row: how many, loops, ends outside
    0 .. n - 1, whether arcs ascend, and the ranges of sources and targets."""
    arcs, loops, outside, ascend, last = 0, 0, 0, True, None
    ranges: list = [None] * 4
    for src, dst in blocks:
        if not len(src):
            continue
        first, final, low, high = (int(x) for x in (src.min(), src.max(), dst.min(), dst.max()))
        arcs += len(src)
        if first <= high and low <= final:
            loops += int((src == dst).sum())
        if min(first, low) < 0 or max(final, high) >= n:
            outside += int(((src < 0) | (src >= n) | (dst < 0) | (dst >= n)).sum())
        if ascend:
            up = (src[1:] > src[:-1]) | (dst[1:] > dst[:-1])  # of sources that do not descend
            ascend = bool(up.all() and (src[1:] >= src[:-1]).all()) and (last is None or last < (src[0], dst[0]))
        last = src[-1], dst[-1]
        ranges = [x if y is None else least(x, y) for least, x, y in zip((min, max, min, max), (first, final, low, high), ranges)]
    types = [pa.int64()] * 3 + [pa.bool_()] + [pa.int64()] * 4
    row = arcs, loops, outside, ascend, *ranges
    return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types)], [c.split()[0] for c in COUNTS.split(", ")])


def counted(n: int):
    """Batches of arcs (src, dst), without nulls, that a task reads -> their :func:`tally`."""

    def run(batches):
        yield tally(n, ([batch.column(x).to_numpy() for x in ("src", "dst")] for batch in batches))

    return run


def arc_counts(g: Graph, tasks: DataFrame | None = None) -> DataFrame:
    """One row: loops, outside (arcs with an end outside 0 .. n - 1), repeated (arcs less
    distinct ones) and arcs.  ``tasks`` are rows of :func:`tally` that cover them.

    If arcs ascend in every such row, and none has both sources and targets in the ranges of
    another's, all arcs are distinct and none has moved; else they are counted by both ends."""
    tasks = cut(g.edges.select("src", "dst").mapInArrow(counted(g.n), COUNTS) if tasks is None else tasks, "counts")
    # bands are the ranges of sources that overlap
    earlier = F.max("last").over(Window.orderBy("first").rowsBetween(Window.unboundedPreceding, -1))
    begins = F.coalesce(F.col("first") > earlier, F.lit(True)).cast("int")
    band = F.sum("begins").over(Window.orderBy("first", F.desc("begins")).rowsBetween(Window.unboundedPreceding, 0))
    before = F.lag("high").over(Window.partitionBy("band").orderBy("low"))
    banded = tasks.filter("arcs > 0").withColumn("begins", begins).withColumn("band", band).withColumn("before", before)
    apart = banded.filter(~F.col("ascend") | (F.col("before") >= F.col("low"))).isEmpty()
    sums = tasks.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in ("loops", "outside", "arcs")))
    distinct = F.col("arcs") if apart else g.edges.agg(F.count_distinct("src", "dst")).scalar()
    return sums.select("loops", "outside", (F.col("arcs") - distinct).alias("repeated"), "arcs")


def dense_ids(df: DataFrame, column: str) -> DataFrame:
    """(key, vertex): the distinct values of a column numbered from 0 in order.
    Sorted by range, numbered within partitions and shifted by what the earlier
    ones hold (one count a partition reaches the driver)."""
    keys = df.select(F.col(column).alias("key")).filter("key is not null").distinct().repartitionByRange("key").withColumn("part", F.spark_partition_id())
    keys = cut(keys, "keys")
    counts = sorted(keys.groupBy("part").count().collect())
    shift, total = {}, 0
    for part, n in counts:
        shift[part], total = total, total + n
    if not shift:
        return keys.select("key", F.lit(0).cast("long").alias("vertex"))
    offset = F.create_map(*(F.lit(x).cast("long") for kv in shift.items() for x in kv))[F.col("part").cast("long")]
    within = F.row_number().over(Window.partitionBy("part").orderBy("key")) - 1
    return keys.select("key", (within + offset).cast("long").alias("vertex"))
