"""Graphs read from and written to files, and small graphs written out."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from ..operators.graph import Graph


def read_edges(spark: SparkSession, path: str, source: str = "parquet", src: str = "src", dst: str = "dst", weight: str | None = None, n: int | None = None, **options) -> Graph:
    """An edge list in any format Spark reads (parquet, csv, json, orc, ..)."""
    return Graph.from_edges(spark.read.format(source).options(**options).load(path), src, dst, weight, n)


def read_edge_text(spark: SparkSession, path: str, separator: str = r"\s+", comment: str = "#", n: int | None = None) -> Graph:
    """Plain text, an arc a line: source, target."""
    parts = F.split(F.trim("value"), separator)
    rows = spark.read.text(path).filter(~F.col("value").startswith(comment) & (F.trim("value") != ""))
    return Graph.from_edges(rows.select(parts[0].cast("long").alias("src"), parts[1].cast("long").alias("dst")), n=n)


def write_edges(g: Graph, path: str, files: int | None = None) -> None:
    """Parquet sorted by source within files that split the sources by range."""
    edges = g.edges if files is None else g.edges.repartitionByRange(files, "src")
    edges.sortWithinPartitions("src", "dst").write.parquet(path)


def two_blocks(spark: SparkSession, size: int, bridges: list[tuple[int, int]]) -> Graph:
    """Two complete blocks of ``size`` vertices each, arcs both ways, and one-way
    bridges from the first to the second."""
    v = spark.range(size)
    pairs = v.select(F.col("id").alias("src")).join(v.select(F.col("id").alias("dst")), F.col("src") != F.col("dst"))
    other = pairs.select((F.col("src") + size).alias("src"), (F.col("dst") + size).alias("dst"))
    return Graph(pairs.unionByName(other).unionByName(spark.createDataFrame(bridges, "src long, dst long")), 2 * size)


def twin_fives(spark: SparkSession) -> Graph:
    """10 vertices, 43 arcs; smallest cut 2-6, 3-7, 4-5."""
    return two_blocks(spark, 5, [(2, 6), (4, 5), (3, 7)])


def twin_tens(spark: SparkSession) -> Graph:
    """20 vertices, 184 arcs; smallest cut 1-11, 2-12, 3-13, 4-14."""
    return two_blocks(spark, 10, [(i, 10 + i) for i in range(1, 5)])


def complete(spark: SparkSession, n: int) -> Graph:
    """All n * n arcs, self loops included."""
    v = spark.range(n)
    return Graph(v.select(F.col("id").alias("src"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("dst")), n)
