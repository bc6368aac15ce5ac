"""Graphs derived from the test tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.graph import Graph, dense_ids
from ..plans.storage import cut


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _shipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(src, dst): supplier and customer nation of every line."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_suppkey")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    customers = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    rows = lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey")).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    return rows.select(F.col("s_nationkey").cast("long").alias("src"), F.col("c_nationkey").cast("long").alias("dst"))


def trade(spark: SparkSession, sf_dir: str) -> Graph:
    """Supplier nation -> customer nation where more lines than the mean over all
    such pairs of different nations are shipped."""
    flows = _shipped(spark, sf_dir).filter("src <> dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("n"))
    arcs = flows.filter(F.col("n") > flows.agg(F.avg("n")).scalar()).select("src", "dst")
    return Graph(arcs, table(spark, sf_dir, "nation").count())


def region_flow(spark: SparkSession, sf_dir: str) -> Graph:
    """An arc for every line, from the supplier's to the customer's region."""
    region = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("key"), F.col("n_regionkey").cast("long").alias("region"))
    rows = _shipped(spark, sf_dir)
    for end in ("src", "dst"):
        rows = rows.join(F.broadcast(region.toDF(end, f"r_{end}")), end)
    return Graph(rows.select(F.col("r_src").alias("src"), F.col("r_dst").alias("dst")), table(spark, sf_dir, "region").count())


def reorders(spark: SparkSession, sf_dir: str) -> Graph:
    """Each order -> the next one of the same customer: a forest of long chains."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    after = F.lead("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    arcs = orders.select(F.col("o_orderkey").alias("src"), after.alias("dst")).filter("dst is not null")
    return Graph(arcs, orders.agg(F.max("o_orderkey")).first()[0] + 1)


def first_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vertex): where the chains of :func:`reorders` begin."""
    orders = table(spark, sf_dir, "orders")
    return orders.groupBy("o_custkey").agg(F.min_by("o_orderkey", F.struct("o_orderdate", "o_orderkey")).alias("vertex")).select("vertex")


def session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct (user, user of the next event), where they differ.  Events are put in
    order by range; the next of a partition's last one is the first of the partition
    after it (a row a partition), so no group of events is ordered in one task."""
    events = table(spark, sf_dir, "events").select("ts", "event_id", "user_id").repartitionByRange("ts", "event_id")
    parts = cut(events.withColumn("part", F.spark_partition_id()), "events")
    place = F.struct("ts", "event_id")
    rows = parts.withColumn("next", F.lead("user_id").over(Window.partitionBy("part").orderBy("ts", "event_id")))
    edge = parts.groupBy("part").agg(F.min_by("user_id", place).alias("first"), F.max_by("user_id", place).alias("last"))
    across = edge.select(F.col("last").alias("src"), F.lead("first").over(Window.orderBy("part")).alias("dst"))  # a row a partition
    pairs = rows.select(F.col("user_id").alias("src"), F.col("next").alias("dst")).unionByName(across)
    return pairs.filter("dst is not null and src <> dst").select(F.col("src").cast("long"), F.col("dst").cast("long")).distinct()


def supply(spark: SparkSession, sf_dir: str) -> Graph:
    """Supplier - part arcs of lineitem; parts are numbered after the suppliers."""
    suppliers, parts = (table(spark, sf_dir, t).count() for t in ("supplier", "part"))
    arcs = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("src"), (F.col("l_partkey") + suppliers).alias("dst")).distinct()
    return Graph(arcs, suppliers + parts)


def months(spark: SparkSession, sf_dir: str) -> Graph:
    """An arc for every line, from the month of its order to that of its shipping."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.month("l_shipdate").alias("shipped"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.month("o_orderdate").alias("ordered"))
    rows = lines.join(orders, "l_orderkey").filter("shipped is not null and ordered is not null")
    return Graph(rows.select((F.col("ordered") - 1).cast("long").alias("src"), (F.col("shipped") - 1).cast("long").alias("dst")), 12)


def segments(spark: SparkSession, sf_dir: str) -> Graph:
    """An arc for every order, from its customer's market segment to its priority,
    each numbered in order, priorities after the segments."""
    customers = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderpriority").join(customers, "o_custkey")
    segment, priority = dense_ids(customers, "c_mktsegment"), dense_ids(orders, "o_orderpriority")
    first = segment.count()
    rows = orders.join(segment.toDF("c_mktsegment", "src"), "c_mktsegment").join(priority.toDF("o_orderpriority", "dst"), "o_orderpriority")
    return Graph(rows.select("src", (F.col("dst") + first).alias("dst")), first + priority.count())


def customer_ring(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers in a ring by their key, 0 to n - 1, each with an arc to the next one
    and another for each of its orders."""
    customers, orders = table(spark, sf_dir, "customer").select("c_custkey"), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"))
    n = customers.count()
    rows = customers.unionByName(orders.join(customers, "c_custkey", "left_semi"))
    return Graph(rows.select(F.col("c_custkey").alias("src"), ((F.col("c_custkey") + 1) % n).alias("dst")), n)


def catalogue(spark: SparkSession, sf_dir: str) -> Graph:
    """A tree: parts below their brands, suppliers below their nations, these below
    one root.  Numbered in this order: parts, suppliers, nations, brands, root."""
    parts, suppliers = table(spark, sf_dir, "part").select("p_partkey", "p_brand"), table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nations = table(spark, sf_dir, "nation").select("n_nationkey")
    brands = dense_ids(parts, "p_brand")
    first = [0]
    for t in (parts, suppliers, nations, brands):
        first.append(first[-1] + t.count())
    root = F.lit(first[4]).cast("long").alias("dst")
    arcs = parts.join(brands.toDF("p_brand", "brand"), "p_brand").select(F.col("p_partkey").alias("src"), (F.col("brand") + first[3]).alias("dst"))
    arcs = arcs.unionByName(suppliers.select((F.col("s_suppkey") + first[1]).alias("src"), (F.col("s_nationkey") + first[2]).cast("long").alias("dst")))
    arcs = arcs.unionByName(nations.select((F.col("n_nationkey") + first[2]).cast("long").alias("src"), root)).unionByName(brands.select((F.col("vertex") + first[3]).alias("src"), root))
    return Graph(arcs, first[4] + 1)
