"""Graphs that the commerce tables contain, for queries and measurements."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quiltgraph.operators import neighbours
from quiltgraph.operators.graph import Graph, build_graph, graph_of_neighbours

PARTITIONS = 4


def _symmetric(pairs: DataFrame) -> DataFrame:
    return pairs.select("src", "dst").unionByName(pairs.select(F.col("dst").alias("src"), F.col("src").alias("dst")))


def _graph(edges: DataFrame, vertices: DataFrame | None = None) -> Graph:
    ends = edges.select(F.explode(F.array("src", "dst")).alias("vertex_id")) if vertices is None else vertices
    return build_graph(ends.distinct().withColumn("partition_id", F.pmod("vertex_id", F.lit(PARTITIONS)).cast("int")), edges, "none")


def geo(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers and suppliers with their nations, nations with their regions; both directions."""
    read = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
    nation = lambda c: F.col(c).cast("long") + 1000
    c = read("customer").select((F.col("c_custkey") + 1_000_000).alias("src"), nation("c_nationkey").alias("dst"))
    s = read("supplier").select((F.col("s_suppkey") + 2_000_000).alias("src"), nation("s_nationkey").alias("dst"))
    n = read("nation").select(nation("n_nationkey").alias("src"), F.col("n_regionkey").cast("long").alias("dst"))
    return _graph(_symmetric(c.unionByName(s).unionByName(n)))


def copurchase(spark: SparkSession, sf_dir: str) -> Graph:
    """Parts bought in one order; both directions. An order has a few lines, so its pairs are few."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.col("l_orderkey").cast("long").alias("group_id"), F.col("l_partkey").cast("long").alias("member"))
    return graph_of_neighbours(neighbours.of_groups(lines), PARTITIONS)


def purchases(spark: SparkSession, sf_dir: str) -> Graph:
    """Customers with their orders; both directions. Many small components, each in several partitions."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select(F.col("o_custkey").cast("long").alias("src"), (F.col("o_orderkey").cast("long") + 10_000_000_000).alias("dst"))
    return _graph(_symmetric(orders.where("src is not null and dst is not null").distinct()))


def transitions(spark: SparkSession, sf_dir: str) -> Graph:
    """From each event's user to the next event's, in order of time; directed, without loops and repeats.

    The order is over all events: they are dealt to hours and ordered within each, and the first event of the next
    hour that has any ends each hour.
    """
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "ts", F.col("user_id"), F.date_trunc("hour", "ts").alias("hour"))
    first = events.groupBy("hour").agg(F.min_by("user_id", F.struct("ts", "event_id")).alias("first"))
    # an hour is a row here
    follows = first.select("hour", F.lead("first").over(Window.orderBy("hour")).alias("follows"))
    own = F.lead("user_id").over(Window.partitionBy("hour").orderBy("ts", "event_id"))
    steps = events.withColumn("own", own).join(F.broadcast(follows), "hour").select(F.col("user_id").alias("src"), F.coalesce("own", "follows").alias("dst"))
    return _graph(steps.where("src <> dst").distinct())
