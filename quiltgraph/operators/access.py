"""Access to the vertices, edges and partitions of subgraphs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltgraph.operators.subgraphs import Subgraphs


def local_vertices(s: Subgraphs) -> DataFrame:
    return s.vertex_subgraph.select("subgraph_id", "vertex_id")


def remote_vertices(s: Subgraphs) -> DataFrame:
    return s.remote_vertices


def all_vertices(s: Subgraphs) -> DataFrame:
    """(subgraph_id, vertex_id, is_remote): local vertices and stubs."""
    local = local_vertices(s).withColumn("is_remote", F.lit(False))
    return local.unionByName(s.remote_vertices.select("subgraph_id", "vertex_id", F.lit(True).alias("is_remote")))


def vertex_by_id(s: Subgraphs, vertex_id: int) -> DataFrame:
    """The rows of one vertex: where it is local, and the subgraphs that have a stub of it."""
    return all_vertices(s).where(F.col("vertex_id") == vertex_id)


def vertex_counts(s: Subgraphs) -> DataFrame:
    """(subgraph_id, n_vertices, n_local): with and without stubs."""
    return s.subgraphs.select("subgraph_id", (F.col("n_local") + F.col("n_remote")).alias("n_vertices"), "n_local")


def subgraph_edges(s: Subgraphs) -> DataFrame:
    """Out-edges of local vertices, repeated ones kept."""
    if s.graph.neighbours is not None:
        return s.graph.edges_of(s.vertex_subgraph.select("vertex_id", "subgraph_id").join(s.graph.first_edges.drop("n"), "vertex_id"))
    home = s.vertex_subgraph.select(F.col("vertex_id").alias("src"), "subgraph_id")
    return s.graph.numbered_edges.join(home, "src").select("subgraph_id", "edge_id", "src", "dst")


def edge_by_id(s: Subgraphs, edge_id: int) -> DataFrame:
    if s.graph.neighbours is not None:
        rank = F.lit(edge_id & 0xFFFFFFFF)
        source = s.graph.first_edges.where((F.col("partition_id") == edge_id >> 32) & (F.col("first") <= rank) & (rank < F.col("first") + F.col("n"))).drop("n")
        source = s.vertex_subgraph.select("vertex_id", "subgraph_id").join(F.broadcast(source), "vertex_id")
        return s.graph.edges_of(F.broadcast(source)).where(F.col("edge_id") == edge_id)
    return subgraph_edges(s).where(F.col("edge_id") == edge_id)


def out_edges(s: Subgraphs, vertex_id: int) -> DataFrame:
    return s.graph.numbered_edges.where(F.col("src") == vertex_id)


def in_edges(s: Subgraphs, vertex_id: int) -> DataFrame:
    return s.graph.numbered_edges.where(F.col("dst") == vertex_id)


def remote_owners(s: Subgraphs) -> DataFrame:
    """(subgraph_id, vertex_id, owner_subgraph_id, owner_partition_id) of each stub."""
    return s.remote_vertices.withColumn("owner_partition_id", F.shiftright("owner_subgraph_id", 32).cast("int"))


def with_values(df: DataFrame, key: str, values: DataFrame, value: str = "value") -> DataFrame:
    """df with the column ``value`` set from values (key, value); rows without a new one keep what they have. For vertex,
    edge, subgraph and remote-vertex values alike."""
    new = values.select(F.col(key), F.struct(F.col(value)).alias("_new"))
    joined = df.join(new, key, "left")
    old = F.col(value) if value in df.columns else F.lit(None)
    changed = F.when(F.col("_new").isNotNull(), F.col("_new")[value]).otherwise(old)
    return joined.select(*[c for c in df.columns if c != value], changed.alias(value))


def partition_subgraphs(s: Subgraphs, partition_id: int | None = None) -> DataFrame:
    """Subgraphs of one or all partitions, those with most vertices first."""
    found = s.subgraphs if partition_id is None else s.subgraphs.where(F.col("partition_id") == partition_id)
    return found.orderBy("partition_id", F.desc(F.col("n_local") + F.col("n_remote")), "subgraph_id")


def add_subgraphs(subgraphs: DataFrame, more: DataFrame) -> DataFrame:
    return subgraphs.unionByName(more)


def remove_subgraphs(subgraphs: DataFrame, ids: DataFrame) -> DataFrame:
    return subgraphs.join(ids.select("subgraph_id"), "subgraph_id", "left_anti")
