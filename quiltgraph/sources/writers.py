"""Graphs and results as text lines, JSON lines and Parquet."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltgraph.operators.graph import Graph
from quiltgraph.operators.subgraphs import Subgraphs


def _with_edges(graph: Graph) -> DataFrame:
    edges = graph.numbered_edges
    columns = [c for c in ("edge_id", "dst", "value") if c in edges.columns]
    held = edges.select(F.col("src").alias("vertex_id"), F.struct(*columns).alias("e"))
    if "value" in columns and dict(edges.dtypes)["value"].startswith("map"):
        lists = held.groupBy("vertex_id").agg(F.collect_list("e").alias("out"))
        lists = lists.withColumn("out", F.array_sort("out", lambda x, y: F.when(x["edge_id"] < y["edge_id"], -1).when(x["edge_id"] > y["edge_id"], 1).otherwise(0)))
    else:
        lists = held.groupBy("vertex_id").agg(F.sort_array(F.collect_list("e")).alias("out"))
    return graph.vertices.join(lists, "vertex_id", "left").withColumn("out", F.coalesce("out", F.array().cast(lists.schema["out"].dataType)))


def adjacency_lines(graph: Graph, with_partition: bool = True) -> DataFrame:
    """(partition_id, value): a line for each vertex, with its partition and sinks."""
    head = [F.col("vertex_id").cast("string")] + [F.col("partition_id").cast("string")] * with_partition
    return _with_edges(graph).select("partition_id", F.concat_ws(" ", *head, F.transform("out", lambda e: e["dst"].cast("string"))).alias("value"))


def _quoted(c: Column) -> Column:
    """A JSON string."""
    plain = F.replace(F.replace(F.coalesce(c, F.lit("")), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), F.replace(F.replace(F.replace(plain, F.lit("\n"), F.lit("\\n")), F.lit("\r"), F.lit("\\r")), F.lit("\t"), F.lit("\\t")), F.lit('"'))


def _listed(parts: Column) -> Column:
    return F.concat(F.lit("["), F.array_join(parts, ", "), F.lit("]"))


def json_lines(graph: Graph) -> DataFrame:
    """(partition_id, value): [src, partition, "value", [[sink, edge_id, "value"], ...]]."""
    edge = lambda e: _listed(F.array(e["dst"].cast("string"), e["edge_id"].cast("string"), _quoted(e["value"])))
    line = F.array(F.col("vertex_id").cast("string"), F.col("partition_id").cast("string"), _quoted(F.col("value")), _listed(F.transform("out", edge)))
    return _with_edges(graph).select("partition_id", _listed(line).alias("value"))


def property_text(m: Column) -> Column:
    return F.array_join(F.transform(F.map_entries(m), lambda e: F.concat(e["key"], F.lit(":String:"), e["value"])), "$")


def json_map_lines(graph: Graph) -> DataFrame:
    """(partition_id, value): [src, "key:String:value$...", [[sink, edge_id, "..."], ...]]."""
    edge = lambda e: _listed(F.array(e["dst"].cast("string"), e["edge_id"].cast("string"), _quoted(property_text(e["value"]))))
    line = F.array(F.col("vertex_id").cast("string"), _quoted(property_text(F.col("value"))), _listed(F.transform("out", edge)))
    return _with_edges(graph).select("partition_id", _listed(line).alias("value"))


def subgraph_lines(s: Subgraphs) -> DataFrame:
    """(subgraph_id, place, value): a dump of each subgraph: a line with its id, its partition and, for each neighbour,
    id and partition; a line for each vertex with id, 0 and sinks; an end line. Fields are tab-separated."""
    near = s.meta_edges.groupBy(F.col("src_sg").alias("subgraph_id")).agg(F.sort_array(F.collect_list("dst_sg")).alias("near"))
    pair = lambda x: F.concat_ws("\t", x.cast("string"), F.shiftright(x, 32).cast("string"))
    head = s.subgraphs.join(near, "subgraph_id", "left").select("subgraph_id", F.lit(0).alias("kind"), F.lit(0).cast("long").alias("at"), F.concat_ws("\t", F.col("subgraph_id").cast("string"), F.col("partition_id").cast("string"), F.transform("near", pair)).alias("value"))
    sinks = s.graph.neighbours
    if sinks is None:
        sinks = s.graph.edges.groupBy(F.col("src").alias("vertex_id")).agg(F.sort_array(F.collect_list("dst")).alias("sinks"))
    sinks = sinks.select("vertex_id", F.transform("sinks", lambda x: x.cast("string")).alias("sinks"))
    body = s.vertex_subgraph.join(sinks, "vertex_id", "left").select("subgraph_id", F.lit(1).alias("kind"), F.col("vertex_id").alias("at"), F.concat_ws("\t", F.col("vertex_id").cast("string"), F.lit("0"), "sinks").alias("value"))
    end = s.subgraphs.select("subgraph_id", F.lit(2).alias("kind"), F.lit(0).cast("long").alias("at"), F.lit("SG_END").alias("value"))
    return head.unionByName(body).unionByName(end)


def write_lines(lines: DataFrame, path: str, by_partition: bool = False) -> None:
    """Lines (partition_id, value) as text files; by_partition gives each partition a folder, partition_id=N."""
    if by_partition:
        lines.repartition("partition_id").write.partitionBy("partition_id").text(path)
    else:
        lines.select("value").write.text(path)


def write_tables(graph: Graph, path: str) -> None:
    graph.vertices.write.parquet(f"{path}/vertices.parquet")
    graph.numbered_edges.write.parquet(f"{path}/edges.parquet")


def write_rows(rows: DataFrame, path: str, separator: str = "\t") -> None:
    """Any result as lines of its columns."""
    rows.select(F.concat_ws(separator, *[F.col(c).cast("string") for c in rows.columns]).alias("value")).write.text(path)
