"""Messages between subgraphs: tables with the receiver in dst_sg, delivered in the next superstep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltgraph.operators.subgraphs import Subgraphs


def send(messages: DataFrame, s: Subgraphs) -> DataFrame:
    """Messages (dst_sg, payload columns) whose receiver exists."""
    return messages.join(s.subgraphs.select(F.col("subgraph_id").alias("dst_sg")), "dst_sg", "left_semi")


def send_to_neighbors(out: DataFrame, s: Subgraphs) -> DataFrame:
    """out (src_sg, payload columns), one message to each distinct out-neighbour of the sender."""
    return out.join(s.meta_edges.select("src_sg", "dst_sg"), "src_sg")


def send_to_all(out: DataFrame, s: Subgraphs) -> DataFrame:
    """out (src_sg, payload columns), one message to every subgraph, the sender too. That is messages times subgraphs
    rows; where receivers only fold what they get, use ``reduce_all``."""
    return out.join(s.subgraphs.select(F.col("subgraph_id").alias("dst_sg")))


def reduce_all(out: DataFrame, s: Subgraphs, **figures: Column) -> DataFrame:
    """What every subgraph would have after folding the messages of all: (dst_sg, figures), from one aggregation."""
    return s.subgraphs.select(F.col("subgraph_id").alias("dst_sg")).join(F.broadcast(out.agg(*[c.alias(k) for k, c in figures.items()])))


def send_to_vertex(messages: DataFrame, s: Subgraphs) -> DataFrame:
    """Messages (vertex_id, payload columns), to the subgraph in which the vertex is local."""
    return messages.join(s.vertex_subgraph.select("vertex_id", F.col("subgraph_id").alias("dst_sg")), "vertex_id")


def send_batch(batches: DataFrame, payloads: str) -> DataFrame:
    """Rows with an array of payloads, as one row for each; then sent by any of the above."""
    return batches.withColumn(payloads, F.explode(payloads))


def fold(messages: DataFrame, **figures: Column) -> DataFrame:
    """What each receiver has after folding its messages: (dst_sg, figures). Senders' tasks fold first, and no inbox is gathered."""
    return messages.groupBy("dst_sg").agg(*[c.alias(k) for k, c in figures.items()])


def inbox(messages: DataFrame) -> DataFrame:
    """(dst_sg, messages): what each receiver gets, as an array of structs in a fixed order."""
    rest = [c for c in messages.columns if c != "dst_sg"]
    return messages.groupBy("dst_sg").agg(F.sort_array(F.collect_list(F.struct(*rest))).alias("messages"))
