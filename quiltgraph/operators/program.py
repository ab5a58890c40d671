"""User programs: compute() is called for a subgraph in each superstep until all have voted to halt and no message is
under way.

compute() sees one whole subgraph and its messages in memory, in a Python worker. Analytics that can be written as
joins and aggregations should be; see analytics.py.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltgraph.operators.subgraphs import Subgraphs
from quiltgraph.plans.loop import materialise_observed
from quiltgraph.plans.storage import materialise

#: Vertices, stubs and edges of a subgraph that a Python worker can hold; more is an error, not a lost executor.
MAX_ELEMENTS = 20_000_000

SCHEMA = "kind string, subgraph_id long, payload string, halted boolean"


@dataclass
class Context:
    """A subgraph within a superstep. value is what it keeps; it and all messages are what JSON can hold."""

    subgraph_id: int
    partition_id: int
    superstep: int
    initial: Any
    vertices: list[int]
    edges: list[tuple[int, int]]
    remote: list[tuple[int, int]]  # vertex, owner subgraph
    neighbors: list[int]
    value: Any = None
    halted: bool = False
    out: list[tuple[str, int, Any]] = field(default_factory=list)

    def send(self, subgraph_id: int, message: Any) -> None:
        self.out.append(("to", subgraph_id, message))

    def send_to_neighbors(self, message: Any) -> None:
        for n in self.neighbors:
            self.send(n, message)

    def send_to_all(self, message: Any) -> None:
        self.out.append(("all", self.subgraph_id, message))

    def send_to_vertex(self, vertex_id: int, message: Any) -> None:
        self.out.append(("vertex", vertex_id, message))

    def vote_to_halt(self) -> None:
        self.halted = True


Compute = Callable[[Context, list[Any]], None]


def structures(s: Subgraphs) -> DataFrame:
    """A row for each subgraph with its vertices, edges, stubs and out-neighbours as arrays."""
    local = s.vertex_subgraph.groupBy("subgraph_id", "partition_id").agg(F.sort_array(F.collect_list("vertex_id")).alias("vertices"))
    edges = s.edges.groupBy("subgraph_id").agg(F.sort_array(F.collect_list(F.struct("src", "dst"))).alias("edges"))
    remote = s.remote_vertices.groupBy("subgraph_id").agg(F.sort_array(F.collect_list(F.struct("vertex_id", "owner_subgraph_id"))).alias("remote"))
    near = s.meta_edges.groupBy(F.col("src_sg").alias("subgraph_id")).agg(F.sort_array(F.collect_list("dst_sg")).alias("neighbors"))
    return local.join(edges, "subgraph_id", "left").join(remote, "subgraph_id", "left").join(near, "subgraph_id", "left")


def _caller(compute: Compute, superstep: int, initial: Any):
    """The function of a superstep for a subgraph's row and its messages."""

    def call(left, right):
        import pandas as pd

        columns = ["kind", "subgraph_id", "payload", "halted"]
        if not len(left):  # messages to a subgraph that doesn't exist
            return pd.DataFrame([], columns=columns)
        row = left.iloc[0]
        seq = lambda x: [] if x is None else list(x)
        vertices, near = [int(v) for v in seq(row["vertices"])], [int(n) for n in seq(row["neighbors"])]
        edges = [(int(e["src"]), int(e["dst"])) for e in seq(row["edges"])]
        remote = [(int(r["vertex_id"]), int(r["owner_subgraph_id"])) for r in seq(row["remote"])]
        context = Context(int(row["subgraph_id"]), int(row["partition_id"]), superstep, initial, vertices, edges, remote, near, json.loads(row["payload"]))
        compute(context, [json.loads(m) for m in sorted(right["message"])])
        rows = [("state", context.subgraph_id, json.dumps(context.value), context.halted)]
        return pd.DataFrame(rows + [(kind, int(to), json.dumps(m), None) for kind, to, m in context.out], columns=columns)

    return call


def run_program(s: Subgraphs, compute: Compute, initial: Any = None, max_supersteps: int | None = None) -> tuple[DataFrame, list[dict]]:
    """((subgraph_id, value as JSON), a metrics row for each superstep).

    A subgraph that voted to halt is only called again when it has a message, and must vote anew. Messages come
    sorted by their JSON. Reaching max_supersteps (default: no limit) is an error, and so is a subgraph of more than
    MAX_ELEMENTS vertices, stubs and edges.
    """
    large = s.subgraphs.where(F.col("n_local") + F.col("n_remote") + F.col("n_edges") > MAX_ELEMENTS).select("subgraph_id").first()
    if large:
        raise ValueError(f"subgraph {large[0]} has more than {MAX_ELEMENTS} vertices, stubs and edges, which compute() would get in one worker; use the table forms or more partitions")
    held = materialise(structures(s), "structures")
    state = s.subgraphs.select("subgraph_id", F.lit("null").alias("payload"), F.lit(False).alias("halted"))
    mail = state.select(F.col("subgraph_id").alias("dst"), F.col("payload").alias("message")).limit(0)
    number, metrics = 0, []
    while True:
        if max_supersteps is not None and number >= max_supersteps:
            raise RuntimeError(f"the program did not halt in {max_supersteps} supersteps")
        awake = mail.select(F.col("dst").alias("subgraph_id")).distinct().withColumn("called", F.lit(True))
        marked = state.join(awake, "subgraph_id", "left").withColumn("called", F.coalesce("called", F.lit(False)) | ~F.col("halted"))
        active = held.join(marked.where("called").select("subgraph_id", "payload"), "subgraph_id")
        out = active.groupBy("subgraph_id").cogroup(mail.groupBy("dst")).applyInPandas(_caller(compute, number, initial), SCHEMA)
        quiet = marked.where("not called").select(F.lit("state").alias("kind"), "subgraph_id", "payload", "halted")
        result, row = materialise_observed(out.unionByName(quiet), "program", running=F.count_if((F.col("kind") == "state") & ~F.col("halted")), messages=F.count_if(F.col("kind") != "state"))
        metrics.append({"superstep": number, **row.asDict()})
        state = result.where("kind = 'state'").select("subgraph_id", "payload", "halted")
        sent = result.where("kind = 'to'").select(F.col("subgraph_id").alias("dst"), F.col("payload").alias("message"))
        to_all = result.where("kind = 'all'").select(F.col("payload").alias("message"))
        to_all = s.subgraphs.select(F.col("subgraph_id").alias("dst")).join(to_all)
        to_vertex = result.where("kind = 'vertex'").select(F.col("subgraph_id").alias("vertex_id"), F.col("payload").alias("message")).join(s.vertex_subgraph, "vertex_id").select(F.col("subgraph_id").alias("dst"), "message")
        mail = sent.unionByName(to_all).unionByName(to_vertex)
        number += 1
        if not row["running"] and not row["messages"]:
            return state.select("subgraph_id", F.col("payload").alias("value")), metrics


# -- two analytics as programs, to compare with their table forms


def vertex_count_program(context: Context, messages: list[int]) -> None:
    if context.superstep == 0:
        context.send_to_all(len(context.vertices))
    else:
        context.value = sum(messages)
        context.vote_to_halt()


def min_label_program(context: Context, messages: list[int]) -> None:
    if context.superstep == 0:
        context.value = min([context.subgraph_id, *context.neighbors])
        context.send_to_neighbors(context.value)
    elif messages and min(messages) < context.value:
        context.value = min(messages)
        context.send_to_neighbors(context.value)
    context.vote_to_halt()
