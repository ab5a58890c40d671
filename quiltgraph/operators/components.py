"""Connected components of an edge table by alternating large-star and small-star contraction."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F

from quiltgraph.operators.forest import forests
from quiltgraph.plans.loop import materialise_observed
from quiltgraph.plans.storage import materialise

#: Edges up to which one task finishes the components; more are contracted in rounds over all tasks.
ONE_TASK_EDGES = 100_000
#: The same for nodes that are longs, which are united in arrays.
ONE_TASK_LONGS = 8_000_000
#: Tasks whose forests one task of the next round unites.
MERGED_TASKS = 8


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u")
    return moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v")))


def _union_find(pairs: Iterator[tuple[Any, Any]]) -> dict[Any, Any]:
    """Every node that isn't the smallest of its set, with that one."""
    parent: dict[Any, Any] = {}

    def find(x: Any) -> Any:
        while (p := parent.get(x, x)) != x:
            parent[x] = x = parent.get(p, p)
        return x

    for u, v in pairs:
        a, b = find(u), find(v)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def _in_one_task(edges: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, fields = None, None
        plain = lambda x: tuple(x.values()) if isinstance(x, dict) else x

        def pairs() -> Iterator[tuple[Any, Any]]:
            nonlocal kind, fields
            for b in batches:
                kind = b.schema.field(0).type
                fields = [f.name for f in kind] if pa.types.is_struct(kind) else None
                for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    yield plain(u), plain(v)

        found = _union_find(pairs())
        if found:
            back = (lambda xs: [dict(zip(fields, x, strict=True)) for x in xs]) if fields else list
            yield pa.RecordBatch.from_arrays([pa.array(back(found), kind), pa.array(back(found.values()), kind)], ["u", "v"])

    return edges.coalesce(1).mapInArrow(run, edges.schema)


def contract(edges: DataFrame) -> DataFrame:
    """(u, v) for an edge table (u, v): every node that isn't the smallest of its component, with that
    smallest node. Loops and repeated edges are allowed; edges with a null end are dropped; nodes are of
    any orderable type. Every round is one job, written to the shared folder, so lineage stays one round long
    and nothing but a count and a checksum reaches the driver. Once no more than ONE_TASK_EDGES are left, one task
    finishes.

    Nodes that are longs go through forests first: each task keeps a forest of its edges, and as long as that takes away a third
    of the edges, a round unites the forests of several tasks."""
    if [t for _, t in edges.select("u", "v").dtypes] == ["bigint", "bigint"]:
        return _contract_longs(edges)
    figures = {"n": F.count(F.lit(1)), "mark": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}
    start = edges.select("u", "v").where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    kept, now = materialise_observed(start, "components", **figures)
    return _star_rounds(kept, now, figures)


def _contract_longs(edges: DataFrame) -> DataFrame:
    figures = {"n": F.count(F.lit(1)), "mark": F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))}
    united = lambda df: df.mapInArrow(forests, "u bigint, v bigint")
    kept, now = materialise_observed(united(edges.select("u", "v").where("u <> v")), "components", **figures)
    while min(ONE_TASK_EDGES, now["n"]) and now["n"] > ONE_TASK_LONGS:
        tasks = kept.rdd.getNumPartitions()
        if tasks == 1:
            break
        before = now["n"]
        kept, now = materialise_observed(united(kept.coalesce(-(-tasks // MERGED_TASKS))), "components", **figures)
        if 3 * now["n"] > 2 * before:
            break
    if ONE_TASK_EDGES and now["n"] <= ONE_TASK_LONGS:
        return materialise(united(kept.coalesce(1)), "components") if now["n"] else kept
    return _star_rounds(kept.distinct(), now, figures)


def _star_rounds(kept: DataFrame, now: Row, figures: dict[str, Column]) -> DataFrame:
    while now["n"]:
        if now["n"] <= ONE_TASK_EDGES:
            return materialise(_in_one_task(kept), "components")
        before = now
        kept, now = materialise_observed(_small_star(_large_star(kept)).distinct(), "components", **figures)
        if now == before:
            break
    return kept
