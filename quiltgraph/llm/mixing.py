"""Mixing of sources to target weights by Pfair scheduling, in built-in DataFrame functions only.

Documents of a source are ordered by a hash and cut into blocks. While all sources last, a source of weight w
(of all weights' sum) is due w * t blocks by slot t; when one is used up, the others share its weight in
proportion. Block j of a source may run from the slot in which more than j blocks are due, and must have run by the slot
at which j + 1 are; among the blocks that may run, the one with the earliest deadline does. What is due grows by
one block a slot in all, so no deadline is missed, and at any slot each source has had what it is due by less than one
block, however long the schedule is.

No document is dropped or repeated. The schedule is computed on the driver from the number of documents of each
source; documents meet it in a join of (source, part of its blocks), so its size is that of the blocks, not of the rows.
"""

from __future__ import annotations

import heapq
from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from quiltgraph.llm.common import free_name

#: Documents of a source that follow each other, at least.
BLOCK_DOCS = 8
#: Blocks, about, from which on blocks grow with the table, so that the driver's schedule doesn't.
MAX_BLOCKS = 1 << 21
#: Slots of a phase, by which a reader may take the mix in portions.
PERIOD = 1024
#: Blocks of a source whose slots are one row of the schedule.
CHUNK = 1024
#: Rows of the schedule up to which it is broadcast: at most CHUNK slots of four bytes and a source's name each.
BROADCAST_ROWS = 1 << 12
#: Parts of a source that are ordered apart, so that a large source isn't sorted in one task.
PARTS = 4096
#: Weight of a source without a given weight: its documents to this power.
TEMPERATURE = 0.5
#: Windows are narrowed by this share of a slot against rounding, so that a deviation of exactly one block counts as too much.
ROUNDING = 1e-6


def windows(blocks: list[int], weights: list[float]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The source, first slot and deadline of each block, source by source."""
    n, w = np.array(blocks, np.int64), np.array(weights, np.float64)
    n, w = n[n > 0], w[n > 0] / w[n > 0].sum()
    used_up = n / w  # in time that passes w blocks of each source that is left
    order = np.argsort(used_up, kind="stable")
    left = np.concatenate([np.cumsum(w[order][::-1])[::-1][1:], [0.0]])
    times = np.concatenate([[0.0], used_up[order]])
    slots = np.concatenate([[0.0], np.cumsum(n[order]) + used_up[order] * left])
    owner = np.repeat(np.arange(len(n)), n)
    j = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
    release = np.floor(np.interp(j / w[owner], times, slots) + ROUNDING).astype(np.int64)
    deadline = np.ceil(np.interp((j + 1) / w[owner], times, slots) - ROUNDING).astype(np.int64)
    return np.flatnonzero(np.array(blocks, np.int64) > 0)[owner], release, deadline


def pfair_order(blocks: list[int], weights: list[float]) -> list[int]:
    """The source of each of the sum(blocks) slots, by earliest deadline among released blocks; ties go to the
    source listed first."""
    if not any(blocks):
        return []
    owner, release, deadline = windows(blocks, weights)
    turn = np.lexsort((owner, deadline))
    rank = np.empty(len(turn), np.int64)
    rank[turn] = np.arange(len(turn))
    by_release = np.argsort(release, kind="stable")
    due, ranks, owners = release[by_release].tolist(), rank[by_release].tolist(), owner[turn].tolist()
    ready: list[int] = []
    out, k = [], 0
    for slot in range(len(due)):
        while k < len(due) and (due[k] <= slot or not ready):
            heapq.heappush(ready, ranks[k])
            k += 1
        out.append(owners[heapq.heappop(ready)])
    return out


def pfair_period(quotas: list[int]) -> list[int]:
    """The source of each slot of a period in which each source has its quota; the quotas are the weights."""
    return pfair_order(quotas, [float(q) for q in quotas])


def phases(blocks: list[int], weights: list[float], period: int = PERIOD) -> list[dict]:
    """The schedule that uses up all blocks, in phases of ``period`` slots: first slot, slots of the phase, how often
    it runs (once), and by source the first block, the number of its blocks and their slots in the phase."""
    order, begun, out = pfair_order(blocks, weights), [0] * len(blocks), []
    for slot in range(0, len(order), period):
        at: dict[int, list[int]] = {}
        for k, which in enumerate(order[slot : slot + period]):
            at.setdefault(which, []).append(k)
        out.append({"slot": slot, "period": min(period, len(order) - slot), "periods": 1, "sources": {i: (begun[i], len(s), s) for i, s in sorted(at.items())}})
        for i, s in at.items():
            begun[i] += len(s)
    return out


def mix_sources(docs: DataFrame, weights: Mapping[str | None, float] | None = None, id_col: str = "doc_id", source_col: str = "source", block_docs: int | None = None, period: int = PERIOD, temperature: float = TEMPERATURE) -> DataFrame:
    """docs with three more columns: mix_phase, mix_slot (the block's slot) and mix_position (from 0, gapless
    within a slot's block; slot * block_docs + place), by which the mixed order is read.

    weights: of each source, relative; a source without one gets its number of documents to the power
    ``temperature``; a weight that isn't positive is an error. Null sources are a source of their own.
    block_docs: by default BLOCK_DOCS, or as many as keep the schedule at about MAX_BLOCKS blocks. Documents are
    ordered by the MD5 of their id, then the id; repeated ids and null ids are kept, each row in a place of
    its own (null ids, which share a digest, are spread over tasks by a hash of the columns of numbers). All columns of docs stay, and
    those that aren't used later aren't read; where one has the name of a new column, the new one gets
    underscores before it. An empty table gives an empty result; long texts are only carried along. The driver holds a
    number for each block and a row for each source, of which there may be any number.
    """
    spark = docs.sparkSession
    sizes = docs.groupBy(docs[source_col].cast("string").alias("source")).count().orderBy("source").collect()  # a row a source
    names = [r["source"] for r in sizes]
    given = dict(weights or {})
    wanted = [float(given.get(n, r["count"] ** temperature)) for n, r in zip(names, sizes, strict=True)]
    if any(not 0 < w < float("inf") for w in wanted):
        raise ValueError("weights must be positive")
    block_docs = block_docs or max(BLOCK_DOCS, -(-sum(r["count"] for r in sizes) // MAX_BLOCKS))
    slots: list[list[int]] = [[] for _ in names]
    for p in phases([-(-r["count"] // block_docs) for r in sizes], wanted, period):
        for i, (_, _, own) in p["sources"].items():
            slots[i] += [p["slot"] + s for s in own]
    rows = [("null" if n is None else f"={n}", c // CHUNK, own[c : c + CHUNK]) for n, own in zip(names, slots, strict=True) for c in range(0, len(own), CHUNK)]
    schedule = spark.createDataFrame(rows, "_mix_source string, _mix_chunk bigint, _mix_slots array<int>", verifySchema=False)
    if len(rows) <= BROADCAST_ROWS:
        schedule = F.broadcast(schedule)

    phase_col, slot_col, position_col = (free_name(docs, c) for c in ("mix_phase", "mix_slot", "mix_position"))
    # docs' columns one by one, under names that can't clash, so that unused ones are pruned
    own = {c: f"_mix_of_{i}" for i, c in enumerate(docs.columns)}
    # not null, so that the window's partitioning serves the join as well
    name = F.coalesce(F.concat(F.lit("="), docs[source_col].cast("string")), F.lit("null"))
    number, none = docs[id_col].cast("string"), F.md5(F.lit("").cast("binary"))
    key = F.md5(F.coalesce(number, F.lit("")).cast("binary"))
    numbers = [id_col, *[f.name for f in docs.schema if isinstance(f.dataType, NumericType)]]
    spread = F.when(number.isNull(), 1 + F.pmod(F.xxhash64(*[docs[f"`{c}`"] for c in numbers]), F.lit(PARTS))).when(key > none, F.lit(PARTS + 1)).otherwise(F.lit(0))
    held = docs.select(*[docs[f"`{c}`"].alias(o) for c, o in own.items()], name.alias("_mix_source"), key.alias("_mix_key"), spread.cast("int").alias("_mix_spread"))
    held = held.withColumn("_mix_part", F.conv(F.substring("_mix_key", 1, 3), 16, 10).cast("int"))
    part = ["_mix_source", "_mix_part", "_mix_spread"]
    counts = held.groupBy(*part).agg(F.count(F.lit(1)).alias("_mix_n"))
    before = Window.partitionBy("_mix_source").orderBy("_mix_part", "_mix_spread").rowsBetween(Window.unboundedPreceding, -1)
    # at most 2 * PARTS rows a source besides those of null ids, with one number each
    counts = counts.withColumn("_mix_before", F.coalesce(F.sum("_mix_n").over(before), F.lit(0))).drop("_mix_n")
    place = F.row_number().over(Window.partitionBy(*part).orderBy("_mix_key", own[id_col]))
    rank = F.col("_mix_before") + F.col("_mix_place") - 1
    held = held.withColumn("_mix_place", place).join(counts, part).withColumn("_mix_rank", rank)
    held = held.withColumn("_mix_block", F.floor(F.col("_mix_rank") / block_docs)).withColumn("_mix_chunk", F.floor(F.col("_mix_block") / CHUNK))
    held = held.join(schedule, ["_mix_source", "_mix_chunk"])
    slot = F.get("_mix_slots", F.pmod("_mix_block", F.lit(CHUNK)).cast("int")).cast("long")
    held = held.withColumn("_mix_slot_of", slot)
    position = F.col("_mix_slot_of") * block_docs + F.pmod("_mix_rank", F.lit(block_docs))
    return held.select(*[F.col(o).alias(c) for c, o in own.items()], F.floor(F.col("_mix_slot_of") / period).cast("int").alias(phase_col), F.col("_mix_slot_of").alias(slot_col), position.alias(position_col))
