"""The superstep loop: a table is replaced by a step's result until a test says stop."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, Row

from quiltgraph.plans.storage import materialise


def materialise_observed(df: DataFrame, what: str, **figures: Column) -> tuple[DataFrame, Row]:
    """Writes and rereads df; the figures, aggregates over its rows, come from the same job."""
    seen = Observation()
    held = materialise(df.observe(seen, *[c.alias(k) for k, c in figures.items()]), what)
    return held, Row(**seen.get)


@dataclass
class Run:
    """The last table of a loop and a metrics row for each superstep."""

    table: DataFrame
    supersteps: list[dict] = field(default_factory=list)


def supersteps(start: DataFrame, step: Callable[[DataFrame, int], DataFrame], stop: Callable[[Row], bool], figures: dict[str, Column], what: str, max_supersteps: int | None = None) -> Run:
    """Runs step(table, superstep) until stop(figures of the result) holds. One job a superstep; each result
    is written to the shared folder, so lineage is one step long. Reaching max_supersteps (default: no
    limit) before that is an error, never a cut result."""
    run, number = Run(start), 0
    while True:
        if max_supersteps is not None and number >= max_supersteps:
            raise RuntimeError(f"{what} did not finish in {max_supersteps} supersteps")
        run.table, row = materialise_observed(step(run.table, number), what, **figures)
        run.supersteps.append({"superstep": number, **row.asDict()})
        number += 1
        if stop(row):
            return run
