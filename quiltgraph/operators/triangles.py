"""Triangles by colours of vertices, so that only edges are shuffled and never pairs of them.

Vertices have one of ``colours`` colours, by their id, and each three colours (repeats allowed) are a task, to which all edges between
them go. A triangle is found in the task of its vertices' colours alone. Edges point from the end of smaller degree to the other,
so no vertex, however many edges it has, brings more than about the square root of twice the edges as partners.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations_with_replacement

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltgraph.operators.neighbours import dealt, part_of, rows_of, undealt

#: Edges, about, that a task of three colours has; edges that a task points; pairs of edges looked up at once.
TASK_EDGES, POINTED_EDGES, PAIRS = 16_000_000, 4_000_000, 2_000_000
MAX_COLOURS = 128


def _known(table: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Which of the wanted numbers a sorted table has."""
    if not len(table):
        return np.zeros(len(wanted), bool)
    at = np.searchsorted(table, wanted)
    at[at == len(table)] = 0
    return table[at] == wanted


def _small(ids: np.ndarray) -> np.ndarray:
    """The ids in half the room, where they fit."""
    return ids.astype(np.int32) if ids.min() >= 0 and ids.max() < 1 << 31 else ids


class _Three:
    """The edges between three colours."""

    def __init__(self, cells: dict[tuple[int, int], list[list[np.ndarray]]]):
        self.cells = {}
        for key in list(cells):
            held = cells.pop(key)
            self.cells[key] = tuple(np.concatenate([h[i] for h in held]) for i in (0, 1))
        self.ids = None
        ends = [x for cell in self.cells.values() for x in cell if len(x)]
        least, most = min(int(x.min()) for x in ends), max(int(x.max()) for x in ends)
        if least < 0 or most >= 1 << 31:
            self.ids = np.unique(np.concatenate(ends))
            self.cells = {k: tuple(np.searchsorted(self.ids, x) for x in cell) for k, cell in self.cells.items()}
            most = len(self.ids) - 1
        self.span = most + 1

    def _cell(self, x: int, y: int) -> tuple[np.ndarray, np.ndarray]:
        none = np.zeros(0, np.int64)
        return tuple(c.astype(np.int64) for c in self.cells.get((x, y), (none, none)))

    def _closing(self, y: int, z: int) -> np.ndarray:
        """Numbers of the edges between y and z, the end in y first; of those within y, both directions."""
        (a, b), (c, d) = self._cell(y, z), self._cell(z, y)
        return np.sort(np.r_[a * self.span + b, d * self.span + c])

    def triangles(self, x: int, y: int, z: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Triangles whose vertex of least degree is in x, and whose others are in y and z."""
        s, t = self._cell(x, y)
        key = np.sort(s * self.span + t)
        s, t = key // self.span, key % self.span
        if y == z:
            w, lo, hi = t, np.arange(1, len(s) + 1), np.searchsorted(s, s, "right")
        else:
            from_, w = self._cell(x, z)
            other = np.sort(from_ * self.span + w)
            from_, w = other // self.span, other % self.span
            lo, hi = np.searchsorted(from_, s, "left"), np.searchsorted(from_, s, "right")
        some = hi > lo
        s, t, lo, n = s[some], t[some], lo[some], (hi - lo)[some]
        if not len(s):
            return
        closing = self._closing(y, z)
        order = np.argsort(t, kind="stable")
        s, t, lo, n = s[order], t[order], lo[order], n[order]
        through, at = np.cumsum(n), 0
        while at < len(s):
            done = through[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(through, done + PAIRS, "right")))
            k = n[at:to]
            edge = np.repeat(np.arange(at, to), k)
            third = w[np.arange(len(edge)) + np.repeat(lo[at:to] - (np.cumsum(k) - k), k)]
            found = _known(closing, t[edge] * self.span + third)
            edge, third = edge[found], third[found]
            out = s[edge], t[edge], third
            yield tuple(self.ids[c] for c in out) if self.ids is not None else out
            at = to


def _number(colours: int) -> dict[tuple[int, ...], int]:
    return {three: i for i, three in enumerate(combinations_with_replacement(range(colours), 3))}


def _find(colours: int, valued: bool):  # noqa: ANN202
    threes = list(combinations_with_replacement(range(colours), 3))

    def batches_of(three: tuple[int, ...], cells: dict, values: list) -> Iterator[pa.RecordBatch]:
        held = _Three(cells)
        if valued:
            vertex = np.concatenate([v[0] for v in values])
            order = np.argsort(vertex)
            vertex, value = vertex[order], np.concatenate([v[1] for v in values])[order]
        for x in sorted(set(three)):
            rest = list(three)
            rest.remove(x)
            y, z = rest
            for p, q, r in held.triangles(x, y, z):
                low, high = np.minimum(p, q), np.maximum(p, q)
                columns = [np.minimum(low, r), np.maximum(low, np.minimum(high, r)), np.maximum(high, r)]
                columns += [value[np.searchsorted(vertex, c)] for c in columns] if valued else []
                for i in range(0, len(p), 1 << 18):
                    yield pa.RecordBatch.from_arrays([pa.array(c[i : i + (1 << 18)]) for c in columns], names)

    names = ["a", "b", "c"] + ["va", "vb", "vc"] * valued

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cells, values = None, {}, []
        for batch in batches:
            for three, x, y, width, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if three != now:
                    if cells:
                        yield from batches_of(threes[now], cells, values)
                    now, cells, values = three, {}, []
                if y < 0:
                    values.append(undealt(width, data, 2))
                else:
                    cells.setdefault((x, y), []).append([_small(c) for c in undealt(width, data, 2)])
        if cells:
            yield from batches_of(threes[now], cells, values)

    return run


def _numbers_of_sinks(tasks: int):  # noqa: ANN202
    """Neighbours to rows (vertex, neighbour with a smaller id, its degree), and (vertex, vertex, degree), dealt by the vertex."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vertex, counts, sinks = rows_of(batch)
            if not len(vertex):
                continue
            row = np.repeat(np.arange(len(vertex)), counts)
            up = sinks > vertex[row]
            at, near, n = np.r_[sinks[up], vertex], np.r_[vertex[row[up]], vertex], np.r_[counts[row[up]], counts].astype(np.int64)
            part, widths, data = dealt(part_of(at, tasks), at, near)
            _, degree_widths, degrees = dealt(part_of(at, tasks), n)
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(widths, pa.int32()), pa.array(data, pa.binary()), pa.array(degree_widths, pa.int32()), pa.array(degrees, pa.binary())], ["part", "width", "data", "degree_width", "degrees"])

    return run


def _tasks_of(colours: int) -> list[list[list[int]]]:
    number = _number(colours)
    return [[sorted({number[tuple(sorted((x, y, z)))] for z in range(colours)}) for y in range(colours)] for x in range(colours)]


_CELLS = ["threes", "x", "y", "width", "data"]


def _cells(cell: np.ndarray, colours: int, tasks: list[list[list[int]]], *columns: np.ndarray) -> pa.RecordBatch:
    own, widths, data = dealt(cell, *columns)
    xs, ys = [c // colours for c in own], [c % colours for c in own]
    return pa.RecordBatch.from_arrays([pa.array([tasks[x][y] for x, y in zip(xs, ys, strict=True)], pa.list_(pa.int32())), *(pa.array(c, pa.int32()) for c in (xs, ys, widths)), pa.array(data, pa.binary())], _CELLS)


def _pointed(colours: int):  # noqa: ANN202
    tasks = _tasks_of(colours)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(*undealt(w, d, 2), *undealt(v, e, 1)) for b in batches for w, d, v, e in zip(*(b.column(i).to_pylist() for i in (1, 2, 3, 4)), strict=True)]
        if not held:
            return
        at, near, n = (np.concatenate([h[i] for h in held]) for i in range(3))
        held.clear()
        self_ = at == near
        order = np.argsort(at[self_])
        own, degree = at[self_][order], n[self_][order]
        at, near, n = at[~self_], near[~self_], n[~self_]
        if not len(at):
            return
        # near is the smaller id, so it points at a vertex of the same degree
        points = n <= degree[np.searchsorted(own, at)]
        s, t = np.where(points, near, at), np.where(points, at, near)
        yield _cells(part_of(s, colours) * np.uint16(colours) + part_of(t, colours), colours, tasks, s, t)

    return run


def _valued_vertices(colours: int):  # noqa: ANN202
    number = _number(colours)
    tasks = [sorted({i for three, i in number.items() if c in three}) for c in range(colours)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                vertex, value = batch.column(0).to_numpy(), batch.column(1).to_numpy()
                own, widths, data = dealt(part_of(vertex, colours), vertex, value)
                yield pa.RecordBatch.from_arrays([pa.array([tasks[c] for c in own], pa.list_(pa.int32())), pa.array(own, pa.int32()), pa.array([-1] * len(own), pa.int32()), pa.array(widths, pa.int32()), pa.array(data, pa.binary())], _CELLS)

    return run


def find(neighbours: DataFrame, values: DataFrame | None = None) -> DataFrame:
    """(a, b, c) with a < b < c, once for each triangle of a table of neighbours; with values (vertex_id, value) of all vertices,
    longs, also those of the three: va, vb, vc.

    The number of colours follows the edges, so that a task's memory stays the same; each edge is sent once a colour.
    """
    spark = neighbours.sparkSession
    edges = (neighbours.agg(F.sum(F.size("sinks").cast("long"))).first()[0] or 0) // 2
    tasks = min(1 << 16, max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-edges // POINTED_EDGES)))
    colours = 1
    while colours < MAX_COLOURS and (6 * edges > TASK_EDGES * colours**2 or len(_number(colours)) < min(tasks, edges // 100_000)):
        colours += 1
    cells = "threes array<int>, x int, y int, width int, data binary"
    met = neighbours.mapInArrow(_numbers_of_sinks(tasks), "part int, width int, data binary, degree_width int, degrees binary").repartitionById(tasks, "part")
    sent = met.mapInArrow(_pointed(colours), cells)
    if values is not None:
        sent = sent.unionByName(values.select("vertex_id", "value").mapInArrow(_valued_vertices(colours), cells))
    three = sent.select(F.explode("threes").alias("three"), "x", "y", "width", "data").repartitionById(len(_number(colours)), "three")
    return three.mapInArrow(_find(colours, values is not None), "a bigint, b bigint, c bigint" + ", va bigint, vb bigint, vc bigint" * (values is not None))
