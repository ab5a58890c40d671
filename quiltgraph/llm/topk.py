"""Exact top-k search by inner product with distributed histogram selection.

Every query of a block is scored against all rows, several times over: each pass counts, by query, how
many scores fall into each of a few bins of the range that still holds the kth score, and the next pass
divides the bin found. When bins are one wide, the kth score is known; a last pass keeps the
scores above it and, of those equal to it, the ones with the smallest ids. A partition sends bins
from its best score down to its own kth only, since the kth of all is never below that.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quiltgraph.llm.common import materialise

#: Queries that are scored in one scan of the table; bounds what is broadcast and held.
QUERY_BLOCK = 32_768
BINS = 64
#: Queries and candidates whose scores are held at once.
CHUNK = (512, 4096)

#: Components and scores are held as longs; what is beyond stays at the bound.
LIMIT = 2**63 - 1
SIGN = np.uint64(1 << 63)


def to_integers(values: np.ndarray, scale: float) -> np.ndarray:
    """floor(scale * x) as long; beyond that range it stays at the bound."""
    with np.errstate(over="ignore"):
        whole = np.floor(values.astype(np.float64) * scale)
    out = np.where(np.abs(whole) < 2.0**63, whole, 0).astype(np.int64)
    out[whole >= 2.0**63] = LIMIT
    out[whole <= -(2.0**63)] = -LIMIT
    return out


def ordered(scores: np.ndarray) -> np.ndarray:
    """Longs as unsigned numbers of the same order, whose differences never overflow."""
    return scores.view(np.uint64) ^ SIGN


def vectors(batch: pa.RecordBatch, scale: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(ids, integer matrix) by dimension, of the rows (id, vector) that take part."""
    ids, column = batch.column(0), batch.column(1)
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    kept = np.asarray(ids.is_valid()) & np.asarray(column.is_valid())
    sizes = np.diff(np.asarray(column.offsets))
    flat = column.values
    whole = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # null: NaN
    good = np.isfinite(whole)
    starts = np.asarray(column.offsets)[:-1]
    bad = np.concatenate([[0], np.cumsum(~good)])
    kept &= bad[starts + sizes] == bad[starts]
    numbers = ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    for dim in np.unique(sizes[kept]):
        rows = np.flatnonzero(kept & (sizes == dim))
        at = starts[rows][:, None] + np.arange(dim)[None, :]
        yield numbers[rows], to_integers(whole[at].reshape(len(rows), dim), scale)


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products as longs: exact, in the cheapest type that holds them; beyond the range of a long, at its bound."""
    tame = 3.0e9 / max(1, queries.shape[1]) ** 0.5  # two of such components' products add up to less than 2 ** 63
    small_q, small_r = (np.abs(x.astype(np.float64)).max(axis=1, initial=0) < tame for x in (queries, rows))
    if small_q.all() and small_r.all():
        return _tame_products(queries, rows)
    out = np.empty((len(queries), len(rows)), np.int64)
    out[np.ix_(small_q, small_r)] = _tame_products(queries[small_q], rows[small_r])
    for q, r in ((~small_q, np.ones(len(rows), bool)), (small_q, ~small_r)):
        if q.any() and r.any():
            exact = queries[q].astype(object) @ rows[r].astype(object).T
            out[np.ix_(q, r)] = np.clip(exact, -LIMIT, LIMIT).astype(np.int64)
    return out


def _tame_products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(rows).max(initial=0)) * queries.shape[1]
    for kind, limit in ((np.float32, 2.0**24), (np.float64, 2.0**53)):
        if most < limit:
            return (queries.astype(kind) @ rows.astype(kind).T).astype(np.int64)
    return queries @ rows.T


def _scores(batches: Iterator[pa.RecordBatch], scale: float, block: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """block: by dimension, (places, ids, matrix) of queries. Yields (places, row ids, scores, own), where
    own marks pairs of a query and a row of its id."""
    for batch in batches:
        for ids, matrix in vectors(batch, scale):
            if matrix.shape[1] not in block:
                continue
            places, query_ids, queries = block[matrix.shape[1]]
            for c in range(0, len(ids), CHUNK[1]):
                row_ids, rows = ids[c : c + CHUNK[1]], matrix[c : c + CHUNK[1]]
                for q in range(0, len(places), CHUNK[0]):
                    part = slice(q, q + CHUNK[0])
                    yield places[part], row_ids, products(queries[part], rows), query_ids[part][:, None] == row_ids[None, :]


def _histogram(spark, rows: DataFrame, scale: float, block, low: np.ndarray, high: np.ndarray, width: np.ndarray, need: np.ndarray) -> list:
    """For each query: the bin that holds the score of rank ``need`` from the top, and how many are above
    that bin, of scores from low to high (``ordered``). Bin b begins at low + b * width."""
    sent = spark.sparkContext.broadcast((block, low, high, width, need))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, low, high, width, need = sent.value
        counts = np.zeros((len(low), BINS), np.int64)
        for places, _, scores, own in _scores(batches, scale, block):
            scores = ordered(scores)
            q, r = np.nonzero((scores >= low[places][:, None]) & (scores <= high[places][:, None]) & ~own)
            bins = ((scores[q, r] - low[places][q]) // width[places][q]).astype(np.int64)
            counts[places] += np.bincount(q * BINS + bins, minlength=len(places) * BINS).reshape(-1, BINS)
        below = np.cumsum(counts[:, ::-1], axis=1)[:, ::-1] - counts  # above each bin, in this partition
        q, b = np.nonzero((counts > 0) & (below < need[:, None]))
        for i in range(0, len(q), 65_536):
            part = slice(i, i + 65_536)
            yield pa.RecordBatch.from_arrays([pa.array(q[part], pa.int32()), pa.array(b[part], pa.int32()), pa.array(counts[q[part], b[part]], pa.int64()), pa.array(need[q[part]], pa.int64())], ["q", "bin", "n", "need"])

    summed = rows.mapInArrow(run, "q int, bin int, n long, need long").groupBy("q", "bin", "need").agg(F.sum("n").alias("n"))
    above = F.coalesce(F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # one row for each query of the block at most
    found = summed.withColumn("above", above).where("above < need and above + n >= need").select("q", "bin", "above").collect()
    sent.destroy()
    return found


def exact_topk(df: DataFrame, is_query: Column, k: int = 20, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding", query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k rows with the highest integer inner product for every row for which ``is_query`` holds.

    Components are floor(scale * x). Returns query_id, rank (from 1), vec_id, score; ties go to the smaller
    vec_id. Rows with a null id, a null vector, or a null or non-finite component take no part; vectors
    of different lengths have no score; rows of a query's own id are not its candidates. A query id that
    occurs in several rows is asked once, with its smallest vector; repeated candidates are rows of
    their own. Components and scores beyond the range of a long stay at its bounds. Fewer than k candidates are all
    returned; an empty table gives an empty result; other columns are ignored whatever their names. Queries go in
    blocks of about ``query_block``, each with a few scans of the table that hold the block's vectors and bins; what a
    block finds is written before the next.
    """
    spark = df.sparkSession
    rows = df.select(df[id_col].cast("long").alias("vec_id"), df[vector_col].cast("array<double>").alias("vector"))
    asked = df.where(is_query).select(df[id_col].cast("long").alias("vec_id"), df[vector_col].cast("array<double>").alias("vector"))
    good = F.col("vector").isNotNull() & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    asked = asked.where(F.col("vec_id").isNotNull() & good).groupBy("vec_id").agg(F.min("vector").alias("vector"))
    asked = materialise(asked, "topk-queries")
    blocks = max(1, -(-asked.count() // query_block))
    out = None
    for b in range(blocks):
        own = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b)
        found = _block(spark, rows, own, k, scale)
        out = found if out is None else out.unionByName(found)
    return out


def _block(spark, rows: DataFrame, asked: DataFrame, k: int, scale: float) -> DataFrame:
    schema = "query_id long, vec_id long, score long"
    table = asked.toArrow()  # one block of queries
    block: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
    count = 0
    ids_at: list[int] = []
    for batch in table.combine_chunks().to_batches():
        for ids, matrix in vectors(batch, scale):
            places = np.arange(count, count + len(ids))
            count += len(ids)
            ids_at += ids.tolist()
            if matrix.shape[1] in block:
                old = block[matrix.shape[1]]
                places, ids, matrix = (np.concatenate([x, y]) for x, y in zip(old, (places, ids, matrix), strict=True))
            block[matrix.shape[1]] = places, ids, matrix
    if not count:
        return spark.createDataFrame([], schema).selectExpr("query_id", "0 as rank", "vec_id", "score")
    bound = _bound(rows, scale, block)
    low, high = (np.full(count, ordered(np.array([x], np.int64))[0]) for x in (-bound, bound))
    need = np.full(count, k, np.int64)
    short = np.zeros(count, bool)
    first = True
    while first or (high > low).any():
        width = (high - low) // np.uint64(BINS) + np.uint64(1)
        seen = np.zeros(count, bool)
        for r in _histogram(spark, rows, scale, block, low, high, width, need):
            q = r["q"]
            seen[q] = True
            low[q] += np.uint64(r["bin"]) * width[q]
            high[q] = min(int(high[q]), int(low[q]) + int(width[q]) - 1)
            need[q] -= r["above"]
        if first:
            short = ~seen
            low[short], high[short] = 0, 0  # fewer than k: all are above
        first = False
    sent = spark.sparkContext.broadcast((block, (low ^ SIGN).view(np.int64), np.where(short, 0, need), np.array(ids_at, np.int64)))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, kth, ties, names = sent.value
        equal: dict[int, list[int]] = {}

        def out(q, ids, scores):
            return pa.RecordBatch.from_arrays([pa.array(names[q], pa.int64()), pa.array(ids, pa.int64()), pa.array(scores, pa.int64())], ["query_id", "vec_id", "score"])

        for places, ids, scores, own in _scores(batches, scale, block):
            limit = kth[places][:, None]
            q, r = np.nonzero((scores > limit) & ~own)
            if len(q):
                yield out(places[q], ids[r], scores[q, r])
            q, r = np.nonzero((scores == limit) & ~own & (ties[places] > 0)[:, None])
            order = np.lexsort((ids[r], q))
            q, r = q[order], r[order]
            for i in np.unique(q):
                where = np.searchsorted(q, [i, i + 1])
                place = int(places[i])
                took = equal.get(place, []) + ids[r[where[0] : where[1]][: ties[place]]].tolist()
                equal[place] = sorted(took)[: ties[place]]
        if equal:
            q = np.repeat(list(equal), [len(v) for v in equal.values()])
            yield out(q, np.concatenate([np.array(v, np.int64) for v in equal.values()]), kth[q])

    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    found = rows.mapInArrow(keep, schema).withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    found = materialise(found.select("query_id", "rank", "vec_id", "score"), "topk")
    sent.destroy()
    return found


def _bound(rows: DataFrame, scale: float, block) -> int:
    """No score is larger, either way: by the largest components on both sides."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[float, float]] = {}
        for batch in batches:
            for _, matrix in vectors(batch, scale):
                norm = float(np.sqrt((matrix.astype(np.float64) ** 2).sum(axis=1)).max(initial=0))
                found[matrix.shape[1]] = max(found.get(matrix.shape[1], 0.0), norm)
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.float64())], ["dim", "norm"])

    most = 0.0
    # a row for each length of vectors that occurs among the queries
    for r in rows.mapInArrow(run, "dim int, norm double").where(F.col("dim").isin([int(d) for d in block])).groupBy("dim").agg(F.max("norm").alias("norm")).collect():
        own = float(np.sqrt((block[r["dim"]][2].astype(np.float64) ** 2).sum(axis=1)).max(initial=0))
        most = max(most, own * r["norm"])
    return int(min(most * 1.000001 + 1, float(LIMIT))) if most < 9e18 else LIMIT
