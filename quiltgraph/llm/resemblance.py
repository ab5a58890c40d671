"""Exact check of near-duplicates by the Jaccard similarity of word shingles: candidates come in, sets decide.

Documents whose sets of distinct shingles are at least THRESHOLD similar are linked, and linked documents form
components. Texts with the same set are one class, so exact copies cost nothing here. Classes of one group that a search
before has found (SimHash's, in the pipeline) are candidates, and so that no pair is lost which the search's bits can't
tell, classes that share a band of MinHash values are too; a component of candidates is compared by whole sets, so nothing
below the threshold is linked. A pair at exactly 0.8 shares no band with probability (1 - 0.8 ** 5) ** 40 = 1.3e-7, a more
similar one with less.

A component meets in one task as long as its sets have no more than BLOCK shingles in all; a larger one is cut into
blocks of that size, and every two blocks meet in a task, so that no pair is lost and no task holds more than two.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltgraph.llm.common import ASCII_LOWER, materialise, skew_safe_lookup
from quiltgraph.operators.components import contract

SHINGLE = 5
#: Similarity from which documents are near-duplicates, as a fraction.
THRESHOLD = (4, 5)
#: Smallest set that can be similar to another one: of 4 shingles, to one of 5.
LEAST = 4
BANDS, ROWS = 40, 5
SEED = 42
#: Shingles that are compared in one task, about; a set that is larger is a block of its own.
BLOCK = 2_000_000
#: Of the MinHash values' lowest bytes, how many two sets must share before they are compared: 200 * 0.8 are expected at
#: the threshold, with a standard deviation of 5.7.
ALIKE = 120

_draw = np.random.default_rng(SEED)
FACTORS = _draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
TERMS = _draw.integers(0, 1 << 63, BANDS * ROWS, np.uint64)
WEIGHTS = _draw.integers(0, 1 << 63, ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
PLACES = _draw.integers(0, 1 << 63, BANDS, np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a text of fewer words has one of all its words, one without words none."""
    own = (text or "").translate(ASCII_LOWER).encode("utf-8", "surrogatepass").split()
    if not own:
        return np.zeros(0, np.uint64)
    width, digest = min(SHINGLE, len(own)), xxhash.xxh64_intdigest
    shingles = zip(*(own[k : len(own) - width + 1 + k] for k in range(width)), strict=True)
    return np.unique(np.fromiter((digest(b" ".join(s), SEED) for s in shingles), np.uint64, len(own) - width + 1))


def least_hashes(hashes: np.ndarray) -> np.ndarray:
    """The MinHash values of a set that isn't empty."""
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for i in range(0, len(hashes), 1024):
        np.minimum(least, (hashes[i : i + 1024, None] * FACTORS + TERMS).min(axis=0), out=least)
    return least ^ (least >> np.uint64(31))


def bands(least: np.ndarray) -> np.ndarray:
    """A number for each band of MinHash values."""
    return ((least.reshape(BANDS, ROWS) * WEIGHTS).sum(axis=1, dtype=np.uint64) + PLACES).view(np.int64)


def similar_sets(sets: list[np.ndarray]) -> np.ndarray:
    """The component of each set, numbered by its first member. Search goes from a set to all that haven't
    been reached yet, so sets alike take about as many steps as there are components; of the others, those whose
    MinHash values say that they are far from the threshold aren't looked at."""
    above, below = THRESHOLD
    sizes = np.array([len(s) for s in sets], np.int64)
    marks = np.array([least_hashes(s).astype(np.uint8) for s in sets])
    group, left = np.full(len(sets), -1), np.arange(len(sets))
    for first in range(len(sets)):
        if group[first] >= 0:
            continue
        group[first], queue, left = first, [first], left[left != first]
        while queue and len(left):
            at = queue.pop()
            own, n = sets[at], sizes[at]
            close = (marks[left] == marks[at]).sum(axis=1, dtype=np.int32) >= ALIKE
            close &= (np.minimum(sizes[left], n) * below >= above * np.maximum(sizes[left], n))
            near = np.zeros(len(left), bool)
            for k in np.flatnonzero(close):
                other = sets[left[k]]
                both = np.count_nonzero(own[np.minimum(np.searchsorted(own, other), n - 1)] == other)
                near[k] = both * below >= above * (n + len(other) - both)
            if near.any():
                group[left[near]] = first
                queue += left[near].tolist()
                left = left[~near]
    return group


def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (value, digest, via) of classes (digest, bands): the first class of a batch that has a band's value stands for
    it, with via null; the others are linked with that one, via, so a value that many share sends few rows on."""
    for b in batches:
        sizes = np.diff(b.column(1).offsets.to_numpy())
        values = b.column(1).flatten().to_numpy()
        digests = np.repeat(b.column(0).to_numpy(), sizes)
        order = np.lexsort((digests, values))
        values, digests = values[order], digests[order]
        new = np.concatenate([[True], values[1:] != values[:-1]])[: len(values)]
        first = digests[new][np.cumsum(new) - 1] if len(values) else digests
        yield pa.RecordBatch.from_arrays([pa.array(values[new]), pa.array(digests[new]), pa.nulls(int(new.sum()), pa.int64())], ["value", "digest", "via"])
        pairs = np.unique(np.stack([digests[~new], first[~new]], axis=1), axis=0)
        # any value will do for what is linked already; those of one class are spread
        yield pa.RecordBatch.from_arrays([pa.array(pairs.sum(axis=1)), pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["value", "digest", "via"])


def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(u, v): links of the rows of ``expand``, sorted by value. Of a value, only the first class is held."""
    value = first = None
    for b in batches:
        values, digests, via = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2)
        linked = via.is_valid().to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(digests[linked]), via.filter(via.is_valid())], ["u", "v"])
        values, digests = values[~linked], digests[~linked]
        if not len(values):
            continue
        new = np.concatenate([[values[0] != value], values[1:] != values[:-1]])
        firsts = np.concatenate([np.array([digests[0] if first is None else first], np.int64), digests[new]])[np.cumsum(new)]
        value, first = values[-1], firsts[-1]
        apart = firsts != digests
        yield pa.RecordBatch.from_arrays([pa.array(digests[apart]), pa.array(firsts[apart])], ["u", "v"])


def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, digest of the set, its size, bands) of rows (key, text)."""
    for b in batches:
        digests, sizes, values = [], [], []
        for text in b.column(1):  # one text's set at a time
            own = shingle_set(text.as_py())
            digests.append(xxhash.xxh64_intdigest(own.tobytes(), SEED))
            sizes.append(len(own))
            values.append(bands(least_hashes(own)) if len(own) else np.zeros(0, np.int64))
        flat = np.concatenate([np.zeros(0, np.int64), *values])
        ends = np.cumsum([0, *map(len, values)]).astype(np.int32)
        columns = [b.column(0), pa.array(np.array(digests, np.uint64).view(np.int64)), pa.array(sizes, pa.int64()), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))]
        yield pa.RecordBatch.from_arrays(columns, ["key", "digest", "size", "bands"])


def verify(found: pa.Table) -> pa.Table:
    """Links (u, v) of the sets of a task: each with the first of its component."""
    texts = dict(zip(found.column("digest").to_pylist(), found.column("text").to_pylist(), strict=True))
    ids = sorted(texts)
    group = similar_sets([shingle_set(texts[i]) for i in ids])
    pairs = [(i, ids[g]) for i, g in zip(ids, group, strict=True) if i != ids[g]]
    return pa.table({"u": pa.array([u for u, _ in pairs], pa.int64()), "v": pa.array([v for _, v in pairs], pa.int64())})


def candidate_components(classes: DataFrame, more: DataFrame | None = None) -> DataFrame:
    """(digest, candidate): classes that share a band with another, and the smallest of their component. more: rows of
    further bands."""
    rows = classes.select("digest", "bands")
    if more is not None:
        rows = rows.unionByName(more.select("digest", "bands"))
    expanded = rows.mapInArrow(expand, "value long, digest long, via long")
    parts = int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    links = expanded.repartition(parts, "value").sortWithinPartitions("value", "digest").mapInArrow(link, "u long, v long")
    roots = contract(links)
    return roots.unionByName(roots.select(F.col("v").alias("u"), "v")).distinct().select(F.col("u").alias("digest"), F.col("v").alias("candidate"))


def similar_groups(docs: DataFrame, key, text_col: str = "text", found: DataFrame | None = None) -> DataFrame:
    """(key, digest, group) of every row: group is the smallest key of its component. found has (key, group) of candidates;
    the first row of a class stands for it there. Texts without words, null ones too,
    are alike; repeated rows are kept; other columns are ignored; an empty table gives an empty result; texts are
    compared whole."""
    own = docs.select(key.alias("key"), docs[text_col].cast("string").alias("text"))
    kind = own.schema["key"].dataType.simpleString()
    prints = materialise(own.mapInArrow(sketch, f"key {kind}, digest long, size long, bands array<long>"), "sketches")
    total = prints.count()
    classes = prints.groupBy("digest").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("bands").alias("bands"))
    classes = materialise(classes, "sketch-classes")
    more = None
    if found is not None:
        first = classes.where(F.col("size") >= LEAST).select("digest", F.col("least").alias("key"))
        # a group is one more band that its classes share
        more = first.join(found.select("key", "group").distinct(), "key").select("digest", F.array(F.xxhash64("group")).alias("bands"))
    candidates = candidate_components(classes, more)
    wanted = materialise(classes.select("digest", F.col("least").alias("key"), "size").join(candidates, "digest"), "candidates")
    blocks = wanted.groupBy("candidate").agg(F.ceil(F.sum("size") / BLOCK).cast("int").alias("blocks"))
    # a row for each block that one's own meets; a component of one block meets itself
    mine = F.pmod(F.xxhash64("digest"), F.col("blocks")).cast("int")
    met = wanted.join(blocks, "candidate").withColumn("_own", mine).withColumn("_other", F.explode(F.expr("sequence(0, blocks - 1)")))
    met = met.select("key", "candidate", "digest", F.least("_own", "_other").alias("a"), F.greatest("_own", "_other").alias("b")).where("a <> b or a = 0")
    # equal rows have one key; they become one before texts are dealt to tasks
    held = own.join(wanted.select("key"), "key", "left_semi").groupBy("key").agg(F.first("text").alias("text"))
    met = met.join(held, "key").select("candidate", "a", "b", "digest", "text")
    roots = contract(met.groupBy("candidate", "a", "b").applyInArrow(verify, "u long, v long")).select(F.col("u").alias("digest"), F.col("v").alias("root"))
    rooted = classes.select("digest", "least", "n").join(roots, "digest", "left").select("digest", "least", "n", F.coalesce("root", "digest").alias("root"))
    rooted = materialise(rooted, "sketch-roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("group"))
    by_digest = rooted.select("digest", "n", "root").join(least, "root").select("digest", "n", "group")
    return skew_safe_lookup(prints.select("key", "digest"), by_digest, "digest", "n", total, "key")
