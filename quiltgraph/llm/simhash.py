"""SimHash near-duplicates with generalised pigeonhole search.

Fingerprints that differ in at most tau bits are linked, and linked documents form components. Bits are
grouped so that correlated ones share a partition of the fingerprint. Each partition i gets a threshold
t_i, possibly -1 (not searched), such that the t_i + 1 sum to tau + 1: two fingerprints within tau bits are
then within t_i bits in some partition i. Dynamic programming allots the thresholds by the number
of candidates that each would bring, estimated from histograms of all fingerprints. Every fingerprint is
stored under its value in each searched partition and probes the values within t_i bits of it; what
meets is verified. Only distinct fingerprints take part, so exact copies cost nothing here. Values that many
fingerprints share, by the same histograms, are divided by the pigeonhole principle once more: of tau + 1 groups of the
other bits, two linked fingerprints agree on one, so they meet in one of tau + 1 smaller buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quiltgraph.llm.common import ASCII_LOWER, few_at_once, materialise, skew_safe_lookup
from quiltgraph.operators.components import contract

TAU = 3
SHINGLE = 3
SEED = 42
#: Numbers of partitions that are weighed against each other.
PARTITIONS = (2, 3, 4, 5)
#: Bits of a partition that histograms resolve.
FOLD = 16
#: Rows of a bucket up to which all pairs are compared at once; larger buckets are searched from one
#: fingerprint to its neighbours, each of which is then done with.
SMALL = 48
#: Fingerprints of one value from which its bucket is divided.
HEAVY = 20_000

BITS = np.arange(64, dtype=np.uint64)


def simhash(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits of the shingles of so many words, as an unsigned integer; zero for a text without words."""
    # bytes.split() parts at the blank and the bytes 9 to 13
    own = (text or "").translate(ASCII_LOWER).encode("utf-8", "surrogatepass").split()
    if not own:
        return 0
    if len(own) < shingle:
        own = [b" ".join(own)]
    width = min(shingle, len(own))
    digest, total, counts = xxhash.xxh64_intdigest, len(own) - width + 1, np.zeros(64, np.int64)
    for i in range(0, total, 1 << 16):  # a long text's shingles aren't all held at once
        n = min(1 << 16, total - i)
        shingles = zip(*(own[i + k : i + k + n] for k in range(width)), strict=True)
        hashes = np.fromiter((digest(b" ".join(s), SEED) for s in shingles), np.uint64, n)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * counts > total, bitorder="little").view("<u8")[0])


def simhash_documents(docs: DataFrame, key, text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(key, fingerprint) of every row; key is a column expression, fingerprint the bits as a long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = np.fromiter((simhash(t, shingle) for t in few_at_once(b.column(1))), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(prints.view(np.int64))], ["key", "fingerprint"])

    own = docs.select(key.alias("key"), docs[text_col].cast("string").alias("text"))
    kind = own.schema["key"].dataType.simpleString()
    return own.mapInArrow(run, f"key {kind}, fingerprint long")


# -- the search's plan: figures of all fingerprints, gathered in tables of fixed size


def group_bits(agree: np.ndarray, parts: int) -> list[list[int]]:
    """Bits by partition, of about equal size. agree: absolute correlation of each two bits. Each partition
    starts with the most correlated bit left and takes those most correlated with what it has."""
    left, out = set(range(64)), []
    for p in range(parts):
        size = len(left) // (parts - p)
        order = sorted(left)
        own = [max(order, key=lambda i: (sum(agree[i, j] for j in order if j != i), -i))]
        left.discard(own[0])
        while len(own) < size:
            best = max(sorted(left), key=lambda i: (sum(agree[i, j] for j in own), -i))
            own.append(best)
            left.discard(best)
        out.append(sorted(own))
    return out


def project(prints: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits of each fingerprint as a number."""
    out = np.zeros(len(prints), np.uint64)
    for k, bit in enumerate(bits):
        out |= ((prints >> np.uint64(bit)) & np.uint64(1)) << np.uint64(k)
    return out


def allot(costs: list[list[float]], tau: int) -> tuple[float, list[int]]:
    """Thresholds of least cost with the sum of t_i + 1 equal to tau + 1. costs[i][t + 1] is partition i's
    cost at threshold t."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        now: dict[int, tuple[float, list[int]]] = {}
        for spent, (paid, chosen) in best.items():
            for t, price in enumerate(cost):
                if spent + t <= tau + 1 and (spent + t not in now or paid + price < now[spent + t][0]):
                    now[spent + t] = paid + price, [*chosen, t - 1]
        best = now
    return best[tau + 1]


def within(values: np.ndarray, width: int, threshold: int) -> Iterator[np.ndarray]:
    """The values at a distance of 1 up to threshold bits, one flip pattern at a time."""
    for t in range(1, threshold + 1):
        for flips in combinations(range(width), t):
            yield values ^ np.uint64(sum(1 << f for f in flips))


def near_pairs(histogram: np.ndarray, width: int, most: int) -> list[float]:
    """Estimated ordered pairs within 0, 1, .. most bits of each other in a partition of ``width`` bits, from
    counts of its lowest FOLD bits; bits beyond those are taken for even coins."""
    folded, rest = min(width, FOLD), max(0, width - FOLD)
    values = np.arange(len(histogram), dtype=np.uint64)
    exact = [float((histogram.astype(float) ** 2).sum())]
    for t in range(1, most + 1):
        exact.append(sum(float((histogram * histogram[values ^ np.uint64(sum(1 << f for f in flips))]).sum(dtype=float)) for flips in combinations(range(folded), t)) if t < 3 else exact[-1] * folded / t)
    total, out = 0.0, []
    for t in range(most + 1):
        total += sum(exact[a] * comb(rest, t - a) for a in range(t + 1)) / 2.0**rest
        out.append(total)
    return out


def plan_search(prints: DataFrame, tau: int) -> tuple[list[list[int]], list[int], list[np.ndarray]]:
    """Partitions (their bits), thresholds, and for each partition the values, as far as histograms resolve them, that
    HEAVY fingerprints or more share. prints: distinct fingerprints (column f)."""

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 65))
        for b in batches:
            x = ((b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)[:, None] >> BITS) & np.uint64(1)).astype(np.float32)
            total[:, :64] += x.T @ x
            total[0, 64] += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size), pa.int32()), pa.array(total.ravel())], ["i", "n"])

    sums = np.zeros(64 * 65)
    for r in prints.mapInArrow(moments, "i int, n double").groupBy("i").agg(F.sum("n").alias("n")).collect():  # 4160 rows
        sums[r["i"]] = r["n"]
    sums = sums.reshape(64, 65)
    n = max(1.0, sums[0, 64])
    mean = np.diag(sums[:, :64]) / n
    spread = np.sqrt(np.maximum(mean * (1 - mean), 1e-12))
    agree = np.abs((sums[:, :64] / n - np.outer(mean, mean)) / np.outer(spread, spread))
    agree[:, mean * (1 - mean) < 1e-9] = agree[mean * (1 - mean) < 1e-9, :] = 1.0  # a bit that never changes tells nothing
    groups = {m: group_bits(agree, m) for m in PARTITIONS if m <= tau + 2}
    flat = [(m, i, bits) for m, parts in groups.items() for i, bits in enumerate(parts)]

    def histograms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(1 << min(FOLD, len(bits)), np.int64) for _, _, bits in flat]
        for b in batches:
            own = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for c, (_, _, bits) in zip(counts, flat, strict=True):
                c += np.bincount(project(own, bits[:FOLD]).astype(np.int64), minlength=len(c))
        for k, c in enumerate(counts):
            v = np.flatnonzero(c)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), k), pa.int32()), pa.array(v, pa.int32()), pa.array(c[v])], ["k", "v", "n"])

    # one table for each partition weighed, of at most 2 ** FOLD numbers
    table = prints.mapInArrow(histograms, "k int, v int, n long").groupBy("k", "v").agg(F.sum("n").alias("n")).toArrow()
    ks, vs, ns = (table.column(c).to_numpy() for c in ("k", "v", "n"))
    best: tuple[float, int, list[int], list[np.ndarray]] | None = None
    for m in groups:
        costs, heavy = [], []
        for k, (own, _, bits) in enumerate(flat):
            if own != m:
                continue
            histogram = np.zeros(1 << min(FOLD, len(bits)), np.int64)
            histogram[vs[ks == k]] = ns[ks == k]
            heavy.append(histogram >= HEAVY)
            most = min(tau, 2 if m > 2 else 3)
            pairs = near_pairs(histogram, len(bits), most)
            probes = np.cumsum([comb(len(bits), t) for t in range(most + 1)])
            # a probe row is shuffled and sorted, which costs about as much as verifying 40 pairs
            costs.append([0.0] + [pairs[t] / 2 + 40 * n * float(probes[t]) for t in range(most + 1)])
        if sum(len(c) - 1 for c in costs) < tau + 1:
            continue
        cost, thresholds = allot(costs, tau)
        if best is None or cost < best[0]:
            best = cost, m, thresholds, heavy
    return groups[best[1]], best[2], best[3]


# -- probing and verifying


def links_of_run(prints: np.ndarray, probes: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Links within one large bucket, enough to connect what is linked: pairs of prints of which at least one
    is stored here (not probes). Search goes from a fingerprint to all within tau bits that have not been
    reached yet, so a dense bucket takes about as many steps as it has fingerprints."""
    left = np.arange(len(prints))
    a, b = [], []
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            at = queue.pop()
            near = (np.bitwise_count(prints[left] ^ prints[at]) <= tau) & ~(probes[left] & probes[at])
            if near.any():
                reached = left[near]
                a.append(np.full(len(reached), at))
                b.append(reached)
                queue += reached.tolist()
                left = left[~near]
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def links_of_sorted(keys: np.ndarray, prints: np.ndarray, probes: np.ndarray, tau: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of rows sorted by bucket key."""
    edge = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    sizes = np.diff(np.append(edge, len(keys)))
    size_of = np.repeat(sizes, sizes)
    small = size_of <= SMALL
    a, b = [], []
    for shift in range(1, min(SMALL, int(sizes.max(initial=1)))):
        i = np.flatnonzero(small[:-shift] & (keys[shift:] == keys[:-shift]))
        if not len(i):
            break
        i = i[(np.bitwise_count(prints[i] ^ prints[i + shift]) <= tau) & ~(probes[i] & probes[i + shift])]
        a.append(i)
        b.append(i + shift)
    for start, size in zip(edge[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        x, y = links_of_run(prints[start : start + size], probes[start : start + size], tau)
        a.append(x + start)
        b.append(y + start)
    none = np.zeros(0, np.int64)
    return (np.concatenate(a), np.concatenate(b)) if a else (none, none)


def near_links(prints: DataFrame, tau: int = TAU) -> DataFrame:
    """(u, v): links of distinct fingerprints (column f, longs) that connect exactly those that a chain of
    steps of at most tau bits connects."""
    groups, thresholds, heavy = plan_search(prints, tau)
    chosen = [(i, bits, t) for i, (bits, t) in enumerate(zip(groups, thresholds, strict=True)) if t >= 0]
    others = {i: [[b for b in range(64) if b not in bits][g :: tau + 1] for g in range(tau + 1)] for i, bits, _ in chosen}

    def keyed(i: int, bits: list[int], value: np.ndarray, own: np.ndarray, probe: bool) -> Iterator[pa.RecordBatch]:
        large = heavy[i][(value & np.uint64(len(heavy[i]) - 1)).astype(np.int64)]
        if not large.all():
            yield _keyed(i, value[~large], own[~large], probe)
        if large.any():
            for g, rest in enumerate(others[i]):
                finer = value[large] | project(own[large].view(np.uint64), rest) << np.uint64(len(bits))
                yield _keyed(i + len(groups) * (g + 1), finer, own[large], probe)

    def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            own = b.column(0).to_numpy(zero_copy_only=False)
            for i, bits, t in chosen:
                value = project(own.view(np.uint64), bits)
                yield from keyed(i, bits, value, own, False)
                for other in within(value, len(bits), t):
                    yield from keyed(i, bits, other, own, True)

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        for b in batches:
            if not b.num_rows:
                continue
            part, value, own, probe = (b.column(k).to_numpy(zero_copy_only=False) for k in range(4))
            key = part.astype(np.uint64) << np.uint64(56) ^ value.view(np.uint64)
            last = np.flatnonzero(key != key[-1])
            cut = int(last[-1]) + 1 if len(last) else 0
            if cut or held and held[-1][0][-1] != key[0]:
                done = [*held, (key[:cut], own[:cut].view(np.uint64), probe[:cut])]
                yield from _links(done, tau)
                held = []
            held.append((key[cut:], own[cut:].view(np.uint64), probe[cut:]))
        if held:
            yield from _links(held, tau)

    keyed = prints.mapInArrow(expand, "part int, value long, f long, probe boolean")
    shuffled = keyed.repartition("part", "value").sortWithinPartitions("part", "value", "f", "probe")
    return shuffled.mapInArrow(verify, "u long, v long")


def _keyed(part: int, value: np.ndarray, own: np.ndarray, probe: bool) -> pa.RecordBatch:
    n = len(own)
    return pa.RecordBatch.from_arrays([pa.array(np.full(n, part), pa.int32()), pa.array(value.view(np.int64)), pa.array(own), pa.array(np.full(n, probe))], ["part", "value", "f", "probe"])


def _links(held: list[tuple[np.ndarray, ...]], tau: int) -> Iterator[pa.RecordBatch]:
    keys, prints, probes = (np.concatenate([h[k] for h in held]) for k in range(3))
    if not len(keys):
        return
    a, b = links_of_sorted(keys, prints, probes, tau)
    u, v = prints[a].view(np.int64), prints[b].view(np.int64)
    for i in range(0, len(u), 65_536):
        yield pa.RecordBatch.from_arrays([pa.array(u[i : i + 65_536]), pa.array(v[i : i + 65_536])], ["u", "v"])


def near_groups(docs: DataFrame, key, text_col: str = "text", tau: int = TAU, shingle: int = SHINGLE) -> DataFrame:
    """(key, fingerprint, group) of every row: group is the smallest key of its component (null keys don't
    count, unless the component has no other). Texts without words have fingerprint zero and link like any other."""
    prints = materialise(simhash_documents(docs, key, text_col, shingle), "simhash")
    total = prints.count()
    classes = materialise(prints.groupBy("fingerprint").agg(F.min("key").alias("least"), F.count(F.lit(1)).alias("n")), "simhash-classes")
    roots = contract(near_links(classes.select(F.col("fingerprint").alias("f")), tau))
    rooted = classes.join(roots.select(F.col("u").alias("fingerprint"), "v"), "fingerprint", "left").withColumn("root", F.coalesce("v", "fingerprint"))
    least = rooted.groupBy("root").agg(F.min("least").alias("group"))
    by_print = rooted.select("fingerprint", "n", "root").join(least, "root").select("fingerprint", "n", "group")
    return skew_safe_lookup(prints, by_print, "fingerprint", "n", total, "key")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU) -> DataFrame:
    """(doc_id, fingerprint as 16 hexadecimal digits, component_id) of every row of docs; repeated rows and
    null ids are kept; other columns are ignored; an empty table gives an empty result; a null text is empty, and a long
    one is hashed whole."""
    out = near_groups(docs, docs[id_col].cast("long"), text_col, tau)
    return out.select(F.col("key").alias("doc_id"), F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), F.col("group").alias("component_id"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tau: int = TAU, shingle: int = SHINGLE, check: Callable[..., DataFrame] | None = None) -> DataFrame:
    """The rows of docs that come first in their component: by id (null last), then by a hash of all columns.
    Rows that are equal in all columns count as one. Columns stay as they are. Components are those of near_groups;
    check(docs, key, text_col, groups), if given, gets them as candidates and returns (key, group) by the texts."""
    number = docs[id_col].cast("long")
    key = F.struct(number.isNull().alias("none"), number.alias("id"), F.xxhash64(*docs.columns).alias("hash"))
    groups = near_groups(docs, key, text_col, tau, shingle)
    if check:
        groups = check(docs, key, text_col, groups)
    own = {"_none": "none", "_id": "id", "_hash": "hash"}
    kept = groups.where(F.col("key").eqNullSafe(F.col("group"))).select(*[F.coalesce(F.col("key")[v], F.lit(0).cast("long") if v == "id" else F.col("key")[v]).alias(k) for k, v in own.items()]).distinct()
    marked = docs.select(F.struct("*").alias("_row"), number.isNull().alias("_none"), F.coalesce(number, F.lit(0)).alias("_id"), F.xxhash64(*docs.columns).alias("_hash"))
    # equal rows become one before they are shuffled, however many there are
    return marked.groupBy(*own).agg(F.first("_row").alias("_row")).join(kept, [*own], "left_semi").select("_row.*")
