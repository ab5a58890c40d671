import re

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quiltgraph.llm import simhash as sh


def plain_simhash(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return 0
    grams = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints, keys, tau=3):
    """Union-find over all pairs of distinct fingerprints."""
    distinct = sorted(set(prints))
    own = np.array(distinct, np.uint64)
    parent = list(range(len(own)))

    def find(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i in range(len(own)):
        for j in np.flatnonzero(np.bitwise_count(own[i + 1 :] ^ own[i]) <= tau) + i + 1:
            parent[find(i)] = find(int(j))
    at = {f: find(i) for i, f in enumerate(distinct)}
    least = {}
    for f, k in zip(prints, keys, strict=True):
        if k is not None:
            least[at[f]] = min(k, least.get(at[f], k))
    return [least.get(at[f]) for f in prints]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["A", "Zz", "é", "É", " ", " x", "\x1c", "word"]), max_size=8), st.sampled_from([" ", "\n\t", "\x0b", "\x0c\r "]))
def test_fingerprints(parts, blank):
    text = blank.join(parts)
    assert sh.simhash(text) == plain_simhash(text)


def test_allot_is_least():
    from itertools import product

    rng = np.random.default_rng(2)
    for _ in range(50):
        costs = [[0.0, *np.cumsum(rng.random(4)).tolist()] for _ in range(4)]
        cost, chosen = sh.allot(costs, 3)
        assert sum(t + 1 for t in chosen) == 4
        least = min(sum(c[t] for c, t in zip(costs, ts, strict=True)) for ts in product(range(5), repeat=4) if sum(ts) == 4)
        assert abs(cost - least) < 1e-9


def planted(n, seed):
    rng = np.random.default_rng(seed)
    out = []
    while len(out) < n:
        f = int(rng.integers(0, 2**63)) * 2 + int(rng.integers(0, 2))
        for _ in range(int(rng.integers(1, 5))):
            out.append(f)
            for bit in rng.choice(64, int(rng.integers(0, 5)), replace=False):
                f ^= 1 << int(bit)
    dense = out[0]
    for _ in range(300):  # one dense group, beyond the size up to which all pairs are compared
        out.append(dense ^ (1 << int(rng.integers(0, 20))) ^ (1 << int(rng.integers(0, 20))))
    return out


def test_links_lose_nothing(spark, monkeypatch):
    for partitions in ((4,), (3,), (2,), (5,), sh.PARTITIONS):
        monkeypatch.setattr(sh, "PARTITIONS", partitions)
        prints = sorted(set(planted(500, sum(partitions))))
        df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in prints], "f long").repartition(3)
        parent = {f: f for f in prints}

        def find(f):
            while parent[f] != f:
                f = parent[f]
            return f

        for r in sh.near_links(df).collect():
            u, v = (int(np.int64(x).view(np.uint64)) for x in (r["u"], r["v"]))
            assert (u ^ v).bit_count() <= 3
            parent[find(u)] = find(v)
        want = plain_components(prints, prints)
        roots = {}
        for f, w in zip(prints, want, strict=True):
            assert roots.setdefault(find(f), w) == w
        assert len(roots) == len(set(want))


def test_query(spark):
    from quiltgraph.llm.queries import op3_simhash

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    got = {r["doc_id"]: r for r in op3_simhash(spark, "/root/testdata/sf0.01").collect()}
    prints = [sh.simhash(r["text"]) for r in docs]
    want = plain_components(prints, [r["doc_id"] for r in docs])
    assert len(got) == len(docs)
    for r, f, c in zip(docs, prints, want, strict=True):
        assert got[r["doc_id"]]["fingerprint"] == f"{f:016x}" and got[r["doc_id"]]["component_id"] == c


def test_odd_rows_and_keep_one(spark):
    long = "lorem ipsum dolor " * 20_000
    rows = [(3, None, "a"), (2, "", "b"), (None, " \n", "c"), (9, "one two", "d"), (9, "one two", "d"), (7, long, "e"), (8, long, "f"), (None, "alone here now", "g"), (None, "alone here now", "h")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, key string").repartition(3)
    got = sorted(map(tuple, sh.near_duplicates(docs).collect()), key=repr)
    zero = "0" * 16
    one, lorem, alone = (f"{sh.simhash(t):016x}" for t in ("one two", long, "alone here now"))
    assert got == sorted([(3, zero, 2), (2, zero, 2), (None, zero, 2), (9, one, 9), (9, one, 9), (7, lorem, 7), (8, lorem, 7), (None, alone, None), (None, alone, None)], key=repr)
    kept = sorted(map(tuple, sh.keep_one(docs).collect()), key=repr)
    assert len(kept) == 4 and {r[0] for r in kept} == {2, 9, 7, None}
    assert sh.near_duplicates(docs.limit(0)).collect() == [] and sh.keep_one(docs.limit(0)).collect() == []
    assert sh.near_duplicates(docs.where(F.lit(False))).columns == ["doc_id", "fingerprint", "component_id"]
