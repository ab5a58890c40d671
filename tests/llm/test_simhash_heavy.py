import numpy as np
from test_simhash import plain_components, planted

from quiltgraph.llm import simhash as sh


def test_divided_buckets_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(sh, "HEAVY", 3)
    for partitions in ((2,), (3,), (5,)):
        monkeypatch.setattr(sh, "PARTITIONS", partitions)
        base = planted(300, 40 + sum(partitions))
        # many that share half of their bits without being near
        rng = np.random.default_rng(1)
        base += [int(x) << 32 | 12345 for x in rng.integers(0, 2**32, 400)]
        prints = sorted(set(base))
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


def test_equal_rows_are_one(spark):
    rows = [(1, "the same row of words here", "x")] * 400 + [(None, "the same row of words here", "x")] * 3 + [(2, "quite another text, of other words", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, group string").repartition(5)
    assert sorted(r["doc_id"] for r in sh.keep_one(docs).collect()) == [1, 2]
