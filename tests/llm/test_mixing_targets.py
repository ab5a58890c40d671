from fractions import Fraction

import numpy as np
import pytest

from quiltgraph.llm import mixing


def due(blocks, weights, t):
    """Blocks due to each source by slot t, exactly: sources share a slot by weight while they last."""
    n, w, had, left = [Fraction(b) for b in blocks], [Fraction(x) for x in weights], [Fraction(0)] * len(blocks), Fraction(t)
    while left > 0:
        active = [i for i in range(len(n)) if had[i] < n[i]]
        total = sum(w[i] for i in active)
        step = min([left, *((n[i] - had[i]) * total / w[i] for i in active)])
        for i in active:
            had[i] += step * w[i] / total
        left -= step
    return had


@pytest.mark.parametrize("weights", [(0.5, 0.3, 0.2, 0.0003), (1, 1, 1), (1, 0.0001), (0.7, *[0.3 / 40] * 40)])
def test_less_than_a_block_from_the_targets_at_any_length(weights):
    total = 1_000_000
    share = np.array(weights) / sum(weights)
    blocks = [int(x) + 1 for x in share * total * 1.01]  # no source is used up before
    order = np.array(mixing.pfair_order(blocks, list(weights))[:total])
    t = np.arange(1, total + 1)
    for i, w in enumerate(share):
        assert np.abs(np.cumsum(order == i) - w * t).max() < 1 + 1e-6


def test_sources_that_are_used_up():
    rng = np.random.default_rng(5)
    for _ in range(30):
        k = int(rng.integers(1, 7))
        blocks, weights = rng.integers(0, 30, k).tolist(), [float(x) for x in rng.choice([0.1, 1, 1 / 3, 2.5, 7], k)]
        had = [0] * k
        for t, i in enumerate(mixing.pfair_order(blocks, weights), 1):
            had[i] += 1
            assert all(abs(h - d) < 1 + 1e-6 for h, d in zip(had, due(blocks, weights, t), strict=True))
        assert had == blocks


def test_many_sources_and_null_ids(spark, monkeypatch):
    monkeypatch.setattr(mixing, "BROADCAST_ROWS", 0)  # the schedule is joined by shuffling
    monkeypatch.setattr(mixing, "CHUNK", 4)
    rows = [(i, f"site{i % 1500}") for i in range(4000)] + [(None, "site1")] * 700 + [(None, None)] * 300
    out = mixing.mix_sources(spark.createDataFrame(rows, "doc_id long, source string").repartition(7), block_docs=2)
    got = out.collect()
    assert sorted(((r["doc_id"], r["source"]) for r in got), key=repr) == sorted(rows, key=repr)
    assert len({r["mix_position"] for r in got}) == len(rows)
    again = {(r["doc_id"], r["mix_position"]) for r in mixing.mix_sources(spark.createDataFrame(rows[::-1], "doc_id long, source string").repartition(3), block_docs=2).collect()}
    assert again == {(r["doc_id"], r["mix_position"]) for r in got}


def test_texts_that_nobody_asks_for_are_not_read(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = mixing.mix_sources(docs).select("doc_id", "source", "mix_position")
    scans = [s for s in plan._jdf.queryExecution().executedPlan().toString().splitlines() if "ReadSchema" in s]
    assert scans and not any("text" in s.split("ReadSchema")[1] for s in scans)


def test_blocks_grow_with_the_table(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_BLOCKS", 10)
    docs = spark.range(1000).selectExpr("id as doc_id", "cast(id % 3 as string) as source")
    got = mixing.mix_sources(docs).collect()
    assert {r["mix_slot"] for r in got} == set(range(12)) and len({r["mix_position"] for r in got}) == 1000
