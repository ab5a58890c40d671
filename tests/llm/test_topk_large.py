import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quiltgraph.llm import topk

TOP = 2**63 - 1


def brute(rows, k, scale=64):
    limit = lambda x: max(-TOP, min(TOP, x))
    ok = [(i, [limit(math.floor(scale * x)) if math.isfinite(scale * x) else (TOP if x > 0 else -TOP) for x in v]) for i, v in rows]
    out = []
    for q, own in ok:
        if q % 20 == 0:
            scored = sorted((-limit(sum(a * b for a, b in zip(own, v, strict=True))), i) for i, v in ok if i != q)
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return sorted(out)


@pytest.mark.parametrize("size", [1.0, 4e7, 5e7, 1e9, 1e300])
def test_scores_up_to_a_long_and_beyond(spark, size):
    rng = random.Random(int(math.log10(size)))
    rows = [(i, [rng.uniform(-size, size) for _ in range(4)]) for i in range(120)] + [(200, [size] * 4), (201, [size] * 4), (202, [-size] * 4), (203, [0.5, 1.0, -1.0, 0.0])]
    df = spark.createDataFrame([(*r, 5, 1.0) for r in rows], "vec_id long, embedding array<double>, rank int, score double").repartition(3)
    assert sorted(map(tuple, topk.exact_topk(df, F.pmod("vec_id", F.lit(20)) == 0, k=6).collect())) == brute(rows, 6)


def test_products_are_exact_where_sizes_mix():
    rng = np.random.default_rng(2)
    q, r = (rng.integers(-100, 100, (6, 5)) * 10 ** rng.integers(0, 17, (6, 1)) for _ in range(2))
    want = [[max(-TOP, min(TOP, sum(int(a) * int(b) for a, b in zip(x, y, strict=True)))) for y in r] for x in q]
    assert topk.products(q, r).tolist() == want


def test_blocks_of_queries(spark):
    rng = random.Random(9)
    rows = [(i, [rng.choice([0.5, -0.25]) for _ in range(3)]) for i in range(400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    assert sorted(map(tuple, topk.exact_topk(df, F.pmod("vec_id", F.lit(20)) == 0, k=5, query_block=6).collect())) == brute(rows, 5)
