import random

import pytest
from test_fingerprints import check

from quiltgraph.llm import fingerprints as fp


@pytest.mark.parametrize("base", [2**60, -(2**63), 2**63 - 4001])
def test_ids_beyond_doubles(spark, base):
    rng = random.Random(3)
    rows = [(base + i, " ".join(rng.choice("abcdefgh") * rng.randrange(1, 4) for _ in range(rng.randrange(12)))) for i in range(1500)]
    rows += [(None, "no id"), (None, None), (None, "another one without"), (base + 7, "again"), (base + 7, None)]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, text string, fingerprint string, next int").repartition(7)
    check(rows, fp.compare_with_edited(docs).collect())


def test_texts_are_fingerprinted_once(spark):
    """The rows that are added to other buckets are found before fingerprints are made."""
    plan = fp.compare_with_edited(spark.read.parquet("/root/testdata/sf0.001/documents.parquet"))._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    below = next(i for i, s in enumerate(lines) if "Aggregate [_to" in s)
    assert any("xxhash64" in s for s in lines[:below]) and not any("xxhash64" in s for s in lines[below:])
