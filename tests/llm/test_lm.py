import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quiltgraph.llm import lm


def plain_tokens(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [*re.findall(r"[^\x20\x09-\x0D]+", low), None]


def check_base(rows, got):
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, t in rows if not held(i) for w in plain_tokens(t))
    n, v = sum(c.values()), len(c)
    want = sorted((i or 0, held(i), len(plain_tokens(t)), sum(c[w] > 0 for w in plain_tokens(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in plain_tokens(t)), 6)) for i, t in rows)
    mine = sorted((r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got)
    assert len(mine) == len(want)
    for m, w in zip(mine, want, strict=True):
        assert m[:5] == w[:5] and abs(m[5] - w[5]) < 2e-6
    assert all(math.isfinite(r["score"]) and r["score"] <= 0 for r in got)


def test_query_and_small_dictionary(spark):
    from quiltgraph.llm.queries import op4_lm

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    check_base(rows, op4_lm(spark, "/root/testdata/sf0.001").collect())
    # the join of rare words does its part
    got = lm.lm_scores(docs.repartition(3), head=300).collect()
    check_base(rows, got)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_odd_rows(spark):
    rows = [(i, t) for i, t in enumerate([None, "", " \n", "A a A", "a b", "É é a"] * 3)] + [(3, "A a A"), (None, "only here"), (50, "long text " * 60_000)]
    docs = spark.createDataFrame([(*r, 1.0) for r in rows], "doc_id long, text string, score double").repartition(3)
    check_base(rows, lm.lm_scores(docs).collect())
    check_base(rows, lm.lm_scores(docs, head=1).collect())
    assert lm.lm_scores(docs.limit(0)).collect() == []
    only = docs.where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 1)
    check_base([tuple(r) for r in only.select("doc_id", "text").collect()], lm.lm_scores(only).collect())


def test_model_is_a_distribution(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select(F.encode("text", "utf-8").alias("text"))
    counts = lm.count_words(docs).cache()
    v, rare, figures = lm.build_vocabulary(counts, 200)
    rng = np.random.default_rng(0)
    table = rng.normal(size=(lm.ROWS + 1, lm.CLASSES)).astype(np.float32)
    ids = rng.integers(0, len(v.words), 9)
    first = np.zeros(9, bool)
    first[[0, 4]] = True
    p = lm.softmax(lm.class_logits(table, lm.features(ids, first, v.end + 1)))
    assert np.allclose(p.sum(axis=1), 1, atol=1e-5)
    # each class's shares sum to one, rare words and their unknown outcome included
    own = np.bincount(v.class_of[: len(v.words)], 10.0 ** v.own[: len(v.words)], minlength=lm.CLASSES)
    assert np.allclose(own[own > 0], 1)
    for r in rare.groupBy("g").agg(F.sum(F.col("n") + 0.5).alias("m")).collect():
        assert abs((r["m"] + figures["new"][r["g"]]) / figures["rare"][r["g"]] - 1) < 1e-9
    assert abs(10.0 ** v.own[v.end] - 1) < 1e-9


def test_steps_lower_the_loss():
    ids = np.tile([0, 1, 2, 3], 4000)
    first = np.zeros(len(ids), bool)
    first[0] = True
    rows, target = lm.features(ids, first, 9), ids.astype(np.int32)
    t = lm.Trainer(np.zeros((lm.ROWS + 1, lm.CLASSES), np.float32))
    for i in range(0, len(ids), lm.STEP):
        t.step(rows[i : i + lm.STEP], target[i : i + lm.STEP])
    p = lm.softmax(lm.class_logits(t.table, rows[-100:]))
    assert p[np.arange(100), target[-100:]].min() > 0.8
