import math
import zlib

import numpy as np
from pyspark.sql import functions as F

from quiltgraph.llm import quality as q


def test_rules_find_a_conjunction():
    rng = np.random.default_rng(0)
    x = rng.random((4000, len(q.NAMES)))
    y = ((x[:, 0] > 0.3) & (x[:, 5] <= 0.8)).astype(float)
    model = q.fit_rules(x[:3000], y[:3000])
    assert 0 < len(model.rules) < 150
    assert ((model.score(x[3000:]) >= 0.5) == y[3000:]).mean() > 0.95


def test_lasso_is_sparse_and_least():
    rng = np.random.default_rng(1)
    a = (rng.random((500, 6)) > 0.5).astype(np.float32)
    y = (a[:, 0] > 0).astype(float)
    b, w = q.lasso_logistic(a, y, 0.02)
    assert abs(w[0]) > 1 and (np.abs(w[1:]) < 0.05).all()

    def loss(b, w):
        z = a @ w + b
        return np.mean(np.logaddexp(0, z) - y * z) + 0.02 * np.abs(w).sum()

    for _ in range(50):
        assert loss(b + rng.normal() * 0.05, w + rng.normal(size=6) * 0.05) >= loss(b, w) - 1e-3


def test_statistics_by_hand(spark):
    text = "Ab ab! Ab\nAb | é É9"
    r = q.with_statistics(spark.createDataFrame([(text,)], "text string"), "text").first()
    w = text.split()
    want = {
        "log_chars": math.log1p(19), "log_words": math.log1p(7), "word_length": 19 / 7, "exclamations": 1 / 7, "bars": 1 / 7, "symbols": 0, "digits": 1 / 19, "upper": 4 / 19, "lower_ascii": 5 / 19,
        "stops": 0, "commas": 0, "quotes": 0, "lines": 2 / 7, "distinct_lines": 1, "distinct_words": len(set(w)) / 7, "repeats": 1 / 7,
    }
    assert tuple(want) == q.NAMES
    for k, v in want.items():
        assert abs(r[f"_stat_{k}"] - v) < 1e-12, k


def test_columns_score_as_the_model_does(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = q.train_quality(docs, labels)
    table = q.with_statistics(docs, "text").withColumn("score", model.column()).toPandas()
    assert np.allclose(table["score"], model.score(table[[f"_stat_{k}" for k in q.NAMES]].to_numpy()))
    again = q.train_quality(docs.repartition(7), labels.repartition(3))
    assert again.rules == model.rules


def test_sample_is_bounded(spark):
    docs = spark.range(3000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("ab "), F.col("id").cast("int") % 9).alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    smallest = [r["doc_id"] for r in labels.orderBy(F.xxhash64("doc_id")).limit(500).collect()]
    few = labels.where(F.col("doc_id").isin(smallest))
    assert q.train_quality(docs, labels, max_train=500).rules == q.train_quality(docs, few).rules


def test_odd_rows_and_no_labels(spark):
    docs = spark.createDataFrame([(1, None, 0.0), (None, "", 0.0), (2, "x" * 300_000, 1.0), (2, "x" * 300_000, 1.0)], "doc_id long, text string, _text double")
    labels = spark.createDataFrame([(1, None), (None, 1), (9, 0), (2, 5)], "doc_id long, quality int")
    out = q.score_quality(docs, q.train_quality(docs, labels)).collect()
    assert [r["score"] for r in out] == [0.5] * 4 and out[0].asDict().keys() == {"doc_id", "text", "_text", "score"}
    assert q.score_quality(docs.limit(0), q.RuleModel()).collect() == []


def test_query_on_held_out_rows(spark):
    from quiltgraph.llm.queries import op5_quality

    sf = "/root/testdata/sf0.01"
    got = op5_quality(spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert len(got) == docs.count()
    assert all(h == (zlib.crc32(str(d).encode()) % 3 == 1) for d, h in zip(got["doc_id"], got["held_out"], strict=True))
    assert ((got["score"] >= 0.5) == (got["predicted"] == 1)).all() and got["score"].between(0, 1).all()
    m = got[got["held_out"]].merge(spark.read.parquet(f"{sf}/labels.parquet").toPandas(), on="doc_id")
    assert (m["predicted"] == m["quality"]).mean() > 0.97
    # labels of held-out rows don't matter
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    turned = labels.withColumn("quality", F.when(q.held_out("doc_id", 3), 1 - F.col("quality")).otherwise(F.col("quality")))
    one, two = (q.train_quality(docs, x.where(~q.held_out("doc_id", 3))) for x in (labels, turned))
    assert one.rules == two.rules
