import numpy as np
import pytest
from pyspark.sql import functions as F

from quiltgraph.llm import lm

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocabulary(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select(F.encode("text", "utf-8").alias("text"))
    return lm.build_vocabulary(lm.count_words(docs).cache(), 700)[0]


def log_probabilities(v, tables, ids, hashed):
    rows = (hashed >> lm.SHIFT).astype(np.int32)
    out = lm.log_shares(lm.class_logits(tables[0], rows), v.class_of[ids])
    inner, node, branch, token = lm.steps_down(v, ids, hashed)
    return out + np.bincount(token, lm.log_shares(lm.class_logits(tables[1], inner, v.shares.take(node, axis=0)), branch), minlength=len(ids))


@pytest.mark.parametrize("size", [0.0, 0.5, 40.0])
def test_probabilities_add_up_to_one_over_the_whole_vocabulary(vocabulary, size):
    v, rng = vocabulary, np.random.default_rng(3)
    tables = tuple((rng.normal(size=(lm.ROWS + 1, k)) * size).astype(np.float32) for k in (lm.CLASSES, lm.WIDTH))
    tables[0][lm.ROWS] = v.bias
    every = np.arange(v.end + 1)  # words, rare ones by group, the end
    for one, two in ((3, 5), (0, v.end + 1), (v.end + 1, v.end + 1), (650, 20)):
        hashed = lm.hashes(np.array([two, one, 0]), np.zeros(3, bool), v.end + 1)[2:].repeat(len(every), axis=0)
        assert abs(np.exp(log_probabilities(v, tables, every, hashed)).sum() - 1) < 1e-4


def test_without_weights_the_words_of_a_class_have_their_plain_share(vocabulary):
    v = vocabulary
    tables = np.zeros((lm.ROWS + 1, lm.CLASSES), np.float32), np.zeros((lm.ROWS + 1, lm.WIDTH), np.float32)
    tables[0][lm.ROWS] = v.bias
    ids = np.arange(len(v.words))
    got = log_probabilities(v, tables, ids, lm.hashes(ids, np.zeros(len(ids), bool), v.end + 1)) / np.log(10)
    assert np.allclose(got, v.bias[v.class_of[ids]] / np.log(10) + v.own[ids], atol=1e-4)


def test_context_decides_words_of_one_class(vocabulary):
    """Two words of a class that follow different words get probabilities that differ in the class."""
    v = vocabulary
    group = np.flatnonzero(v.class_of[: len(v.words)] == np.bincount(v.class_of[: len(v.words)]).argmax())
    a, b, x, y = group[:4]
    ids = np.tile([x, a, y, b], 3000)
    first = np.arange(len(ids)) % 2 == 0
    hashed, inner = lm.hashes(ids, first, v.end + 1), lm.Trainer(np.zeros((lm.ROWS + 1, lm.WIDTH), np.float32))
    for i in range(0, len(ids), 500):
        rows, node, branch, _ = lm.steps_down(v, ids[i : i + 500], hashed[i : i + 500])
        inner.step(rows, branch, v.shares.take(node, axis=0))
    classes = np.zeros((lm.ROWS + 1, lm.CLASSES), np.float32)
    after_x = log_probabilities(v, (classes, inner.table), np.array([a, b]), hashed[[1, 1]])
    after_y = log_probabilities(v, (classes, inner.table), np.array([a, b]), hashed[[3, 3]])
    assert after_x[0] > after_x[1] + 2 and after_y[1] > after_y[0] + 2


def test_trees_of_any_size():
    rng = np.random.default_rng(4)
    for sizes in ([0, 1, 2, 16, 17, 400], [3000], [1]):
        mass = np.exp(rng.normal(size=sum(sizes)) * 3) + 0.5
        words = np.split(rng.permutation(sum(sizes)), np.cumsum(sizes)[:-1])
        path, nodes, branches, shares = lm.grow(words, mass)
        assert len(path) == len(mass) + 1 and path[-1] == len(nodes) == len(branches)
        for own in words:
            logs = [shares[nodes[path[i] : path[i + 1]], branches[path[i] : path[i + 1]]].sum() for i in own]
            assert np.allclose(logs, np.log(mass[own] / mass[own].sum()), atol=1e-4)
            assert len({tuple(zip(nodes[path[i] : path[i + 1]], branches[path[i] : path[i + 1]], strict=True)) for i in own}) == len(own)
        assert np.allclose(np.exp(shares).sum(axis=1), 1, atol=1e-4) if len(shares) else True


def test_scores_do_not_depend_on_how_rows_are_dealt(spark, monkeypatch):
    monkeypatch.setattr(lm, "SHARD", 20_000)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    one, many = ({r["doc_id"]: r["score"] for r in lm.lm_scores(docs.repartition(n), head=2000).collect()} for n in (1, 7))
    assert len(one) == docs.count() and all(abs(one[i] - many[i]) < 1e-6 * max(1, abs(one[i])) for i in one)


def test_held_out_texts_score_better_than_by_frequency(spark):
    from quiltgraph.llm.queries import op4_lm

    got = [r for r in op4_lm(spark, "/root/testdata/sf0.01").collect() if r["held_out"]]
    n = sum(r["n_tokens"] for r in got)
    assert sum(r["score"] for r in got) / n > sum(r["base_score"] for r in got) / n + 0.2
