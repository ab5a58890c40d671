import random

from test_resemblance import kept, stage

from quiltgraph.llm import resemblance


def test_blocks_lose_no_pair(spark, monkeypatch):
    """Chains of near copies whose component is cut into many blocks, and a passage that many texts share."""
    monkeypatch.setattr(resemblance, "BLOCK", 900)
    rng, texts, number = random.Random(3), {}, 0
    for _ in range(4):
        words = [f"w{rng.randrange(900)}" for _ in range(120)]
        for _ in range(25):
            texts[number] = " ".join(words)
            number += 1
            for _ in range(2):
                words[rng.randrange(len(words))] = f"x{rng.randrange(900)}"
    passage = [f"p{i}" for i in range(70)]
    for _ in range(60):
        texts[number] = " ".join([*passage, *(f"y{rng.randrange(9000)}" for _ in range(rng.randrange(5, 60)))])
        number += 1
    want = kept(texts)
    assert 4 < len(want) < len(texts) - 60
    assert stage(spark, texts) == sorted(want)


def test_a_value_that_many_share_sends_few_rows(spark):
    classes = spark.createDataFrame([(i, [7, 100 + i]) for i in range(5000)], "digest long, bands array<long>").repartition(4)
    rows = classes.mapInArrow(resemblance.expand, "value long, digest long, via long").where("value = 7 and via is null").count()
    assert rows < 50
    found = resemblance.candidate_components(classes).collect()
    assert len(found) == 5000 and {r["candidate"] for r in found} == {0}


def test_empty_tables_and_clashing_names(spark):
    rows = [(1, "a text of some words here", 3), (2, "a text of some words here", 4), (None, None, 5), (3, "", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest long")
    got = {(r["key"], r["group"]) for r in resemblance.similar_groups(docs, docs["doc_id"]).collect()}
    assert got == {(1, 1), (2, 1), (None, 3), (3, 3)}
    assert resemblance.similar_groups(docs.limit(0), docs["doc_id"]).collect() == []
