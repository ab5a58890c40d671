import random

import corpus_pipeline as pipeline
from quiltgraph.llm import resemblance


def shingles(text):
    own = (text or "").lower().split()
    return {tuple(own[i : i + 5]) for i in range(max(1, len(own) - 4))} if own else set()


def kept(texts):
    """The smallest id of each component, by brute force."""
    sets, group = {i: shingles(t) for i, t in texts.items()}, {i: i for i in texts}
    alike = [(i, j) for i in sets for j in sets if i < j and len(sets[i] & sets[j]) * 5 >= 4 * len(sets[i] | sets[j])]
    changed = True
    while changed:
        changed = False
        for i, j in alike:
            if group[i] != group[j]:
                group[i] = group[j] = min(group[i], group[j])
                changed = True
    return set(group.values())


def stage(spark, texts):
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    return sorted(r["doc_id"] for r in pipeline.near_duplicates(spark, docs.repartition(3), "").collect())


def test_stage_equals_brute_force_jaccard(spark):
    rng, texts = random.Random(7), {}
    for base in range(12):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((60, 300, 900)))]
        texts[10 * base] = " ".join(words)
        for k in range(1, 6):  # each copy goes on from the one before, so chains come up as well
            words = list(words)
            for _ in range(max(1, len(words) * k // 150)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(5000)}"
            texts[10 * base + k] = " ".join(words)
    texts |= {900: None, 901: "", 902: " \t", 903: "two words", 904: "TWO  words", 905: "two other"}
    want = kept(texts)
    assert 20 < len(want) < len(texts) - 10
    assert stage(spark, texts) == sorted(want)


def test_documents_of_sf001(spark):
    rows = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    texts = {r["doc_id"]: r["text"] for r in rows}
    assert {1, 6} <= kept(texts) and not {177, 145} & kept(texts)  # 0.83 similar, 11 and 7 bits apart
    assert stage(spark, texts) == sorted(kept(texts))


def test_large_component_is_searched_from_neighbour_to_neighbour():
    sets = [resemblance.shingle_set(" ".join(f"w{i}" for i in range(k, k + 100))) for k in range(0, 400, 4)]
    sets.append(resemblance.shingle_set("quite another text that is like none of them"))
    assert resemblance.similar_sets(sets).tolist() == [0] * 100 + [100]
