import random

import numpy as np
import pyarrow as pa
from test_resemblance import kept, shingles
from test_simhash import plain_components, planted

import corpus_pipeline as pipeline
from quiltgraph.llm import resemblance
from quiltgraph.llm import simhash as sh


def edited():
    rng, texts = random.Random(11), {}
    for base in range(30):
        words = [f"w{rng.randrange(5000)}" for _ in range(rng.choice((40, 200, 600)))]
        texts[10 * base] = " ".join(words)
        for k in range(1, 5):
            words = list(words)
            for _ in range(max(1, len(words) * k // 120)):
                words[rng.randrange(len(words))] = f"x{rng.randrange(5000)}"
            texts[10 * base + k] = " ".join(words)
    return texts


def test_simhash_finds_candidates_without_bands(spark, monkeypatch):
    """With the bands taken away, the stage still links what SimHash finds, and only what whole texts confirm."""
    own = resemblance.sketch

    def bare(batches):
        for b in own(batches):
            none = pa.array([[]] * b.num_rows, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([*b.columns[:3], none], ["key", "digest", "size", "bands"])

    monkeypatch.setattr(resemblance, "sketch", bare)
    texts = edited() | {900: "a b c d e f", 901: "a b c d e g", 902: None, 903: " "}
    ids = sorted(texts)
    prints = [sh.simhash(texts[i], 5) for i in ids]
    candidate = plain_components(prints, ids, pipeline.NEAR_BITS)
    want = set()
    for c in set(candidate):
        want |= kept({i: texts[i] for i, own in zip(ids, candidate, strict=True) if own == c})
    refused = [(i, j) for i, a in zip(ids, candidate, strict=True) for j, b in zip(ids, candidate, strict=True) if i < j and a == b and {i, j} <= want]
    assert refused and len(want) < len(ids) - 30
    for i, j in refused:
        assert len(shingles(texts[i]) & shingles(texts[j])) * 5 < 4 * len(shingles(texts[i]) | shingles(texts[j]))

    rows = [(i, t, "en", "s", None) for i, t in texts.items()] + [(0, texts[0], "en", "s", None), (None, texts[1], "en", "s", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    assert sorted(r["doc_id"] for r in pipeline.near_duplicates(spark, docs, "").collect()) == sorted(want)


def test_links_of_more_bits_lose_nothing(spark):
    rng, prints = np.random.default_rng(5), set(planted(300, 9))
    for f in sorted(prints)[:150]:
        for bit in rng.choice(64, 7, replace=False):
            f ^= 1 << int(bit)
        prints.add(f)
    prints = sorted(prints)
    df = spark.createDataFrame([(int(np.uint64(f).view(np.int64)),) for f in prints], "f long").repartition(3)
    links = [tuple(int(np.int64(x).view(np.uint64)) for x in r) for r in sh.near_links(df, pipeline.NEAR_BITS).collect()]
    assert all((u ^ v).bit_count() <= pipeline.NEAR_BITS for u, v in links)
    least = {f: f for f in prints}
    changed = True
    while changed:
        changed = False
        for u, v in links:
            if least[u] != least[v]:
                least[u] = least[v] = min(least[u], least[v])
                changed = True
    assert [least[f] for f in prints] == plain_components(prints, prints, pipeline.NEAR_BITS)
