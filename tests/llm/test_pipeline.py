import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from quiltgraph.llm import secrets as sec
from quiltgraph.llm.simhash import simhash

SF = "/root/testdata/sf0.001"


def test_stages_one_by_one(spark, tmp_path):
    read = lambda name: spark.read.parquet(f"{tmp_path}/{name}")
    spark.read.parquet(f"{SF}/documents.parquet").write.parquet(f"{tmp_path}/start")
    names = ["start"]
    for name, stage in pipeline.STAGES:
        stage(spark, read(names[-1]), SF).write.parquet(f"{tmp_path}/{name}")
        names.append(name)
    start, quality, near, secrets, mixed = ({r["doc_id"]: r for r in read(n).collect()} for n in names[:-1])
    for n in names[:-1]:
        assert tuple(read(n).columns) == pipeline.COLUMNS
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    wrong = [i for i, q in labels.items() if (i in quality) != (q == 1)]
    assert len(wrong) <= 0.02 * len(labels) and all(quality[i] == start[i] for i in quality)

    # near duplicates: by brute force over what the classifier kept
    prints = {i: simhash(r["text"]) for i, r in quality.items()}
    group = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for i in prints:
            for j in prints:
                if (prints[i] ^ prints[j]).bit_count() <= 3 and group[i] > group[j]:
                    group[i], changed = group[j], True
    assert set(near) == set(group.values()) and all(near[i] == quality[i] for i in near)

    novelty = sec.Novelty()
    assert set(secrets) == set(near)
    for i, r in secrets.items():
        spans = sec.scan_text(near[i]["text"], novelty)
        assert r["text"] == sec.redact(near[i]["text"], spans, "[SECRET]") and r["n_chars"] == len(r["text"])

    assert mixed == secrets
    order = [r["doc_id"] for r in read("mixing").collect()]
    assert sorted(order) == sorted(secrets) and order != sorted(order)

    coder = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces: dict[int, list] = {}
    for r in read("packing").collect():
        pieces.setdefault(r["doc_id"], []).append(r)
    assert set(pieces) == set(mixed)
    for i, own in pieces.items():
        ids = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in sorted(own, key=lambda r: r["start"])]).tolist()
        assert ids == [*coder.encode(mixed[i]["text"], add_special_tokens=False).ids, 0]


def test_run_and_odd_rows(spark, tmp_path):
    rows = [(1, None, None, "s", None), (None, "", "en", None, 5), (2, "some text of no great length, but of words.", "en", "s", 3), (2, "some text of no great length, but of words.", "en", "s", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/in/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/in/labels.parquet")
    got = {(r["doc_id"], r["doc_tokens"]) for r in pipeline.run(spark, f"{tmp_path}/in").collect()}
    assert {g[0] for g in got} == {1, 2} and (1, 1) in got
