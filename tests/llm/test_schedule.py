import corpus_pipeline as pipeline
from quiltgraph.llm.mixing import mix_sources


def test_sequences_follow_the_schedule(spark, tmp_path, monkeypatch):
    """On a table of several unequal files, blocks of sequences take the documents in the order of mix_position."""
    monkeypatch.setattr(pipeline, "ORDERED_TOKENS", 2048, raising=False)
    # long texts in one source, so that files of equal ranges differ in size; another source is used up late
    rows = [(i, " ".join(f"t{i * k % 997}" for k in range(900 if i % 7 == 0 else 30)), "en", "abc"[min(2, i % 7)], None) for i in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(5)
    pipeline.mixing(spark, docs, "").write.parquet(f"{tmp_path}/mixed")
    stored = spark.read.parquet(f"{tmp_path}/mixed")
    got = pipeline.packing(spark, stored, "").collect()
    place = {r["doc_id"]: r["mix_position"] for r in mix_sources(docs).select("doc_id", "mix_position").collect()}
    rank = {i: k for k, i in enumerate(sorted(place, key=place.get))}
    tokens = {r["doc_id"]: r["doc_tokens"] for r in got}
    before, total = {}, 0  # tokens that the schedule has before each document
    for i in sorted(place, key=place.get):
        before[i] = total
        total += tokens[i]
    assert sum(r["length"] for r in got) == total and set(tokens) == set(rank)
    seen, worst = 0, 0
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        worst = max(worst, abs(before[r["doc_id"]] + r["start"] - seen))
        seen += r["length"]
    assert worst <= 2048 + 2 * max(tokens.values())
    # over the final order of sequences, each source's share is the schedule's, to within a block
    source = {r[0]: r[3] for r in rows}
    want, have = sorted(place, key=place.get), sorted(got, key=lambda r: (r["sequence_id"], r["offset"]))
    for name in "abc":
        at, own, done, told = 0, 0, 0, 0
        for r in have:
            done, told = done + r["length"], told + r["length"] * (source[r["doc_id"]] == name)
            while at < len(want) and before[want[at]] + tokens[want[at]] <= done:
                own += tokens[want[at]] * (source[want[at]] == name)
                at += 1
            assert abs(told - own) <= 2048 + 2 * max(tokens.values())
