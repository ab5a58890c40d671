import corpus_pipeline as pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _score double, mix_position long, ids string"
LABELS = "doc_id long, quality int, toxic int"


def run(spark, folder, rows):
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, 1, 0)], LABELS).write.parquet(f"{folder}/labels.parquet")
    return pipeline.run(spark, str(folder)).collect()


def test_empty_documents(spark, tmp_path):
    assert run(spark, tmp_path, []) == []


def test_long_texts_extra_columns_and_nulls(spark, tmp_path):
    long = " ".join(f"word{i * 7919 % 50_021}" for i in range(200_000))
    rows = [(1, long, "en", "a", None, 0.1, 5, "x"), (2, " " * 300_000, "en", None, 3, None, 6, "y"), (3, "token = abcdefgh12345 and some more words after it", None, "a", 9, 0.5, 7, "z"), (None, "no id here, but words enough to be kept apart", "en", "b", None, 0.2, 8, None), (4, None, "en", "a", None, None, None, None)]
    got = run(spark, tmp_path, rows)
    tokens = {r["doc_id"]: r["doc_tokens"] for r in got}
    assert set(tokens) == {1, 2, 3, None}  # 2 and 4 have no words; the smaller id stays
    for i, n in tokens.items():
        assert sum(r["length"] for r in got if r["doc_id"] == i) == n
    assert tokens[1] > 200_000
