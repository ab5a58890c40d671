import hashlib
import re

from pyspark.sql import functions as F

from quiltgraph.llm import fingerprints as fp

LOWER = {i: i + 32 for i in range(65, 91)}


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def test_probe_order_reaches_all_bins():
    factors, inverses, offsets = fp.probe_order()
    for f, i, o in zip(factors, inverses, offsets, strict=True):
        assert f * i % fp.BINS == 1 and sorted((f * j + o) % fp.BINS for j in range(fp.BINS)) == list(range(fp.BINS))
    assert len(set(zip(factors, offsets, strict=True))) > 120


def check(rows, got):
    docs = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    assert len(got) == len(docs)
    by = {}
    for r in got:
        by.setdefault((r["doc_id"], r["fingerprint"]), []).append(r)
    errors = []
    left = {}
    for i, (doc_id, text) in enumerate(docs):
        text, after = text or "", docs[(i + 1) % len(docs)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + after[:half]
        left.setdefault((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest()), []).append((jaccard(shingles(text), shingles(edited)), jaccard(shingles(text), shingles(after))))
    for r in got:
        want = left[r["doc_id"], r["n_chars"], r["edited_sha256"]].pop()
        errors += [abs(r["near_edited"] - want[0]), abs(r["near_next"] - want[1])]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
    assert not any(left.values())
    return errors


def test_query(spark):
    from quiltgraph.llm.queries import op7_fingerprints

    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()]
    errors = check(rows, op7_fingerprints(spark, "/root/testdata/sf0.001").collect())
    assert sum(errors) / len(errors) < 0.04


def test_odd_rows(spark):
    rows = [(3, "same text here"), (3, "same text here"), (None, "a b c d e f g"), (None, None), (5, ""), (9, "é" * 7), (8, "w " * 30_000), (-4, "one"), (7, " \n\t")]
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, next string").repartition(4)
    got = fp.compare_with_edited(docs).collect()
    check(rows, got)
    prints = {r["doc_id"]: r["fingerprint"] for r in got}
    assert prints[5] == prints[7] == "" and len(prints[9]) == 128
    assert len({r["fingerprint"] for r in got if r["doc_id"] == 3}) == 1
    assert fp.compare_with_edited(docs.limit(0)).collect() == []
    alone = fp.compare_with_edited(docs.where("doc_id = 9")).collect()
    assert alone[0]["near_next"] == 1.0 and alone[0]["edited_sha256"] == hashlib.sha256(("é" * 7).encode()).hexdigest()


def test_likeness_follows_jaccard(spark):
    base = [f"w{i}" for i in range(1000)]
    texts = [" ".join(base[k:] + [f"v{k}_{i}" for i in range(k)]) for k in (0, 50, 111, 250, 500, 900)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", fp.fingerprint(F.col("t")).alias("f"))
    first = df.where(F.col("t") == texts[0]).select(F.col("f").alias("g"))
    for r in df.join(first).select("t", fp.likeness(F.col("f"), F.col("g")).alias("l")).collect():
        assert abs(r["l"] - jaccard(shingles(r["t"]), shingles(texts[0]))) < 0.15


def test_short_sets_agree(spark):
    # densification must let two small sets agree as often as their likeness says
    texts = [" ".join(f"s{d}_{i}" for i in range(12)) for d in range(40)]
    other = [" ".join(t.split()[:11] + ["z"]) for t in texts]
    df = spark.createDataFrame(list(zip(texts, other, strict=True)), "a string, b string")
    mean = df.select(F.avg(fp.likeness(fp.fingerprint(F.col("a")), fp.fingerprint(F.col("b"))))).first()[0]
    want = sum(jaccard(shingles(a), shingles(b)) for a, b in zip(texts, other, strict=True)) / len(texts)
    assert abs(mean - want) < 0.06
