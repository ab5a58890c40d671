import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quiltgraph.llm.packing import CapacityTree, best_fit_decreasing, close_gaps, pack_documents, tokens_of

PATH = public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)


def ids_of(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60))
def test_ids_equal_the_library(text):
    assert tokens_of(PATH)(text).tolist() == ids_of(text)


def test_ids_equal_the_library_on_odd_texts():
    for text in ("", "<|endoftext|>a", "a <|endoftext|>", " \u0085 \x1c\x1f x", "﻿a 　b", "x" * 5000, " " * 3000 + "a", "\r\n\t \n", "áe‍1²½Ⅷ"):
        assert tokens_of(PATH)(text).tolist() == ids_of(text), text[:20]


def test_tree_finds_the_tightest():
    rng = random.Random(3)
    tree, held = CapacityTree(100), []
    for _ in range(3000):
        if held and rng.random() < 0.5:
            tree.add(held.pop(rng.randrange(len(held))), -1)
        else:
            held.append(rng.randrange(101))
            tree.add(held[-1], 1)
        need = rng.randrange(101)
        assert tree.tightest(need) == min((c for c in held if c >= need), default=-1)


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 32), max_size=60))
def test_windows_hold_all(lengths):
    pieces = [(i, 0, n) for i, n in enumerate(lengths)]
    plain = best_fit_decreasing(pieces, 32)
    assert sorted(p for w in plain for p in w) == sorted(pieces)
    assert all(sum(p[2] for p in w) <= 32 for w in plain)
    closed = close_gaps([list(w) for w in plain], 32)
    seen = sorted((d, s + k) for w in closed for d, s, n in w for k in range(n))
    assert seen == sorted((d, k) for d, _, n in pieces for k in range(n))
    for w in closed:
        n = sum(p[2] for p in w)
        assert n <= 32 and n & (n - 1) == 0  # no padding at all


def test_round_trip(spark):
    rows = [(1, "", "x"), (2, None, "y"), (None, "no id", None), (3, "word " * 3000, "z"), (4, "same", "t"), (4, "same", "t"), (5, "é<|endoftext|>ß", "u")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)
    out = pack_documents(docs, PATH, block_tokens=50).collect()
    by_sequence, by_doc = {}, {}
    for r in out:
        assert len(r["ids"]) == 4 * r["length"] > 0
        by_sequence.setdefault(r["sequence_id"], []).append(r)
        by_doc.setdefault(r["doc_id"], []).append(r)
    for pieces in by_sequence.values():
        at = 0
        for r in sorted(pieces, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 1024 and at & (at - 1) == 0
    for doc_id, text in {(r[0], r[1]) for r in rows}:
        want = ids_of(text or "") + [0]
        copies = 2 if doc_id == 4 else 1
        pieces = sorted(by_doc[doc_id], key=lambda r: r["start"])
        assert sum(r["length"] for r in pieces) == copies * len(want)
        for r in pieces:
            assert np.frombuffer(r["ids"], "<u4").tolist() == want[r["start"] : r["start"] + r["length"]]
            assert r["doc_tokens"] == len(want)


def test_empty_table(spark):
    assert pack_documents(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []


def test_query(spark):
    from quiltgraph.llm.queries import op1_packing

    out = op1_packing(spark, "/root/testdata/sf0.001")
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    seen = {}
    for r in out.collect():
        ids = seen.setdefault(r["doc_id"], ids_of(docs[r["doc_id"]] or "") + [0])
        assert r["ids_crc32"] == zlib.crc32(np.array(ids[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
    assert len(seen) == len(docs)
