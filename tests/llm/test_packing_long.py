import json

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quiltgraph.llm.packing import Tokens, as_ranks, pack_documents

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("text", [" " * 2_000_000, "\n" * 2_000_000, " \n" * 1_000_000, "a b" + " \t" * 700_000 + "end"])
def test_long_runs_of_white_space(text):
    assert Tokens(PATH)(text).tolist() == Tokenizer.from_file(PATH).encode(text, add_special_tokens=False).ids


def test_other_files_go_to_the_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    own, library = Tokens(path), Tokenizer.from_file(path)
    assert own.coder is None
    for text in ("Some Words, and more", "", "é  x\n", "<|endoftext|>a"):
        assert own(text).tolist() == library.encode(text, add_special_tokens=False).ids


def test_files_that_tiktoken_would_read_otherwise():
    spec = json.load(open(PATH, encoding="utf-8"))
    assert as_ranks(spec)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"pre_tokenizer": {**spec["pre_tokenizer"], "add_prefix_space": True}}, {"model": {**spec["model"], "merges": spec["model"]["merges"][::-1]}}):
        assert as_ranks({**spec, **change}) is None


def test_packing_a_long_blank_text(spark):
    docs = spark.createDataFrame([(1, " " * 1_000_000), (2, "short")], "doc_id long, text string")
    got = [r for r in pack_documents(docs, PATH).collect() if r["doc_id"] == 1]
    ids = np.concatenate([np.frombuffer(r["ids"], "<u4") for r in sorted(got, key=lambda r: r["start"])])
    assert len(ids) == got[0]["doc_tokens"] and ids[-1] == 0
