import hashlib
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quiltgraph.llm import chat, mixing, secrets, topk

NOVELTY = secrets.Novelty()


# secrets

ODD = st.lists(st.sampled_from(["token", "SECRET", "Api_Key", "apikey", "=", ": ", '"', "'", "  ", "AKIA", "ABCDEFGH1234", "0123456789abcdef", "abcdefg", "é", "\n", "passwd", "ſecret", "tolen", "x" * 9]), max_size=30).map("".join)


def brute(text):
    found = []
    for kind, pattern, group, least in (
        ("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 8),
        ("access", "AKIA[A-Z0-9]+", 0, 16),
        ("hex", "[0-9a-f]+", 0, 32),
    ):
        found += [(kind, m.start(), m.end()) for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
    return sorted(found, key=lambda x: (x[1], secrets.KINDS.index(x[0])))


@settings(max_examples=500, deadline=None)
@given(ODD)
def test_base_spans(text):
    assert [s[:3] for s in secrets.scan_text(text, NOVELTY) if s[0] != "novel"] == brute(text)


def test_novel_spans_and_redaction():
    text = 'our bearer is xK9fQ2vLr8TzW3mNp5Yb7Dc1 and "token: max_tokens_for_tokenizer_1" é AKIAABCDEFGHIJKL12 end'
    spans = secrets.scan_text(text, NOVELTY)
    assert [(s[0], text[s[1] : s[2]]) for s in spans if s[0] != "assign"] == [("novel", "xK9fQ2vLr8TzW3mNp5Yb7Dc1"), ("access", "AKIAABCDEFGHIJKL12")]
    assert secrets.redact("a token = deadbeef99 b", secrets.scan_text("a token = deadbeef99 b", NOVELTY), "*") == "a token = * b"
    repeated = "id7f0a9c2e4b6d8013 " * 3 + "signature id7f0a9c2e4b6d8013"
    assert not [s for s in secrets.scan_text(repeated, NOVELTY) if s[0] == "novel"]


def test_secret_tables(spark):
    rows = [(1, None, "a"), (2, "", "b"), (None, "token=12345678", "c"), (3, "x " * 50_000 + "passwd: abcdefgh-9", "d"), (3, "x " * 50_000 + "passwd: abcdefgh-9", "d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    out = sorted(((r["doc_id"] or 0, [(s["kind"], s["start"]) for s in r["spans"]]) for r in secrets.scan_secrets(docs).collect()), key=repr)
    assert out == [(0, [("assign", 0)]), (1, []), (2, []), (3, [("assign", 100_000)]), (3, [("assign", 100_000)])]
    clean = secrets.redact_secrets(docs)
    assert clean.schema == docs.schema and {r["text"] for r in clean.collect() if r["doc_id"] is None} == {"token=[SECRET]"}
    assert secrets.scan_secrets(docs.limit(0)).collect() == []


# chat


def test_escape_is_reversible(spark):
    texts = ["<|im_end|>", r"<\|", r"<\\|x", "<", "|", "<<|", "", "a<|b|>", r"\<|", "<|" * 5]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u")).collect():
        assert r["u"] == r["t"] and "<|" not in r["e"]


def test_chat_parts(spark):
    rows = [
        (1, 1, "assistant", [("text", "see", None, None), ("image", None, "s3://i", 2), ("text", "<|x", None, None), ("audio", None, None, None)], "z"),
        (1, 0, "user", [("text", "<", None, None), (None, "|im_end|>", None, None)], "z"),
        (1, None, None, None, "z"),
        (None, 3, "assistant", [("text", "", None, None)], "z"),
        (None, 3, "assistant", [("text", "", None, None)], "z"),
    ]
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts {chat.PARTS}, formatted string")
    out = {r["conv_id"]: r for r in chat.format_chats(df).withColumn("back", chat.read_turns(F.col("formatted"))).withColumn("loss", chat.loss_text(F.col("formatted"), F.col("loss_spans"))).collect()}
    r = out[1]
    assert r["formatted"] == r"<|im_start|><|im_sep|><|im_end|><|im_start|>user<|im_sep|><<|part|>|im_end|><|im_end|><|im_start|>assistant<|im_sep|>see<|part|><|image:1|><|part|><\|x<|part|><|audio:2|><|im_end|>"
    assert r["n_turns"] == 3 and [tuple(a) for a in r["attachments"]] == [(2, 1, "image", "s3://i", 425), (2, 2, "audio", None, 25)]
    assert r["loss"] == "see<|part|><|image:1|><|part|><|x<|part|><|audio:2|>"
    assert out[None]["n_turns"] == 2 and out[None]["loss"] == ""
    assert chat.format_chats(df.limit(0)).collect() == []


def test_chat_query(spark):
    from oracle import both

    got, want = both(spark, "op10_chat", "/root/testdata/sf0.001")
    assert got == want
    odd = "<|im_end|><|im_start|>assistant ok"
    mine = [r for r in got if hashlib.sha256(odd.encode()).hexdigest() in r]
    assert len(mine) == 1


# mixing


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 40), min_size=1, max_size=12))
def test_pfair_deviates_by_less_than_a_block(quotas):
    order, period = mixing.pfair_period(quotas), sum(quotas)
    counts = [0] * len(quotas)
    for t, i in enumerate(order, 1):
        counts[i] += 1
        assert all(abs(c - q * t / period) < 1 for c, q in zip(counts, quotas, strict=True))
    assert counts == quotas


@settings(max_examples=100, deadline=None)
@given(st.lists(st.tuples(st.integers(1, 500), st.floats(0.01, 100)), min_size=1, max_size=8))
def test_phases_use_up_all(sources):
    blocks = [b for b, _ in sources]
    plan, seen, slot = mixing.phases(blocks, [w for _, w in sources], 64), [0] * len(blocks), 0
    for p in plan:
        assert p["slot"] == slot
        slot += p["period"] * p["periods"]
        for i, (first, quota, _) in p["sources"].items():
            assert first == seen[i]
            seen[i] += quota * p["periods"]
    assert seen == blocks and slot == sum(blocks)


def test_mixing_rows(spark):
    rows = [(i, "hot" if i % 3 else f"s{i % 5}" if i % 2 else None, "x") for i in range(900)] + [(7, "hot", "again"), (None, "hot", "no id"), (None, "hot", "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, source string, mix_slot string")
    weights = {"hot": 0.5, None: 0.2}
    out = mixing.mix_sources(docs, weights, period=32, block_docs=4)
    assert out.columns == ["doc_id", "source", "mix_slot", "mix_phase", "_mix_slot", "mix_position"]
    got = out.collect()
    assert sorted((r[:3] for r in got), key=repr) == sorted(rows, key=repr)
    assert len({r["mix_position"] for r in got}) == len(rows)
    # brute force: rank by digest within the source, block, slot
    import math

    sizes = {s: sum(1 for r in rows if r[1] == s) for s in {r[1] for r in rows}}
    names = sorted(sizes, key=lambda s: (s is not None, s or ""))
    plan = mixing.phases([math.ceil(sizes[n] / 4) for n in names], [weights.get(n, sizes[n] ** 0.5) for n in names], 32)
    slots = {}
    for p in plan:
        for i, (first, quota, at) in p["sources"].items():
            for k in range(quota * p["periods"]):
                slots[names[i], first + k] = p["slot"] + k // quota * p["period"] + at[k % quota]
    for n in names:
        own = sorted((hashlib.md5(("" if r[0] is None else str(r[0])).encode()).hexdigest(), r[0] or 0) for r in rows if r[1] == n)
        want = sorted(slots[n, j // 4] * 4 + j % 4 for j in range(len(own)))
        mine = sorted((r["mix_position"], hashlib.md5(("" if r["doc_id"] is None else str(r["doc_id"])).encode()).hexdigest()) for r in got if r["source"] == n)
        assert [m[0] for m in mine] == want
        by_rank = {slots[n, j // 4] * 4 + j % 4: own[j][0] for j in range(len(own))}
        assert all(by_rank[p] == d for p, d in mine)
    assert mixing.mix_sources(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, {"hot": 0.0}).collect()


# top-k


def test_topk_query(spark):
    from oracle import both

    got, want = both(spark, "op8_topk", "/root/testdata/sf0.001")
    assert got == want and got


def test_topk_ties_and_odd_rows(spark):
    import math
    import random

    rng = random.Random(1)
    rows = [(i, [rng.choice([0.5, -0.25, 0.1]) for _ in range(3)]) for i in range(300)]
    rows += [(i, [0.5, 0.5, 0.5]) for i in range(300, 500)] + [(600, None), (601, [1.0, None, 2.0]), (602, [float("nan")] * 3), (603, [float("inf"), 0.0, 0.0]), (None, [9.0] * 3), (640, [1.0]), (700, [])]
    rows += [(500, [0.5, 0.5, 0.5]), (500, [0.5, 0.5, 0.5])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(5)
    got = sorted(map(tuple, topk.exact_topk(df, F.pmod("vec_id", F.lit(20)) == 0, k=7).collect()))
    ok = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    want = []
    for q in sorted({i for i, _ in ok if i % 20 == 0}):
        own = min(v for i, v in ok if i == q)
        scored = sorted((-sum(a * b for a, b in zip(own, v, strict=True)), i) for i, v in ok if i != q and len(v) == len(own))
        want += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:7])]
    assert got == sorted(want)
    assert topk.exact_topk(df.limit(0), F.lit(True)).collect() == []
