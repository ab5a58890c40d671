import random

import numpy as np

from quiltgraph.llm import lm


def vocabulary(words):
    none = np.zeros(0)
    return lm.Vocabulary(words, {b"end": 3, b"x": 5}, none, none, none, none, none, none, none, none)


def test_numbers_equal_those_of_a_dictionary(monkeypatch):
    rng = random.Random(8)
    monkeypatch.setattr(lm, "KEPT", 64)  # texts of several portions, words longer than one
    monkeypatch.setattr(lm, "_powers", [])
    letters = [b"a", b"b", "é".encode(), b"-", b"0", b"\x00", b"Z"]
    words = sorted({b"".join(rng.choices(letters, k=rng.randrange(1, 9))).translate(lm.LOWER) for _ in range(900)} | {b"long" * 40})
    encoder, number = lm.Encoder(vocabulary(words), 77), {w: i for i, w in enumerate(words)}
    for _ in range(60):
        texts = [rng.choice([None, b"", b" \n", rng.choice([b" ", b"\t\n", b"\x0b"]).join(rng.choice([*words, b"NEW" + str(k).encode(), b"x", b"Long" * 40, b"\xc2\xa0"]) for k in range(rng.randrange(30)))]) for _ in range(rng.randrange(1, 6))]
        ids, first, text, rare = encoder(texts)
        want, odd = [], []
        for i, t in enumerate(texts):
            for k, w in enumerate([*lm.tokens(t), None]):
                n = encoder.end if w is None else number.get(w, len(words) + encoder.suffixes.get(w[-3:], 0))
                want.append((n, k == 0, i))
                if w is not None and w not in number:
                    odd.append((i, w))
        assert list(zip(ids.tolist(), first.tolist(), text.tolist(), strict=True)) == want and rare == odd


def test_an_empty_dictionary():
    encoder = lm.Encoder(vocabulary([]), 78)
    assert encoder([b"a END", None])[0].tolist() == [0, 3, encoder.end, encoder.end]
