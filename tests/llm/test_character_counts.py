import re
import unicodedata

from quiltgraph.llm import fingerprints as fp
from quiltgraph.llm import quality as q

TEXTS = [None, "", " \t\r\n\u000b", "AÉßİ$#[]\\/^-{} 12 '`\"?():;.,!|   x\r\n\ty z😀 Ⅷ𝐀    ", "]" * 50 + "\\" * 7 + "&&^^--", "7" * 300_000, "A!" * 1000]


def test_counts_on_odd_characters(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "i int, t string")
    got = {r["_row"]["i"]: r for r in q.with_statistics(rows, "t").collect()}
    for i, text in enumerate(TEXTS):
        text = text or ""
        n, w = max(len(text), 1), max(len(re.findall(r"[^\x20\x09-\x0D]+", text)), 1)
        among = lambda chars: sum(c in chars for c in text)  # noqa: E731, B023
        want = {
            "symbols": among("#$%&*@~^+=_<>{}[]\\/") / n, "digits": among("0123456789") / n, "quotes": among("\"'`:;?()") / n,
            "lower_ascii": among("abcdefghijklmnopqrstuvwxyz") / n, "upper": sum(unicodedata.category(c) == "Lu" for c in text) / n,
            "exclamations": among("!") / w, "bars": among("|") / w, "stops": among(".") / w, "commas": among(",") / w,
        }
        for k, v in want.items():
            assert abs(got[i][f"_stat_{k}"] - v) < 1e-12, (i, k)


def test_only_ascii_letters_are_lower_cased(spark):
    rows = spark.createDataFrame([("One TWO three", "one two THREE"), ("É one", "é one"), ("İ One", "İ oNE"), ("K A", "k a")], "a string, b string")
    same = [r["a"] == r["b"] for r in rows.select(fp.fingerprint(rows["a"]).alias("a"), fp.fingerprint(rows["b"]).alias("b")).collect()]
    assert same == [True, False, True, False]


def test_digits_by_hand(spark):
    """Every digit is that of its bin's smallest hash, or of the first filled bin of its probe order."""
    texts = [" ".join(f"w{i * 37 % 101}" for i in range(n)) for n in (1, 5, 6, 40, 400)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").selectExpr("t", "transform(split(t, ' '), x -> xxhash64(x)) as h")
    shingles = "transform(sequence(0, greatest(size(h) - 5, 0)), i -> xxhash64(get(h, i), get(h, i + 1), get(h, i + 2), get(h, i + 3), get(h, i + 4)))"
    factors, _, offsets = fp.probe_order()
    for r in rows.selectExpr("*", f"{shingles} as s").select("s", fp.fingerprint(rows["t"]).alias("f")).collect():
        least: dict[int, int] = {}
        for h in sorted(x % 2**64 for x in r["s"]):
            least.setdefault(h >> 64 - fp.BIN_BITS, h)
        probes = lambda b: [b, *((factors[b] * j + offsets[b]) % fp.BINS for j in range(fp.BINS))]
        want = [next(least[p] for p in probes(b) if p in least) % 16 for b in range(fp.BINS)]  # noqa: B023
        assert r["f"] == "".join(f"{d:x}" for d in want)
