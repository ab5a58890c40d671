"""Secret scans: three fixed patterns and dictionary-primed compression novelty.

The novelty method looks at strings that follow a sensitive word closely. A string's marginal size is
what it adds to the zstandard-compressed text around it, with a dictionary of code and identifiers
that need not be learned again. A string whose marginal size stays near its length is new to both
its surroundings and the dictionary, and is reported.
"""

from __future__ import annotations

import builtins
import keyword
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from quiltgraph.llm.common import few_at_once

#: In this order where spans start together.
KINDS = ("assign", "access", "hex", "novel")

# Fixed values of the query's contract.
ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST = {"assign": 8, "access": 16, "hex": 32}
#: One of these is in the lower-cased text of every assign match.
ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")

# The novelty method's parameters.
SENSITIVE = re.compile(r"(?i:passw|secret|token|api_?key|credential|private_?key|bearer|authorization|signature)", re.ASCII)
SENSITIVE_HINTS = ("passw", "secret", "token", "apikey", "api_key", "credential", "private", "bearer", "authorization", "signature")
LEAST_CANDIDATE = 16
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{%d,}" % LEAST_CANDIDATE)
#: Code points after a sensitive word in which a candidate may begin.
REACH = 80
#: Code points of surroundings before and after a candidate.
AROUND = 256
#: Marginal bytes for each byte of a candidate from which it counts as new.
NOVELTY = 0.6

#: Common code and identifiers; what a text shares with it is no news.
PRIMER = (
    "import os sys json requests const let var function return class public private static void string int "
    "self.assertEqual response.status_code application/json content-type authorization bearer username password "
    "secret token api_key access_key private_key client_id client_secret credentials signature config environment "
    "https://www.example.com/path/to/index.html http://localhost:8080/api/v1/users?id= "
    "get_secret_value set_password token_type refresh_token access_token session_token csrf_token token_count "
    "max_tokens tokenizer.from_pretrained tokenization password_reset_token_generator password_validators "
    "AUTH_PASSWORD_VALIDATORS SECRET_KEY your_api_key_here your-secret-key-here changeme placeholder example "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000000000000000000000000000 "
    "ffffffffffffffffffffffffffffffff xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx 1234567890123456789012345678901234567890"
).encode()

#: The identifiers of the language that this runs on: its keywords, builtins and modules.
IDENTIFIERS = " ".join(sorted({*keyword.kwlist, *dir(builtins), *(n for k in (str, dict, bytes) for n in dir(k)), *sys.stdlib_module_names})).encode()

SPAN = "struct<kind:string,start:int,end:int,value_start:int,novelty:double>"
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value_start", pa.int32()), ("novelty", pa.float64())])

Span = tuple[str, int, int, int, float | None]


class Novelty:
    """Marginal compressed bytes of a string within its surroundings."""

    def __init__(self, primer: bytes = IDENTIFIERS + b" " + PRIMER):
        primed = zstandard.ZstdCompressionDict(primer, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        primed.precompute_compress(level=3)
        self.coder = zstandard.ZstdCompressor(level=3, dict_data=primed, write_content_size=False, write_checksum=False)

    def __call__(self, text: str, start: int, end: int) -> float:
        before, after = text[max(0, start - AROUND) : start].encode("utf-8", "replace"), text[end : end + AROUND].encode("utf-8", "replace")
        own = text[start:end].encode()
        size = lambda x: len(self.coder.compress(x))
        return (size(before + own + after) - size(before + after)) / len(own)


def scan_text(text: str, novelty: Novelty) -> list[Span]:
    """All spans of a text (code points, end exclusive), by start, then kind."""
    low = text.lower()
    found: list[Span] = []
    if any(h in low for h in ASSIGN_HINTS):
        found += [("assign", m.start(), m.end(), m.start(1), None) for m in ASSIGN.finditer(text) if m.end() - m.start(1) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), m.start(), None) for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    found += [("hex", m.start(), m.end(), m.start(), None) for m in HEX.finditer(text)]
    if any(h in low for h in SENSITIVE_HINTS):
        base = sorted((x[1], x[2]) for x in found)
        runs = CANDIDATE.finditer(text)  # each run is looked at once, whatever the number of words before it
        run, at, seen = next(runs, None), 0, 0
        for word in SENSITIVE.finditer(text):
            seen = max(word.end(), seen)
            while run and max(run.start(), seen) <= word.end() + REACH:
                start, end = max(run.start(), seen), run.end()  # a run may have begun before or in the word
                run = next(runs, None)
                if end - start < LEAST_CANDIDATE:
                    continue
                seen = end
                while at < len(base) and base[at][1] <= start:
                    at += 1
                if any(s < end and e > start for s, e in base[at : at + 4]):
                    continue
                own = text[start:end]
                if any(c.isdigit() for c in own) and any(c.isalpha() for c in own) and (share := novelty(text, start, end)) >= NOVELTY:
                    found.append(("novel", start, end, start, share))
            if not run:
                break
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row (doc_id, spans) for every row of docs, in one pass without a shuffle.

    spans holds kind, start and end (code points of the whole text, end exclusive), value_start (where
    the secret itself begins) and, for novel spans, the marginal bytes per byte. A null or empty text
    has no spans; repeated rows are scanned each; other columns are ignored whatever their names; an empty table gives
    an empty result. The time for a text grows with its length, whatever it holds.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for b in batches:
            spans = [[dict(zip(("kind", "start", "end", "value_start", "novelty"), s, strict=True)) for s in scan_text(t, novelty)] if t else [] for t in few_at_once(b.column(1))]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(spans, pa.list_(_SPAN))], ["doc_id", "spans"])

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, f"doc_id long, spans array<{SPAN}>")


def redact(text: str, spans: list[Span], mask: str) -> str:
    out, at = [], 0
    for _, _, end, start, _ in sorted(spans, key=lambda s: s[3]):
        if end <= at:
            continue
        out += [text[at : max(at, start)], mask] if start >= at else [text[at:at]]
        at = end
    return "".join(out) + text[at:]


def redact_secrets(docs: DataFrame, text_col: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """docs with the secret part of every span replaced by ``mask``; rows, columns and their order stay. Null and empty
    texts stay as they are, repeated rows are treated alike, an empty table stays empty, and other columns, whatever
    their names, are passed on. Of spans that overlap, the text from the first one's secret part to the last end goes."""
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = Novelty()
        for b in batches:
            texts = [redact(t, s, mask) if t and (s := scan_text(t, novelty)) else t for t in few_at_once(b.column(at))]
            columns = [pa.array(texts, pa.string()) if i == at else c for i, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays(columns, names=b.schema.names)

    return docs.mapInArrow(run, docs.schema)
