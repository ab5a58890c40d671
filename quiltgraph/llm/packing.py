"""Packing of documents into token sequences by best-fit decreasing.

One pass, no shuffle: every input partition is tokenised, cut and packed where it is read. Documents
longer than a window are first cut into full windows; what is left over is packed in blocks of at
most ``block_tokens`` tokens, so that memory stays bounded however large a partition is. Within a
block a segment tree indexed by remaining capacity finds the tightest open window for each piece,
longest piece first. Windows that stay short are filled from the emptiest ones, and the last short
window of a block is written as sequences whose lengths are powers of two, which need no padding.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from quiltgraph.llm.common import few_at_once

CAPACITY = 1024
#: Tokens of leftovers that are packed at once; bounds a task's memory and costs no padding.
BLOCK_TOKENS = 4_000_000
#: Room for the sequences of one input partition in a sequence id.
PARTITION_SHIFT = 36

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"

Piece = tuple[int, int, int]  # document (index into the block), first token, tokens


class CapacityTree:
    """Segment tree over capacities 0..capacity: a node holds the number of open windows below it."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, windows: int) -> None:
        node = self.leaves + capacity
        while node:
            self.count[node] += windows
            node >>= 1

    def tightest(self, need: int) -> int:
        """The smallest capacity of at least ``need`` that an open window has, or -1."""
        count, node = self.count, self.leaves + need
        if count[node]:
            return need
        while node > 1:
            if not node & 1 and count[node + 1]:
                node += 1
                while node < self.leaves:
                    node *= 2
                    if not count[node]:
                        node += 1
                return node - self.leaves
            node >>= 1
        return -1


def best_fit_decreasing(pieces: list[Piece], capacity: int = CAPACITY) -> list[list[Piece]]:
    """Windows of at most ``capacity`` tokens; pieces are never longer. Ties keep the order given."""
    tree, windows = CapacityTree(capacity), []
    open_at: list[list[int]] = [[] for _ in range(capacity + 1)]
    for piece in sorted(pieces, key=lambda p: -p[2]):
        room = tree.tightest(piece[2])
        if room < 0:
            windows.append([piece])
            at, room = len(windows) - 1, capacity
        else:
            at = open_at[room].pop()
            tree.add(room, -1)
            windows[at].append(piece)
        if left := room - piece[2]:
            open_at[left].append(at)
            tree.add(left, 1)
    return windows


def close_gaps(windows: list[list[Piece]], capacity: int = CAPACITY) -> list[list[Piece]]:
    """Cuts pieces of the emptiest short windows to fill the fullest; what is left of the last one is
    split into sequences whose lengths are powers of two."""
    fill = lambda w: sum(p[2] for p in w)
    short = lambda n: n < capacity and n & (n - 1) != 0
    done = [w for w in windows if not short(fill(w))]
    rest = sorted((w for w in windows if short(fill(w))), key=fill, reverse=True)
    while len(rest) > 1:
        taker, giver = rest[0], rest[-1]
        gap = capacity - fill(taker)
        while gap and giver:
            doc, start, length = giver.pop()
            part = min(gap, length)
            if part < length:
                giver.append((doc, start, length - part))
            taker.append((doc, start + length - part, part))
            gap -= part
        if not gap:
            done.append(rest.pop(0))
        if not giver:
            rest.pop()
    for left in rest:
        n = fill(left)
        while n:
            window, room = [], 1 << (n.bit_length() - 1)
            n -= room
            while room:
                doc, start, length = left.pop(0)
                part = min(room, length)
                if part < length:
                    left.insert(0, (doc, start + part, length - part))
                window.append((doc, start, part))
                room -= part
            done.append(window)
    return done


#: The pre-tokenizer that tiktoken's pattern stands for.
PLAIN = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def as_ranks(spec: dict) -> tuple[dict[bytes, int], dict[str, int]] | None:
    """The vocabulary of a tokenizers file as merge ranks and special tokens, or None where tiktoken might give other ids:
    if texts are normalised or cut in another way, or merges aren't in the order of their ids."""
    model, cut = spec["model"], spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or {k: cut.get(k) for k in PLAIN} != PLAIN or model.get("type") != "BPE":
        return None
    if any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges")):
        return None
    if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized")):
        return None
    # the printable stand-ins of the 256 bytes in such files
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    odd = [b for b in range(256) if b not in set(plain)]
    byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(odd)}
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    vocab = {token: i for token, i in model["vocab"].items() if token not in special}
    merged = [vocab.get("".join(m if isinstance(m, list) else m.split(" ")), -1) for m in model["merges"]]
    if merged != sorted(set(merged)) or -1 in merged or not all(set(token) <= byte.keys() for token in vocab) or len(vocab) != 256 + len(merged):
        return None
    return {bytes(byte[c] for c in token): i for token, i in vocab.items()}, special


class Tokens:
    """The ids that the tokenizers library gives for a vocabulary file. Where the file allows, they come by tiktoken's
    merges, several times as fast (the tests hold the two against each other); for any other file, and for texts
    whose long runs of white space are too much for its pattern, by the library itself. The strings of special
    tokens in a text become these tokens, as that library has it."""

    def __init__(self, path: str):
        import json

        import tiktoken

        with open(path, encoding="utf-8") as f:
            found = as_ranks(json.load(f))
        self.path, self.library = path, None
        self.coder = found and tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=found[0], special_tokens=found[1])

    def __call__(self, text: str) -> np.ndarray:
        if self.coder:
            try:
                return self.coder.encode_to_numpy(text, allowed_special="all")
            except ValueError:  # the pattern's backtracking gave up
                pass
        if self.library is None:
            from tokenizers import Tokenizer

            self.library = Tokenizer.from_file(self.path)
        return np.array(self.library.encode(text, add_special_tokens=False).ids, np.uint32)


_loaded: dict[str, Tokens] = {}


def tokens_of(path: str) -> Tokens:
    """One per worker process."""
    if path not in _loaded:
        _loaded[path] = Tokens(path)
    return _loaded[path]


def pack_partition(rows: Iterable[tuple], encode, capacity: int, block_tokens: int, first: int, in_order: bool = False) -> Iterator[tuple]:
    """rows: (doc_id, text). Yields (doc_id, start, length, doc_tokens, sequence_id, offset, ids). in_order: blocks hold
    full windows too, and a block's sequences are numbered by the mean place of their tokens among the rows."""
    sequence = first
    block: list[tuple] = []  # doc_id, first token held, ids held, tokens of the document
    held = 0

    def flush() -> Iterator[tuple]:
        nonlocal sequence
        windows = best_fit_decreasing([(i, 0, len(x[2])) for i, x in enumerate(block)], capacity)
        windows = close_gaps(windows, capacity)
        if in_order:
            windows.sort(key=lambda w: sum(doc * length for doc, _, length in w) / sum(length for _, _, length in w))
        for window in windows:
            offset = 0
            for doc, start, length in window:
                doc_id, before, ids, total = block[doc]
                yield doc_id, before + start, length, total, sequence, offset, ids[start : start + length].tobytes()
                offset += length
            sequence += 1

    for doc_id, text in rows:
        ids = np.append(encode(text or ""), 0).astype("<u4", copy=False)
        total = len(ids)
        full = total - total % capacity
        for start in range(0, full, capacity):
            if in_order:
                block.append((doc_id, start, ids[start : start + capacity], total))
                held += capacity
                continue
            yield doc_id, start, capacity, total, sequence, 0, ids[start : start + capacity].tobytes()
            sequence += 1
        if total > full:
            block.append((doc_id, full, ids[full:].copy(), total))
            held += total - full
        if held >= block_tokens:
            yield from flush()
            block, held = [], 0
    yield from flush()


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, block_tokens: int = BLOCK_TOKENS, in_order: bool = False) -> DataFrame:
    """Packs every row of docs into sequences of at most ``capacity`` tokens.

    A document's tokens are those of its text (null: empty) and the end token 0, so an empty text
    still gives one piece. Returns a row per piece: doc_id (null where it is null), start (tokens of
    the document before it), length, doc_tokens, sequence_id, offset in the sequence, ids (unsigned
    little-endian 32-bit integers). Repeated rows are packed each; other columns of docs are ignored
    whatever their names; an empty table gives an empty result; a text of any length is tokenised whole, and its full
    windows are passed on at once unless in_order. A sequence id holds the number of the
    input partition, so a task that is run again gives the same rows. With in_order, sequence ids follow
    the order of docs: each block of ``block_tokens`` tokens before the next, and about so within a block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens_of(tokenizer_path)
        rows = (row for b in batches for row in zip(few_at_once(b.column(0)), few_at_once(b.column(1)), strict=True))
        out: list[tuple] = []
        first = TaskContext.get().partitionId() << PARTITION_SHIFT
        for piece in pack_partition(rows, encode, capacity, block_tokens, first, in_order):
            out.append(piece)
            if len(out) == 4096:
                yield _batch(out)
                out = []
        if out:
            yield _batch(out)

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")).mapInArrow(run, SCHEMA)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns[:6]] + [pa.array(columns[6], pa.binary())], ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"])
