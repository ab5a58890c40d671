"""Language-model scoring: a hashed maximum-entropy model with class-factored softmax.

A token's probability is that of its class, given the tokens before it, times that of the word within its class, given
the same. Both factors are softmaxes over hashed features: the last token, the one before it, and both together. Classes are
groups of words that occur in the same kinds of texts. The second softmax is factored once more: a class's words
are the leaves of a tree of up to WIDTH branches, cut so that branches weigh about the same, and each node on a
word's path is a softmax over its branches, with features hashed together with the node. So frequent words have short
paths, every entry of the dictionary has a leaf of its own, and all probabilities add up to one. Rare words, which
are no entries, are one leaf for each group, by their last three bytes, and have their plain share of it.

Training is distributed: texts are dealt to shards of about SHARD tokens by a hash, and sorted by it, so results don't
depend on files or partitions. Every shard takes gradient steps over its own tokens, and the tables are
averaged by feature, weighted by the squared gradients that each shard saw of it. Counts are exact, for all words: those of
rare words stay in a table, which scored texts are joined with.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltgraph.llm.common import materialise

#: Entries of the dictionary that workers hold; the most frequent words.
HEAD = 1 << 18
#: Kinds of texts, by a hash of a text's most frequent word.
KINDS = 16
#: Groups that words are clustered into by kinds of texts.
GROUPS = 8
#: Branches of a node within a class.
WIDTH = 16
#: Suffixes that have a group of their own.
SUFFIXES = 4096
CLASSES = 2 * GROUPS + 1  # words by group, rare words by group, the end
#: Rows of either weight table, of classes and of nodes; one more is always on. 16 bits are sorted by radix.
ROWS = 1 << 16
RATE = 0.6
#: What a feature's squared gradients start from.
LEAST_SQUARE = np.float32(1e-2)
#: Tokens of a gradient step, and of a scored batch.
STEP, BATCH = 2048, 8192
#: Tokens of a shard, about.
SHARD = 4_000_000
#: Rows of the weight tables that are summed together when tables are averaged.
BLOCK = 1024
#: Occurrences from which the kinds of texts that a word occurs in tell its group; of others, their suffix does.
PROFILED = 8
#: Words counted in memory before they are handed on.
HELD = 400_000

LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def tokens(text: bytes | None) -> list[bytes]:
    """The words of a text, in ASCII lower case; bytes.split() parts at the blank and the bytes 9 to 13."""
    return (text or b"").translate(LOWER).split()


def is_held_out(id_col: Column) -> Column:
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 1, F.lit(False))


# -- counts


def count_words(texts: DataFrame) -> DataFrame:
    """(word, n, k0, k1, ..) of a table with the one column text: how often each word occurs, in all and by kind of text;
    the empty word counts the ends."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds: list[Counter] = [Counter() for _ in range(KINDS)]
        ends = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for k, c in enumerate(kinds):
                if c:
                    yield _counted(list(c), k, list(c.values()))
                c.clear()

        for b in batches:
            for portion in _portions(b.column(0)):
                for text in portion:
                    if own := tokens(text):
                        seen = Counter(own)
                        most = max(seen.values())
                        kinds[zlib.crc32(max(w for w, n in seen.items() if n == most)) % KINDS].update(own)
                ends += len(portion)
                if sum(map(len, kinds)) > HELD:
                    yield from flush()
        yield from flush()
        if ends:
            yield _counted([b""], 0, [ends])

    counted = texts.mapInArrow(run, "word binary, kind int, n long").repartition("word")
    by_kind = [F.coalesce(F.sum(F.when(F.col("kind") == k, F.col("n"))), F.lit(0)).alias(f"k{k}") for k in range(KINDS)]
    return counted.groupBy("word").agg(F.sum("n").alias("n"), *by_kind)


def _counted(words: list[bytes], kind: int, n: list[int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(np.full(len(words), kind), pa.int32()), pa.array(n, pa.int64())], ["word", "kind", "n"])


# -- classes, on the driver, from tables of fixed size


@dataclass
class Vocabulary:
    """What workers need to turn words into numbers. Number HEAD-size + g stands for rare words of group g;
    after those come the end and the begin of a text."""

    words: list[bytes]
    suffixes: dict[bytes, int]
    class_of: np.ndarray
    own: np.ndarray  # log10 of a token's share of its class; 0 for rare words, whose share is joined
    base: np.ndarray  # log10 of the base probability; 0 for rare words
    bias: np.ndarray  # log of each class's share of all tokens
    path: np.ndarray  # where each word's path begins in nodes and branches; one more for the last one's end
    nodes: np.ndarray
    branches: np.ndarray
    shares: np.ndarray  # log of each branch's share of its node; far below any where there is no branch

    @property
    def end(self) -> int:
        return len(self.words) + GROUPS


def grow(words: list[np.ndarray], mass: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """path, nodes, branches and shares of the words of each class, given in the order in which they are cut. A node's words
    are cut into WIDTH parts of about equal mass, none empty."""
    steps: list[tuple[np.ndarray, int, int]] = []  # words, node, branch; by depth, so paths come in order
    shares: list[np.ndarray] = []
    level = [own for own in words if len(own) > 1]
    while level:
        below = []
        for own in level:
            sums = np.cumsum(mass[own])
            cuts = np.searchsorted(sums, sums[-1] / WIDTH * np.arange(1, WIDTH), side="right")
            # at least one word a part, as long as there are words
            parts = min(WIDTH, len(own))
            cuts = np.maximum.accumulate(cuts[: parts - 1] - np.arange(1, parts)) + np.arange(1, parts)
            cuts = np.minimum(np.maximum(cuts, np.arange(1, parts)), len(own) - parts + np.arange(1, parts))
            share = np.full(WIDTH, -1e4, np.float32)
            for branch, part in enumerate(np.split(own, cuts)):
                share[branch] = np.log(mass[part].sum() / sums[-1])
                steps.append((part, len(shares), branch))
                if len(part) > 1:
                    below.append(part)
            shares.append(share)
        level = below
    depth = np.zeros(len(mass), np.int64)
    sizes = [len(part) for part, _, _ in steps]
    of = np.concatenate([np.zeros(0, np.int64), *[part for part, _, _ in steps]]).astype(np.int64)
    np.add.at(depth, of, 1)
    order = np.argsort(of, kind="stable")
    node, branch = (np.repeat(np.array([s[k] for s in steps], np.int64), sizes)[order] for k in (1, 2))
    return np.concatenate([[0], np.cumsum(depth)]), node.astype(np.int32), branch.astype(np.int32), np.array(shares, np.float32).reshape(-1, WIDTH)


def cluster(profile: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Groups of rows by k-means, started from rows far apart; the same each time."""
    if not len(profile):
        return np.zeros(0, np.int64)
    heavy = np.argsort(-weight, kind="stable")[:512]
    centres = [profile[heavy[0]]]
    while len(centres) < GROUPS:
        apart = np.min([((profile[heavy] - c) ** 2).sum(axis=1) for c in centres], axis=0) * np.sqrt(weight[heavy])
        centres.append(profile[heavy[int(np.argmax(apart))]])
    at, c = None, np.array(centres)
    for _ in range(12):
        at = np.argmin(((profile**2).sum(axis=1)[:, None] - 2 * profile @ c.T) + (c**2).sum(axis=1)[None, :], axis=1)
        for g in range(GROUPS):
            if (own := at == g).any():
                c[g] = (profile[own] * weight[own, None]).sum(axis=0) / weight[own].sum()
    return at


def build_vocabulary(counts: DataFrame, head: int = HEAD) -> tuple[Vocabulary, DataFrame, dict]:
    """The vocabulary; the counts of rare words with their group (word, n, g); N, V and, by group, the mass
    and the unknown mass of rare words."""
    spark = counts.sparkSession
    exact = counts.where("length(word) > 0").select("word", "n")
    figures = exact.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()
    ends = counts.where("length(word) = 0").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    n_tokens, n_types = figures["n"] + ends, figures["v"] + (1 if ends else 0)
    # how many words have each count up to 65536: that many rows at most
    by_count = sorted(((r["c"], r["k"]) for r in exact.groupBy(F.least("n", F.lit(65_536)).alias("c")).agg(F.count(F.lit(1)).alias("k")).collect()), reverse=True)
    least, held = 65_537, 0
    for c, k in by_count:
        if held + k > head:
            break
        least, held = c, held + k
    table = counts.where((F.length("word") > 0) & (F.col("n") >= least)).toArrow()  # head rows at most
    n, names = table.column("n").to_pylist(), table.column("word").to_pylist()
    order = sorted(range(len(names)), key=lambda i: (-n[i], names[i]))
    words, c = [names[i] for i in order], np.array([n[i] for i in order], np.float64)
    profile = np.stack([table.column(f"k{k}").to_numpy().astype(np.float32) for k in range(KINDS)], axis=1)[order]
    del table, names, n
    known = c >= PROFILED
    profile[known] = np.sqrt(profile[known] / profile[known].sum(axis=1, keepdims=True))
    group = np.full(len(words), -1)
    group[known] = cluster(profile[known], c[known])
    votes: dict[bytes, np.ndarray] = {}
    for i in np.flatnonzero(known)[min(1000, int(known.sum()) // 2) :]:
        votes.setdefault(words[i][-3:], np.zeros(GROUPS))[group[i]] += 1
    common = sorted(votes, key=lambda s: (-votes[s].sum(), s))[:SUFFIXES]
    suffixes = {s: int(np.argmax(votes[s])) for s in common}
    for i in np.flatnonzero(~known):
        group[i] = suffixes.get(words[i][-3:], 0)

    size = len(words)
    class_of = np.concatenate([group, GROUPS + np.arange(GROUPS), [CLASSES - 1]]).astype(np.int32)
    by_suffix = np.array(sorted(range(size), key=lambda i: (words[i][::-1], i)), np.int64)
    tree = grow([by_suffix[group[by_suffix] == g] for g in range(GROUPS)], np.concatenate([c + 0.5, np.zeros(GROUPS + 1)]))

    ending = spark.createDataFrame(pa.table({"suffix": pa.array(list(suffixes), pa.binary()), "g": pa.array(list(suffixes.values()), pa.int32())}))
    rare = exact.where(F.col("n") < least).withColumn("suffix", F.substring("word", -3, 3)).join(F.broadcast(ending), "suffix", "left")
    rare = rare.select("word", "n", F.coalesce("g", F.lit(0)).alias("g"))
    mass, new, rare_tokens = np.zeros(GROUPS), np.full(GROUPS, 0.5), np.zeros(GROUPS)
    for r in rare.groupBy("g").agg(F.sum(F.col("n") + 0.5).alias("m"), F.sum("n").alias("n"), F.count_if(F.col("n") == 1).alias("once")).collect():  # a row a group
        mass[r["g"]], new[r["g"]], rare_tokens[r["g"]] = r["m"], r["once"] + 0.5, r["n"]
    d = n_tokens + 0.5 * (n_types + 1)
    in_class = np.bincount(class_of[:size], c + 0.5, minlength=CLASSES)
    own = np.concatenate([np.log10((c + 0.5) / in_class[class_of[:size]]), np.zeros(GROUPS + 1)])
    base = np.concatenate([np.log10((c + 0.5) / d), np.zeros(GROUPS), [np.log10((ends + 0.5) / d)]])
    of_class = np.bincount(class_of[:size], c, minlength=CLASSES) + 0.5
    of_class[GROUPS:-1] += rare_tokens
    of_class[-1] += ends
    vocabulary = Vocabulary(words, suffixes, class_of, own, base, np.log(of_class / of_class.sum()).astype(np.float32), *tree)
    return vocabulary, rare, {"n": n_tokens, "v": n_types, "ends": ends, "d": d, "rare": mass + new, "new": new}


# -- the model


#: Bytes whose powers are kept, and the odd number whose powers they are.
KEPT, ODD = 1 << 18, 0x2545F4914F6CDD1D
INSIDE = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
_powers: list[np.ndarray] = []


def _word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A polynomial of each word's bytes modulo 2 ** 64, from sums over all bytes before its ends."""
    power = lambda x, n: np.concatenate([[np.uint64(1)], np.cumprod(np.full(n - 1, x, np.uint64))])
    pair = _powers
    if len(data) > KEPT or not _powers:
        pair = [power(np.uint64(x), max(len(data), KEPT)) for x in (ODD, pow(ODD, -1, 1 << 64))]
        if len(data) <= KEPT:
            _powers[:] = pair
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(data * pair[0][: len(data)], out=sums[1:])
    out = (sums[ends] - sums[starts]) * pair[1][starts] + (ends - starts).astype(np.uint64) * B
    return (out ^ out >> np.uint64(29)) * A


def split_words(text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where the words of a text begin and end, and a hash of each, which two words share with a probability of about
    2 ** -64."""
    data = np.frombuffer(text, np.uint8)
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = INSIDE[data]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    out, i = np.empty(len(starts), np.uint64), 0
    while i < len(starts):  # some words at a time, so that memory doesn't grow with a text
        at = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, at + KEPT, side="right")))
        out[i:j] = _word_hashes(data[at : ends[j - 1]], starts[i:j] - at, ends[i:j] - at)
        i = j
    return starts, ends, out


_numbers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


class Encoder:
    """Words to numbers, by a table of hashes with linear probing that is built once in a worker process."""

    def __init__(self, vocabulary: Vocabulary, key: int):
        if key not in _numbers:
            _numbers.clear()
            _numbers[key] = self._table(vocabulary.words)
        self.keys, self.values = _numbers[key]
        self.suffixes, self.size, self.end = vocabulary.suffixes, len(vocabulary.words), vocabulary.end

    @staticmethod
    def _table(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        hashed = split_words(b" ".join(words))[2]
        bits = max(4, (4 * len(words)).bit_length())
        keys, values = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32)
        left, home = np.arange(len(words)), (hashed >> np.uint64(64 - bits)).astype(np.int64)
        while len(left):
            slot = home[left]
            free = np.flatnonzero(values[slot] < 0)
            _, one = np.unique(slot[free], return_index=True)  # the first word for each free slot
            keys[slot[free[one]]], values[slot[free[one]]] = hashed[left[free[one]]], left[free[one]]
            left = np.delete(left, free[one])
            home[left] = (home[left] + 1) & ((1 << bits) - 1)
        return keys, values

    def find(self, hashed: np.ndarray) -> np.ndarray:
        """The number of each word, or -1."""
        out, left = np.full(len(hashed), -1, np.int32), None
        slot = (hashed >> np.uint64(64 - (len(self.keys).bit_length() - 1))).astype(np.int64)
        while left is None or len(left):
            value = self.values[slot]
            same = (self.keys[slot] == hashed) & (value >= 0)
            on = np.flatnonzero(~same & (value >= 0))
            out[same if left is None else left[same]] = value[same]
            left = on if left is None else left[on]
            hashed, slot = hashed[on], (slot[on] + 1) & (len(self.keys) - 1)
        return out

    def __call__(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[int, bytes]]]:
        """Numbers of all tokens, the mark of each text's first one, the text of each token, and the rare words with the
        number of their text."""
        own = b"\n".join([t or b"" for t in texts]).translate(LOWER)
        starts, ends, hashed = split_words(own)
        found = self.find(hashed)
        bounds = np.concatenate([[0], np.cumsum([len(t or b"") + 1 for t in texts])])
        sizes = np.diff(np.searchsorted(starts, bounds)) + 1
        text = np.repeat(np.arange(len(texts)), sizes)
        last = np.cumsum(sizes) - 1
        ids, word = np.empty(len(text), np.int32), np.ones(len(text), bool)
        word[last], ids[last] = False, self.end
        at = np.flatnonzero(found < 0)
        odd = [own[i:j] for i, j in zip(starts[at].tolist(), ends[at].tolist(), strict=True)]
        if odd:
            found[at] = [self.size + self.suffixes.get(w[-3:], 0) for w in odd]
        ids[word] = found
        first = np.zeros(len(ids), bool)
        first[last - sizes + 1] = True
        return ids, first, text, list(zip(text[word][at].tolist(), odd, strict=True))


A, B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
SHIFT = np.uint64(64 - ROWS.bit_length() + 1)


def hashes(ids: np.ndarray, first: np.ndarray, begin: int) -> np.ndarray:
    """(tokens, 2) hashes of the features: the last token, and the one before it. first marks the first token of a
    text; what is before it is ``begin``."""
    one = np.empty(len(ids), np.uint64)
    one[1:], one[:1] = ids[:-1], begin
    one[first] = begin
    two = np.empty(len(ids), np.uint64)
    two[1:], two[:1] = one[:-1], begin
    two[first] = begin
    return np.stack([(one + np.uint64(1)) * A, (two + np.uint64(7)) * B], axis=1)


def features(ids: np.ndarray, first: np.ndarray, begin: int) -> np.ndarray:
    """(tokens, 2) rows of the table of classes."""
    return (hashes(ids, first, begin) >> SHIFT).astype(np.int32)


def steps_down(v: Vocabulary, ids: np.ndarray, hashed: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of all steps on the paths of the tokens: (steps, 2) rows of the table of nodes, the node, the branch taken, and the
    token's index."""
    begin, end = v.path[ids], v.path[ids + 1]
    n = end - begin
    token = np.repeat(np.arange(len(ids)), n)
    at = np.arange(len(token)) + np.repeat(begin - np.cumsum(n) + n, n)
    node = v.nodes[at]
    mixed = (hashed.take(token, axis=0) ^ ((node.astype(np.uint64) + np.uint64(1)) * B)[:, None]) * A
    return (mixed >> SHIFT).astype(np.int32), node, v.branches[at], token


def class_logits(table: np.ndarray, rows: np.ndarray, given: np.ndarray | None = None) -> np.ndarray:
    """Sums of the rows and of what is always on: the last row, or the shares given."""
    z = table.take(rows[:, 0], axis=0)
    z += table.take(rows[:, 1], axis=0)
    z += table[ROWS] if given is None else given
    return z


def exponentials(z: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray | float]:
    """exp(z - top), in place, its sums by row, and top: zero where that is safe, since maxima of short rows take longer
    than all the rest."""
    if z.max(initial=0) < 60:
        held = np.exp(z)
        sums = np.einsum("ij->i", held)
        if sums.min(initial=1) > 1e-30:
            return held, sums, 0.0
    top = z.max(axis=1, initial=-1e30)
    z -= top[:, None]
    np.exp(z, out=z)
    return z, z.sum(axis=1), top


def softmax(z: np.ndarray) -> np.ndarray:
    out, sums, _ = exponentials(z)
    out /= sums[:, None]
    return out


def log_shares(z: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The logarithm of the target's probability in each row of logits."""
    own = z[np.arange(len(z)), target].astype(np.float64)
    _, sums, top = exponentials(z)
    return own - top - np.log(sums.astype(np.float64))


def sum_segments(values: np.ndarray, edge: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of the rows of ``values`` by segment, of n rows from edge on. Most segments are short, and a few hold most
    rows; either kind goes faster on its own than all together."""
    out = values[edge]
    for k in range(1, 4):
        longer = np.flatnonzero(n > k)
        out[longer] += values[edge[longer] + k]
    for i in np.flatnonzero(n > 4):
        out[i] += values[edge[i] + 4 : edge[i] + n[i]].sum(axis=0)
    return out


class Trainer:
    """Gradient steps with a rate for each feature that falls with its squared gradients so far."""

    def __init__(self, table: np.ndarray):
        self.table, self.squares = table.copy(), np.full(len(table), LEAST_SQUARE, np.float32)

    def step(self, rows: np.ndarray, target: np.ndarray, given: np.ndarray | None = None) -> None:
        """One step for all rows of features; with ``given``, the row that is always on stays as it is."""
        g = softmax(class_logits(self.table, rows, given))
        g[np.arange(len(target)), target] -= 1
        flat = rows.ravel().astype(np.uint16)
        order = np.argsort(flat, kind="stable")
        sorted_rows = flat[order]
        edge = np.flatnonzero(np.concatenate([[True], sorted_rows[1:] != sorted_rows[:-1]]))
        n = np.diff(np.append(edge, len(flat)))
        sums = sum_segments(g.take(order // 2, axis=0), edge, n)
        sums /= np.sqrt(n, dtype=np.float32)[:, None]
        self._move(sorted_rows[edge], sums)
        if given is None:
            self._move(np.array([ROWS]), g.sum(axis=0, keepdims=True) / np.sqrt(np.float32(len(target))))

    def _move(self, rows: np.ndarray, gradient: np.ndarray) -> None:
        squares = self.squares[rows] + np.einsum("ij,ij->i", gradient, gradient)
        self.squares[rows] = squares
        gradient *= (RATE / np.sqrt(squares))[:, None]
        self.table[rows] -= gradient


def _portions(column: pa.Array, most: int = 400_000) -> Iterator[list[bytes | None]]:
    """The texts of a batch in portions of about ``most`` bytes, so that few are held as Python objects at once."""
    out, held = [], 0
    for i in range(0, len(column), 64):
        for t in column.slice(i, 64).to_pylist():
            out.append(t)
            held += len(t or b"")
        if held >= most:
            yield out
            out, held = [], 0
    if out:
        yield out


def train(texts: DataFrame, vocabulary, key: int, tables: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The weight tables of classes and nodes after one round: gradient steps over the texts of every shard (shard, text;
    one after the other), from ``tables``, averaged. vocabulary is a broadcast."""
    spark = texts.sparkSession
    sent = spark.sparkContext.broadcast(tables)

    def tables_of(shard: int, trainers: tuple[Trainer, Trainer]) -> Iterator[pa.RecordBatch]:
        for which, t in enumerate(trainers):
            for i in range(0, len(t.table), BLOCK):
                seen = t.squares[i : i + BLOCK, None] - LEAST_SQUARE
                if seen.any():
                    data = np.concatenate([t.table[i : i + BLOCK] * seen, seen], axis=1).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.array([which], pa.int32()), pa.array([i // BLOCK], pa.int32()), pa.array([shard], pa.int32()), pa.array([data], pa.binary())], ["which", "block", "shard", "data"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary.value
        encoder, shard, trainers = Encoder(v, key), None, None
        for b in batches:
            of = b.column(0).to_numpy()
            edges = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])).tolist() if len(of) else []
            for begin, end in zip(edges, [*edges[1:], len(of)], strict=True):
                if of[begin] != shard:
                    if trainers:
                        yield from tables_of(shard, trainers)
                    shard, trainers = int(of[begin]), tuple(map(Trainer, sent.value))
                for portion in _portions(b.column(1).slice(begin, end - begin)):
                    ids, first, _, _ = encoder(portion)
                    hashed = hashes(ids, first, v.end + 1)
                    for i in range(0, len(ids), STEP):
                        part, own = hashed[i : i + STEP], ids[i : i + STEP]
                        trainers[0].step((part >> SHIFT).astype(np.int32), v.class_of[own])
                        rows, node, branch, _ = steps_down(v, own, part)
                        if len(rows):
                            trainers[1].step(rows, branch, v.shares.take(node, axis=0))
        if trainers:
            yield from tables_of(shard, trainers)

    def add(pdf):
        import pandas as pd

        pdf = pdf.sort_values("shard")
        total = np.zeros(len(pdf["data"].iloc[0]) // 4, np.float64)
        for data in pdf["data"]:
            total += np.frombuffer(data, np.float32)
        return pd.DataFrame({"which": [pdf["which"].iloc[0]], "block": [pdf["block"].iloc[0]], "shard": [pdf["shard"].iloc[0]], "data": [total.astype(np.float32).tobytes()]})

    schema = "which int, block int, shard int, data binary"
    # two levels, so that no task holds more than a few hundred blocks
    parts = texts.mapInArrow(run, schema).groupBy("which", "block", F.floor(F.col("shard") / 256)).applyInPandas(add, schema)
    summed = parts.groupBy("which", "block").applyInPandas(add, schema).collect()  # the two tables, a few MB each
    sent.destroy()
    out = tables[0].copy(), tables[1].copy()
    for r in summed:
        table = out[r["which"]]
        own = np.frombuffer(r["data"], np.float32).reshape(-1, table.shape[1] + 1)
        rows = slice(r["block"] * BLOCK, r["block"] * BLOCK + len(own))
        seen = own[:, -1:]
        table[rows] = np.where(seen > 0, own[:, :-1] / np.where(seen > 0, seen, 1), table[rows])
    return out


def in_shards(texts: DataFrame, tokens: int) -> DataFrame:
    """(shard, text) of texts (doc_id, text), dealt to shards of about SHARD of the given number of tokens by a hash,
    each sorted by it. A partition may have several shards, which are trained one after the other."""
    shards = max(1, -(-tokens // SHARD))
    held = texts.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(shards)).cast("int").alias("shard"), "text", F.xxhash64("text", "doc_id").alias("place"))
    return held.repartition(4 * shards, "shard").sortWithinPartitions("shard", "place").select("shard", "text")


PARTIAL = "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base double, score double, word binary, n long"


def score_texts(docs: DataFrame, vocabulary, key: int, tables: tuple[np.ndarray, np.ndarray], figures: dict) -> DataFrame:
    """docs: (doc_id, held_out, text). A row per text with the sums over the dictionary's words, whose column
    word is null, and a row for each rare word of a text; the column row ties them together."""
    sent = docs.sparkSession.sparkContext.broadcast(tables)
    known_end = int(figures["ends"] > 0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, (classes, inner) = vocabulary.value, sent.value
        encoder, row = Encoder(v, key), TaskContext.get().partitionId() << 36
        size = len(v.words)
        for b in batches:
            at = 0
            for portion in _portions(b.column(2)):
                ids, first, text, rare = encoder(portion)
                hashed, logs = hashes(ids, first, v.end + 1), np.empty(len(ids))
                for i in range(0, len(ids), BATCH):
                    part, own = hashed[i : i + BATCH], ids[i : i + BATCH]
                    logs[i : i + BATCH] = log_shares(class_logits(classes, (part >> SHIFT).astype(np.int32)), v.class_of[own])
                    rows, node, branch, token = steps_down(v, own, part)
                    if len(rows):
                        logs[i : i + BATCH] += np.bincount(token, log_shares(class_logits(inner, rows, v.shares.take(node, axis=0)), branch), minlength=len(own))
                k = len(portion)
                score = np.bincount(text, logs / np.log(10), minlength=k)
                base = np.bincount(text, v.base[ids], minlength=k)
                n = np.bincount(text, minlength=k)
                known = np.bincount(text, (ids < size), minlength=k).astype(np.int64) + known_end
                numbers = pa.array(np.arange(row, row + k))
                none = pa.nulls(k, pa.binary())
                yield pa.RecordBatch.from_arrays([numbers, b.column(0).slice(at, k), b.column(1).slice(at, k), pa.array(n), pa.array(known), pa.array(base), pa.array(score), none, pa.nulls(k, pa.int64())], _NAMES)
                odd = [(row + i, w, c) for (i, w), c in Counter(rare).items()]
                if odd:
                    of, words, times = zip(*odd, strict=True)
                    m = len(odd)
                    yield pa.RecordBatch.from_arrays([pa.array(of, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.bool_()), *[pa.nulls(m, pa.int64())] * 2, *[pa.nulls(m, pa.float64())] * 2, pa.array(words, pa.binary()), pa.array(times, pa.int64())], _NAMES)
                row += k
                at += k

    return docs.mapInArrow(run, PARTIAL)


_NAMES = [x.split()[0] for x in PARTIAL.split(", ")]


def lm_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD, rounds: int = 1) -> DataFrame:
    """Learns from the rows of docs that aren't held out (crc32 of the id's text modulo 5 is 1) and scores all.

    Returns doc_id, held_out, n_tokens (words and one end), n_known (those seen in training), train_tokens,
    base_score (smoothed word frequencies) and score (the model's), both log10 probabilities of the whole text.
    Unknown words count as one outcome in either: in the model, one for each group of rare words, with the mass
    of words seen once. A null text is empty; rows with a null id are learned from; repeated rows count each;
    other columns are ignored; an empty table gives an empty result; long texts are read whole, in portions of texts.
    """
    spark = docs.sparkSession
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), is_held_out(docs[id_col]).alias("held_out"), docs[text_col].cast("string").cast("binary").alias("text"))
    training = own.where(~F.col("held_out")).select("doc_id", "text")
    counts = materialise(count_words(training.select("text")), "lm-counts")
    vocabulary, rare, figures = build_vocabulary(counts, head)
    rare = materialise(rare, "lm-rare")
    sent, key = spark.sparkContext.broadcast(vocabulary), zlib.crc32(b"".join(vocabulary.words)) << 32 | len(vocabulary.words)
    tables = np.zeros((ROWS + 1, CLASSES), np.float32), np.zeros((ROWS + 1, WIDTH), np.float32)
    tables[0][ROWS] = vocabulary.bias
    for _ in range(rounds):
        tables = train(in_shards(training, figures["n"]), sent, key, tables)
    partial = materialise(score_texts(own, sent, key, tables, figures), "lm-scores")

    unknown = spark.createDataFrame(list(vocabulary.suffixes.items()) or [(b"", 0)], "suffix binary, h int")
    shares = F.array(*[F.lit(float(x)) for x in figures["rare"]])
    news = F.array(*[F.lit(float(x)) for x in figures["new"]])
    odd = partial.where("word is not null").select("row", "word", F.col("n").alias("times"))
    odd = odd.join(rare, "word", "left").withColumn("suffix", F.substring("word", -3, 3)).join(F.broadcast(unknown), "suffix", "left")
    group = F.coalesce("g", "h", F.lit(0))
    c = F.coalesce("n", F.lit(0))
    share = F.when(c > 0, c + 0.5).otherwise(F.get(news, group)) / F.get(shares, group)
    odd = odd.groupBy("row").agg(
        F.sum("times").alias("odd"), F.sum(F.when(c > 0, F.col("times")).otherwise(0)).alias("odd_known"),
        F.sum(F.col("times") * F.log10((c + 0.5) / float(figures["d"]))).alias("odd_base"), F.sum(F.col("times") * F.log10(share)).alias("odd_score"),
    )
    zero = lambda x: F.coalesce(x, F.lit(0))
    return partial.where("word is null").join(odd, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("odd_known")).alias("n_known"), F.lit(int(figures["n"])).cast("long").alias("train_tokens"),
        (F.col("base") + zero("odd_base")).alias("base_score"), (F.col("score") + zero("odd_score")).alias("score"),
    )
