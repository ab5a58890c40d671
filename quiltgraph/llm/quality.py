"""Quality classifier: a sparse ensemble of rules over text statistics.

Statistics of the whole text are Spark column expressions. Small boosted trees over them, fitted to a
bounded sample of labelled rows, give conjunctive rules, one for each node; a logistic model with a
lasso penalty chooses and weighs rules. The rules that remain are compiled into one column
expression, so that scoring is a projection without Python.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quiltgraph.llm.common import free_name, words

#: Labelled rows that a model is fitted to at most: those with the smallest hash of their id.
MAX_TRAIN = 20_000
TREES, DEPTH, CUTS, SHRINK, LEAST = 32, 3, 32, 0.25, 12
#: Lasso penalties that are tried; the best on a fifth of the sample is kept.
PENALTIES = (0.01, 0.003, 0.001)
STEPS = 150

Rule = tuple[tuple[str, str, float], ...]  # (statistic, "<=" or ">", cut) of each condition


def statistics() -> dict[str, Column]:
    """Statistics by name, as functions of the columns _words, _lines, _n, _others and _marks that ``with_statistics``
    makes; all are finite for any text."""
    n, size = F.greatest(F.col("_n"), F.lit(1)), F.greatest(F.size("_words"), F.lit(1))
    # characters are counted by taking them out, among those that are neither lower-case nor blank: a small part of most texts
    count = lambda chars: F.char_length("_marks") - F.char_length(F.regexp_replace("_marks", f"[{chars}]+", ""))
    one = lambda c: F.char_length("_marks") - F.char_length(F.replace(F.col("_marks"), F.lit(c)))
    w = F.col("_words")
    return {
        "log_chars": F.log1p(F.col("_n")),
        "log_words": F.log1p(F.size("_words")),
        "word_length": n / size,
        "exclamations": one("!") / size,
        "bars": one("|") / size,
        "symbols": count(r"#$%&*@~^+=_<>{}\[\]\\/") / n,
        "digits": count("0-9") / n,
        "upper": count(r"\p{Lu}") / n,
        "lower_ascii": (F.col("_n") - F.char_length("_others")) / n,
        "stops": one(".") / size,
        "commas": one(",") / size,
        "quotes": count("\"'`:;?()") / n,
        "lines": F.size("_lines") / size,
        "distinct_lines": F.size(F.array_distinct("_lines")) / F.greatest(F.size("_lines"), F.lit(1)),
        "distinct_words": F.size(F.array_distinct("_words")) / size,
        "repeats": F.size(F.filter(w, lambda x, i: (i > 0) & (x == F.get(w, i - 1)))) / size,
    }


NAMES = ("log_chars", "log_words", "word_length", "exclamations", "bars", "symbols", "digits", "upper", "lower_ascii", "stops", "commas", "quotes", "lines", "distinct_lines", "distinct_words", "repeats")


def with_statistics(docs: DataFrame, text_col: str) -> DataFrame:
    """The rows of docs as a struct _row, with a column _stat_NAME for each statistic; a null text counts as
    empty."""
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    held = docs.select(F.struct("*").alias("_row"), text.alias("_text"))
    held = held.withColumns({"_words": words(F.col("_text")), "_lines": F.split("_text", "\n"), "_n": F.char_length("_text"), "_others": F.regexp_replace("_text", "[a-z]+", "")})
    held = held.withColumn("_marks", F.regexp_replace("_others", r"\s+", ""))
    return held.select("_row", *[c.cast("double").alias(f"_stat_{k}") for k, c in statistics().items()])


# -- fitting, on the bounded sample


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -35, 35)))


def tree_rules(x: np.ndarray, binned: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, weight: np.ndarray, rows: np.ndarray, chosen: np.ndarray, depth: int, path: tuple, out: list) -> None:
    """Splits ``rows`` by the cut that explains the gradient best; out gets (path, value) of every node below."""
    if not depth or len(rows) < 2 * LEAST:
        return
    g, h = gradient[rows], weight[rows]
    total_g, total_h = g.sum(), h.sum()
    base, best = total_g**2 / (total_h + 1), (1e-6, -1, 0)
    for f in chosen:
        k = len(cuts[f])
        if not k:
            continue
        b = binned[rows, f]
        left_g, left_h, left_n = (np.cumsum(np.bincount(b, v, minlength=k + 1))[:k] for v in (g, h, None))
        gain = left_g**2 / (left_h + 1) + (total_g - left_g) ** 2 / (total_h - left_h + 1) - base
        gain[(left_n < LEAST) | (len(rows) - left_n < LEAST)] = -1
        at = int(np.argmax(gain))
        if gain[at] > best[0]:
            best = gain[at], int(f), at
    _, f, at = best
    if f < 0:
        return
    goes = binned[rows, f] <= at
    for side, part in (("<=", rows[goes]), (">", rows[~goes])):
        longer = (*path, (f, side, at))
        out.append((longer, gradient[part].sum() / (weight[part].sum() + 1), part))
        tree_rules(x, binned, cuts, gradient, weight, part, chosen, depth - 1, longer, out)


def extract_rules(x: np.ndarray, y: np.ndarray, seed: int = 7) -> list[Rule]:
    """The distinct rules of boosted trees, each grown on half of the rows and of the statistics."""
    rng, n = np.random.default_rng(seed), len(y)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, CUTS + 1)[1:-1])) for f in range(x.shape[1])]
    cuts = [c[c < x[:, f].max()] if len(c) else c for f, c in enumerate(cuts)]
    binned = np.stack([np.searchsorted(c, x[:, f], side="left") for f, c in enumerate(cuts)], axis=1)
    rules: dict[Rule, None] = {}
    z = np.full(n, np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
    for _ in range(TREES):
        p = _sigmoid(z)
        chosen = np.sort(rng.choice(x.shape[1], max(1, x.shape[1] // 2), replace=False))
        rows = np.flatnonzero(rng.random(n) < 0.5)
        nodes: list = []
        tree_rules(x, binned, cuts, y - p, p * (1 - p), rows, chosen, DEPTH, (), nodes)
        for path, value, _ in nodes:
            held = np.ones(n, bool)
            for f, side, at in path:
                held &= (binned[:, f] <= at) == (side == "<=")
            if len(path) == DEPTH or not any(other[: len(path)] == path and len(other) > len(path) for other, _, _ in nodes):
                z = z + SHRINK * np.clip(value, -4, 4) * held
            rules[_merged(path, cuts)] = None
    return list(rules)


def _merged(path: tuple, cuts: list[np.ndarray]) -> Rule:
    """Conditions by statistic name, the tightest of each kind."""
    tight: dict[tuple[str, str], float] = {}
    for f, side, at in path:
        cut, key = float(cuts[f][at]), (NAMES[f], side)
        tight[key] = cut if key not in tight else (min if side == "<=" else max)(tight[key], cut)
    return tuple((k, side, cut) for (k, side), cut in sorted(tight.items()))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, side, cut in rule:
        v = x[:, NAMES.index(name)]
        out &= v <= cut if side == "<=" else v > cut
    return out


def lasso_logistic(a: np.ndarray, y: np.ndarray, penalty: float, start: tuple[float, np.ndarray] | None = None) -> tuple[float, np.ndarray]:
    """Intercept and weights of least logistic loss plus penalty times the sum of absolute weights, by
    accelerated proximal gradient steps."""
    n, k = a.shape
    mean = y.mean()
    b, w = start if start is not None else (float(np.log((mean + 1e-3) / (1 - mean + 1e-3))), np.zeros(k, np.float32))
    # single precision throughout: the products are over all rows and rules
    y, v = y.astype(np.float32), np.full(k, 1 / np.sqrt(max(k, 1)), np.float32)
    for _ in range(20):  # the largest singular value, for the step size
        u = a.T @ (a @ v)
        v = u / (np.linalg.norm(u) + 1e-12)
    rate = float(1 / (0.25 * (np.linalg.norm(a @ v) ** 2 / n + 1) * 1.1))
    pb, pw, t = b, w.copy(), 1.0
    for _ in range(STEPS):
        r = _sigmoid(a @ pw + pb) - y
        nb, nw = pb - rate * float(r.mean()), pw - rate * (a.T @ r) / n
        nw = np.sign(nw) * np.maximum(np.abs(nw) - rate * penalty, 0)
        nt = (1 + (1 + 4 * t * t) ** 0.5) / 2
        pb, pw = nb + (t - 1) / nt * (nb - b), nw + (t - 1) / nt * (nw - w)
        b, w, t = nb, nw, nt
    return float(b), w


@dataclass
class RuleModel:
    intercept: float = 0.0
    rules: list[tuple[Rule, float]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.intercept + sum(w * holds(r, x) for r, w in self.rules))

    def column(self) -> Column:
        """The score as an expression over the _stat_ columns."""
        z = F.lit(self.intercept)
        for rule, weight in self.rules:
            held = F.lit(True)
            for name, side, cut in rule:
                c = F.col(f"_stat_{name}")
                held = held & ((c <= cut) if side == "<=" else (c > cut))
            z = z + F.when(held, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def fit_rules(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """A model for statistics x (columns as in NAMES) and labels y (0 or 1). Without both labels, a constant."""
    if len(set(y.tolist())) < 2:
        return RuleModel(float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))))
    rules = extract_rules(x, y)
    a = np.stack([holds(r, x) for r in rules], axis=1).astype(np.float32) if rules else np.zeros((len(y), 0), np.float32)
    check = np.arange(len(y)) % 5 == 0
    best, start = (np.inf, PENALTIES[0]), None
    if check.any() and len(set(y[~check].tolist())) == 2:
        for penalty in PENALTIES:
            start = b, w = lasso_logistic(a[~check], y[~check], penalty, start)
            p = np.clip(_sigmoid(a[check] @ w + b), 1e-6, 1 - 1e-6)
            loss = -np.mean(y[check] * np.log(p) + (1 - y[check]) * np.log(1 - p))
            if loss < best[0] - 1e-6:
                best = loss, penalty
    b, w = lasso_logistic(a, y, best[1], start)
    return RuleModel(b, [(r, float(v)) for r, v in zip(rules, w, strict=True) if abs(v) > 1e-6])


def train_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", max_train: int = MAX_TRAIN) -> RuleModel:
    """Fits to the rows of docs that labels (id_col, label_col) marks 0 or 1, at most ``max_train`` of them;
    which of them doesn't depend on how the tables are dealt out. Only the text is looked at; a null one is empty, and a
    long one is looked at whole. An id with several labels, or several texts, counts once for each pair, so conflicting
    labels pull either way. Without any labelled row the model is a constant of 0.5, and with one kind of label a
    constant near it; null ids have no label; other columns are ignored."""
    marked = labels.select(labels[id_col].cast("long").alias("_id"), labels[label_col].cast("int").alias("_label")).where("_id is not null and _label in (0, 1)")
    total = marked.count()
    if total > max_train:  # what can't be among the smallest hashes goes first, so that no task sorts all labels
        share = min(1.0, 1.2 * max_train / total)
        marked = marked.where(F.xxhash64("_id") <= int(share * 2**64) - 2**63 - 1)
    marked = marked.orderBy(F.xxhash64("_id"), "_id", "_label").limit(max_train)
    own = docs.select(docs[id_col].cast("long").alias("_id"), docs[text_col].alias("_own"))
    held = with_statistics(own.join(F.broadcast(marked), "_id").select("_id", "_label", "_own"), "_own")
    # max_train rows at most, if ids are not repeated; sorted, so that the fit is the same each time
    table = held.select("_row._id", "_row._label", *[f"_stat_{k}" for k in NAMES]).orderBy(F.xxhash64("_id"), "_id", "_label", "_stat_log_chars").limit(max_train).toArrow()
    x = np.stack([table.column(f"_stat_{k}").to_numpy() for k in NAMES], axis=1) if len(table) else np.zeros((0, len(NAMES)))
    return fit_rules(x, table.column("_label").to_numpy().astype(np.float64))


def score_quality(docs: DataFrame, model: RuleModel, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with the model's score of each row, from 0 to 1; null and empty texts are scored as empty. Where
    docs has a column of the score's name, the score gets underscores before it."""
    # Spark takes a column that names the partition for one that may change, and so doesn't move a filter on the
    # score below the projection, where every rule would compute its statistics anew
    score = F.when(F.spark_partition_id() >= 0, model.column())
    return with_statistics(docs, text_col).select("_row.*", score.alias(free_name(docs, score_col)))


def held_out(id_col: str, modulus: int) -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == 1, F.lit(False))
