"""Quality classifier: a sparse ensemble of rules over statistics of a text.

fit() grows small gradient-boosted trees on statistics of labelled texts, takes every path from a root as a
rule (a conjunction of thresholds), and fits logistic weights to the rules under a lasso penalty, which leaves few.
score() compiles the rules that are left into one column expression over the statistics, themselves
column expressions: a corpus is scored where it is read, without a shuffle, and no row leaves the JVM.

The model is fitted on at most SAMPLE labelled rows, chosen by hash of their ids, so it costs the driver the same whatever the
corpus; that bound is a parameter. Only the text is looked at, whole.

Defined results: a null text is an empty one; an empty text has all statistics zero and a score like any other; labels other
than 0 and 1 and null ids are no labels; without labels every score is 0.5, and with one class alone its smoothed share. Rows are scored
each for itself, so repeated rows score alike; a repeated id's texts all take its label. Other columns stay as they are, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000
TREES, DEPTH, BINS, RATE = 24, 3, 32, 0.3
PENALTY = 0.002
#: Characters counted. Capital letters: those of the Latin alphabets of Western Europe.
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÑÒÓÔÕÖØÙÚÛÜÝ"
SYMBOLS = "!*$%&#|@~^<>{}[]\\=_+"
MARKS = ".,;:?"
DIGITS = "0123456789"
Rule = tuple[tuple[int, bool, float], ...]


def statistics(text: Column) -> dict[str, Column]:
    """Statistics of a text, each a double between 0 and some tens; those of words are over `_words`, see with_statistics()."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    words, lines = F.col("_words"), F.col("_lines")
    n_words, n_lines = F.greatest(F.size(words), F.lit(1)).cast("double"), F.greatest(F.size(lines), F.lit(1)).cast("double")
    share = lambda chars: (F.length(text) - F.length(F.translate(text, chars, ""))) / n
    return {
        "capitals": share(CAPITALS),
        "symbols": share(SYMBOLS),
        "marks": share(MARKS),
        "digits": share(DIGITS),
        "word_length": F.length(text) / n_words,
        "distinct_words": F.size(F.array_distinct(words)) / n_words,
        "log_words": F.log1p(F.size(words).cast("double")),
        "distinct_lines": F.size(F.array_distinct(lines)) / n_lines,
        "line_words": F.log1p(F.size(words) / n_lines),
        "compact": F.log1p(F.size(F.array_distinct(words)).cast("double")),
    }


NAMES = ["capitals", "symbols", "marks", "digits", "word_length", "distinct_words", "log_words", "distinct_lines", "line_words", "compact"]


def with_statistics(df: DataFrame, text: str) -> DataFrame:
    """(row: a struct of df's columns, stats: an array of the statistics, in the order of NAMES)."""
    t = F.coalesce(df[text], F.lit(""))
    split = df.select(
        F.struct(*(df[c] for c in df.columns)).alias("row"),
        t.alias("_t"),
        F.array_remove(F.split(F.translate(t, "\n\t\r", "   "), " "), "").alias("_words"),
        F.array_remove(F.split(t, "\n"), "").alias("_lines"),
    )
    found = statistics(F.col("_t"))
    # A generator of one row: the optimiser moves no filter and no projection across it, which would work a statistic out once for each rule.
    return split.select("row", F.explode(F.array(F.array(*(found[n] for n in NAMES)))).alias("stats"))


@dataclass(frozen=True)
class Model:
    bias: float
    rules: tuple[tuple[Rule, float], ...]


def _grow(binned: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int, least: float) -> list:
    """A tree as nested [feature, bin, left, right] or the leaf value, by histograms of bins."""

    def node(rows: np.ndarray, depth: int):
        g, h = gradient[rows].sum(), hessian[rows].sum()
        if depth and len(rows) > 1:
            best, at = 1e-6, None
            for f in range(binned.shape[1]):
                b = binned[rows, f]
                gl, hl = np.cumsum(np.bincount(b, gradient[rows], BINS + 1)), np.cumsum(np.bincount(b, hessian[rows], BINS + 1))
                gain = gl**2 / (hl + 1) + (g - gl) ** 2 / (h - hl + 1) - g**2 / (h + 1)
                gain[(hl < least) | (h - hl < least)] = 0
                k = int(gain.argmax())
                if gain[k] > best:
                    best, at = float(gain[k]), (f, k)
            if at:
                left = binned[rows, at[0]] <= at[1]
                return [*at, node(rows[left], depth - 1), node(rows[~left], depth - 1)]
        return g / (h + 1)

    return node(np.arange(len(binned)), depth)


def _apply(tree, binned: np.ndarray) -> np.ndarray:
    if not isinstance(tree, list):
        return np.full(len(binned), tree)
    f, k, left, right = tree
    return np.where(binned[:, f] <= k, _apply(left, binned), _apply(right, binned))


def _paths(tree, path: tuple = ()) -> list[tuple]:
    if not isinstance(tree, list):
        return []
    f, k, left, right = tree
    out = []
    for below, side in ((True, left), (False, right)):
        p = (*path, (f, below, k))
        out += [p, *_paths(side, p)]
    return out


def _simple(path: tuple) -> tuple:
    """The tightest bound of each feature and side."""
    bounds: dict[tuple[int, bool], int] = {}
    for f, below, k in path:
        bounds[f, below] = k if (f, below) not in bounds else (min if below else max)(k, bounds[f, below])
    return tuple(sorted((f, below, k) for (f, below), k in bounds.items()))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def lasso(x: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Logistic weights by accelerated proximal gradient; the bias is not penalised."""
    n, k = x.shape
    z = np.concatenate([np.ones((n, 1)), x], 1)
    w = v = np.zeros(k + 1)
    step = 4 * n / max(1e-9, np.linalg.norm(z.T @ z, 2))
    t = 1.0
    for _ in range(steps):
        new = v - step * z.T @ (_sigmoid(z @ v) - y) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step * penalty, 0)
        t_new = (1 + (1 + 4 * t * t) ** 0.5) / 2
        v = new + (t - 1) / t_new * (new - w)
        w, t = new, t_new
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> Model:
    """Rules and weights from statistics (rows, features) and labels 0 and 1."""
    if not len(y):
        return Model(0.0, ())
    share = (y.sum() + 0.5) / (len(y) + 1)
    if y.min() == y.max():
        return Model(float(np.log(share / (1 - share))), ())
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, BINS + 1)[1:-1])) for c in x.T]
    binned = np.stack([np.searchsorted(e, c, "left") for e, c in zip(edges, x.T, strict=True)], 1)
    score = np.full(len(y), np.log(share / (1 - share)))
    paths: dict[tuple, None] = {}
    for _ in range(TREES):
        p = _sigmoid(score)
        tree = _grow(binned, y - p, p * (1 - p), DEPTH, least=max(0.5, 1e-4 * len(y)))
        if not isinstance(tree, list):
            break
        score += RATE * _apply(tree, binned)
        paths |= dict.fromkeys(map(_simple, _paths(tree)))
    rules = [p for p in paths if all(k < len(edges[f]) for f, _, k in p)]
    hits = np.stack([np.all([(binned[:, f] <= k) == below for f, below, k in p], 0) for p in rules], 1).astype(float) if rules else np.zeros((len(y), 0))
    bias, weights = lasso(hits, y, penalty)
    kept = [(tuple((f, below, float(edges[f][k])) for f, below, k in p), float(w)) for p, w in zip(rules, weights, strict=True) if abs(w) > 1e-4]
    return Model(bias, tuple(kept))


def probability(model: Model, stats: Column) -> Column:
    """The model's score of an array of statistics, between 0 and 1."""
    total = F.lit(model.bias)
    for rule, weight in model.rules:
        held = None
        for f, below, bound in rule:
            one = stats[f] <= bound if below else stats[f] > bound
            held = one if held is None else held & one
        total = total + F.when(held, F.lit(weight)).otherwise(0.0)
    return 1 / (1 + F.exp(-total))


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 5


def train(docs: DataFrame, doc_id: str, text: str, labels: DataFrame, label_id: str, label: str, sample: int = SAMPLE) -> Model:
    """A model from labelled rows outside fold 0, at most `sample` of them."""
    chosen = (
        labels.select(labels[label_id].cast("long").alias("_id"), labels[label].cast("int").alias("_y"))
        .where(F.col("_id").isNotNull() & F.col("_y").isin(0, 1) & (fold(F.col("_id")) != 0))
        .orderBy(F.xxhash64("_id"), "_id", "_y")
        .limit(sample)
    )
    met = docs.select(docs[doc_id].cast("long").alias("_id"), docs[text].alias("_text")).join(F.broadcast(chosen), "_id")
    rows = with_statistics(met, "_text").select("row._id", "row._y", "stats").orderBy(F.xxhash64("_id"), "_id", "_y", "stats").limit(sample).collect()
    return fit(np.array([r["stats"] for r in rows]).reshape(len(rows), len(NAMES)), np.array([r["_y"] for r in rows], float))


def scored(docs: DataFrame, text: str, model: Model, into: str = "score") -> DataFrame:
    """docs with its score, in place of a column of that name."""
    columns = [c for c in docs.columns if c != into]
    found = with_statistics(docs, text)
    return found.select(*(F.col("row")[c].alias(c) for c in columns), probability(model, F.col("stats")).alias(into))


def digests(docs: DataFrame, doc_id: str, text: str, model: Model, least: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted)."""
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].alias("text"))
    found = scored(rows, "text", model)
    return found.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))


def accepted(docs: DataFrame, text: str, model: Model, least: float = 0.3) -> DataFrame:
    """docs, all columns, without rows that score below `least`."""
    found = with_statistics(docs, text)
    return found.where(probability(model, F.col("stats")) >= least).select(*(F.col("row")[c].alias(c) for c in docs.columns))
