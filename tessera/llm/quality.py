"""Quality classifier: a generalised additive model with pairwise interactions.

Each feature has a lookup table over its bins and some pairs of features have tables over their joint bins; a score is
the logistic of their sum. Cyclic boosting learns the tables: features take turns, each turn fits one shallow tree of
that feature alone to the current gradient and adds it, shrunk, to the feature's table. Pairs with the largest
gain on what is left follow in the same way. Scoring looks bins up and adds, a whole batch at a time.
"""

from __future__ import annotations

import itertools
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, slices, text_or_empty
from .html import STOP_WORDS

#: Labelled rows that a model is fitted on at most: those with the smallest hash.
MAX_TRAINING_ROWS = 20_000
BINS, PAIR_BINS, ROUNDS, PAIR_ROUNDS, RATE, PAIRS, LEAST_LEAF = 48, 12, 120, 40, 0.12, 8, 8
THRESHOLD = 0.3

FEATURES = (
    "log_words", "log_chars", "word_length", "long_words", "short_words", "upper_letters", "upper_words", "digits", "stop_words",
    "distinct_words", "top_word", "repeat_next", "log_lines", "line_words", "repeated_lines", "ended_lines", "period", "comma",
    "exclaim", "question", "bar", "hash", "dollar", "percent", "star", "amp", "at", "slash", "brackets", "quotes", "odd_bytes", "non_ascii",
    "symbol_words", "most_symbols",
)
_STOPS = frozenset(w.encode() for w in STOP_WORDS)
_ODD = np.array([c for c in range(33, 127) if not chr(c).isalnum() and chr(c) not in ".,'-"])


def features(text: str) -> list[float]:
    """Numbers that describe the whole text; an empty one has zeros."""
    raw = text.encode("utf-8", "replace")
    words = raw.split()
    n = len(words)
    if not n:
        return [0.0] * len(FEATURES)
    size = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    upper, lower, digits = size[65:91].sum(), size[97:123].sum(), size[48:58].sum()
    lengths = np.fromiter(map(len, words), dtype=np.int64, count=n)
    counts = Counter(words)
    low = [w.lower() for w in counts]
    stops = sum(c for w, c in zip(low, counts.values(), strict=True) if w.strip(b".,;:!?") in _STOPS)
    lines = [x for x in raw.split(b"\n") if x.strip()]
    inked = max(1, len(raw) - int(size[[32, 9, 10, 13]].sum()))
    ch = lambda c: float(size[ord(c)]) / n
    symbol_words = sum(c for w, c in counts.items() if w[-2:-1] == w[-1:] and not w[-1:].isalnum() and w[-1] < 128)
    return [
        np.log1p(n), np.log1p(len(raw)), float(lengths.mean()), float((lengths > 14).mean()), float((lengths < 4).mean()),
        float(upper) / max(1, upper + lower), sum(c for w, c in counts.items() if len(w) > 1 and w.isupper()) / n, float(digits) / inked, stops / n,
        len(counts) / n, max(counts.values()) / n, sum(map(bytes.__eq__, words, words[1:])) / n, np.log1p(len(lines)), np.log1p(n / len(lines)), 1 - len(set(lines)) / len(lines), sum(x.rstrip()[-1:] in (b".", b"!", b"?", b'"') for x in lines) / len(lines), ch("."), ch(","),
        ch("!"), ch("?"), ch("|"), ch("#"), ch("$"), ch("%"), ch("*"), ch("&"), ch("@"), ch("/"), float(size[[40, 41, 91, 93, 123, 125]].sum()) / n, float(size[[34, 39]].sum()) / n, float(size[_ODD].sum()) / inked, float(size[128:].sum()) / inked,
        symbol_words / n, float(size[_ODD].max()) / n,
    ]


def feature_rows(texts: pd.Series) -> np.ndarray:
    return np.array([features(text_or_empty(t)) for t in texts], dtype=np.float64).reshape(-1, len(FEATURES))


def _logistic(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _tree(gradient: np.ndarray, weight: np.ndarray, rows: np.ndarray, leaves: int = 4) -> np.ndarray:
    """The best step function of up to ``leaves`` steps over a feature's bins, grown cut by cut: a Newton step by bin."""
    g, h, c = (np.concatenate([[0], np.cumsum(x)]) for x in (gradient, weight, rows))
    ends = [0, len(gradient)]
    score = lambda a, b: (g[b] - g[a]) ** 2 / (h[b] - h[a] + 1.0)
    while len(ends) <= leaves:
        best = (1e-9, 0)
        for a, b in itertools.pairwise(ends):
            if b - a > 1:
                cut = np.arange(a + 1, b)
                gain = np.where((c[cut] - c[a] >= LEAST_LEAF) & (c[b] - c[cut] >= LEAST_LEAF), score(a, cut) + score(cut, b) - score(a, b), 0)
                at = int(gain.argmax())
                best = max(best, (float(gain[at]), int(cut[at])))
        if not best[1]:
            break
        ends = sorted([*ends, best[1]])
    out = np.zeros(len(gradient))
    for a, b in itertools.pairwise(ends):
        out[a:b] = (g[b] - g[a]) / (h[b] - h[a] + 1.0)
    return out


def _cross(gradient: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """The best cut in each of two directions at once: four leaves over the joint bins, and their gain."""
    g, h = (np.pad(x.cumsum(0).cumsum(1), ((1, 0), (1, 0))) for x in (gradient, weight))
    n, m = gradient.shape
    a, b = np.arange(1, n)[:, None], np.arange(1, m)[None, :]
    parts = [(g[a, b], h[a, b]), (g[a, m] - g[a, b], h[a, m] - h[a, b]), (g[n, b] - g[a, b], h[n, b] - h[a, b])]
    parts.append((g[n, m] - sum(p[0] for p in parts), h[n, m] - sum(p[1] for p in parts)))
    gain = sum(x**2 / (y + 5.0) for x, y in parts)
    i, j = np.unravel_index(int(gain.argmax()), gain.shape)
    step = [float(x[i, j] / (y[i, j] + 5.0)) for x, y in parts]
    out = np.empty((n, m))
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = step
    return out, float(gain[i, j])


@dataclass
class AdditiveModel:
    intercept: float
    edges: list[np.ndarray] = field(default_factory=list)
    tables: list[np.ndarray] = field(default_factory=list)
    pair_edges: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for j, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            z += table[np.searchsorted(edges, x[:, j], side="right")]
        for a, b, table in self.pairs:
            z += table[np.searchsorted(self.pair_edges[a], x[:, a], side="right"), np.searchsorted(self.pair_edges[b], x[:, b], side="right")]
        return _logistic(z)


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1])) if len(x) else np.empty(0)


def fit(x: np.ndarray, y: np.ndarray, rounds: int = ROUNDS, pairs: int = PAIRS) -> AdditiveModel:
    """Learn the tables. Without rows the model says 0.5; with one class only, nearly that class, always."""
    rate = (y.sum() + 0.5) / (len(y) + 1)
    model = AdditiveModel(float(np.log(rate / (1 - rate))))
    model.edges, model.pair_edges = ([_edges(x[:, j], n) for j in range(x.shape[1])] for n in (BINS, PAIR_BINS))
    model.tables = [np.zeros(len(e) + 1) for e in model.edges]
    if len(y) == 0 or y.min() == y.max():
        return model
    binned = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.edges)]
    rows = [np.bincount(b, minlength=len(t)) for b, t in zip(binned, model.tables, strict=True)]
    z = np.full(len(y), model.intercept)
    for _ in range(rounds):
        for b, table, count in zip(binned, model.tables, rows, strict=True):
            if len(table) > 1:
                p = _logistic(z)
                step = RATE * _tree(np.bincount(b, y - p, len(table)), np.bincount(b, p * (1 - p), len(table)), count)
                table += step
                z += step[b]
    coarse = [np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(model.pair_edges)]
    wide = [len(e) + 1 for e in model.pair_edges]

    def joint(a: int, b: int) -> tuple[np.ndarray, float, np.ndarray]:
        p, at = _logistic(z), coarse[a] * wide[b] + coarse[b]
        tree, gain = _cross(np.bincount(at, y - p, wide[a] * wide[b]).reshape(wide[a], wide[b]), np.bincount(at, p * (1 - p), wide[a] * wide[b]).reshape(wide[a], wide[b]))
        return tree, gain, at

    able = [j for j, w in enumerate(wide) if w > 1]
    best = sorted(((joint(a, b)[1], a, b) for a, b in itertools.combinations(able, 2)), reverse=True)[:pairs]
    tables = {(a, b): np.zeros((wide[a], wide[b])) for _, a, b in best}
    for _ in range(PAIR_ROUNDS):
        for (a, b), table in tables.items():
            tree, _, at = joint(a, b)
            table += RATE * tree
            z += RATE * tree.ravel()[at]
    model.pairs = [(a, b, t) for (a, b), t in tables.items()]
    return model


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most: int = MAX_TRAINING_ROWS) -> DataFrame:
    """(text, y) of labelled documents outside the held-out fold, ``most`` rows at most, those of the ids with the smallest hash.

    Null labels and ids are left out; labels that repeat an id count as 1 if any is 1. Of documents that repeat an id the
    one whose text has the smallest hash is used. Only the columns named here are read.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 0))
    chosen = known.groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col(label)).cast("int").alias("y")).orderBy(F.xxhash64(F.lit(5), "_id"), "_id").limit(most)
    # ``most`` rows of two numbers: the bound that lets them be broadcast
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("_id"))
    # The least hash of an id's texts is known before texts are exchanged; equal texts of one id are one row.
    return found.groupBy("_id").agg(F.min_by(F.struct("text", "y"), F.xxhash64("text")).alias("row")).select("row.text", "row.y")


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", most: int = MAX_TRAINING_ROWS) -> AdditiveModel:
    """Fit on the features of the training rows; texts stay on the executors."""
    columns = ", ".join(f"f{i} double" for i in range(len(FEATURES)))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in slices(frames, "text"):
            out = pd.DataFrame(feature_rows(f["text"]), columns=[f"f{i}" for i in range(len(FEATURES))])
            yield out.assign(y=f["y"].to_numpy())

    rows = training_rows(docs, labels, label, most).mapInPandas(run, f"{columns}, y int").toPandas()
    rows = rows.sort_values(list(rows.columns))  # the order in which tasks end must not matter
    return fit(rows.iloc[:, :-1].to_numpy(dtype=np.float64), rows["y"].to_numpy(dtype=np.float64))


def score_documents(docs: DataFrame, model: AdditiveModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row. Null texts count as empty; repeated rows are scored alike; an empty table
    gives no rows. Only doc_id and text are read."""
    kind = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # tables of a fixed number of bins

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in slices(frames, "text"):
            yield pd.DataFrame({"doc_id": f["doc_id"], "held_out": f["held_out"], "score": shared.value.score(feature_rows(f["text"]))})

    rows = docs.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "text")
    return rows.mapInPandas(run, f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op5_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; nulls, ties, repeats and empty tables: as ``score_documents`` and ``fit`` say."""
    return score_documents(docs, train(docs, labels))
