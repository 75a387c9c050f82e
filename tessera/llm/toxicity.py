"""Toxicity by weak supervision.

Many voters, each a lexicon or a pattern, vote toxic, clean or nothing on a document. A generative label model
estimates, without looking at labels, how often each voter votes what in toxic and in clean documents and how voters
depend on each other beyond the label: each voter's vote is drawn given the label and the vote of the one other voter
that it depends on most. Its posterior labels train a linear classifier on the lexicon hits, which scores documents.

Lexicons: a fixed list of insults, and lexicons of words and word beginnings that are more frequent in toxic training
rows, so that languages without a list are covered. They are of several strengths: the weak ones hold words that clean
documents use as well, and what their votes are worth is for the label model to find out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold, slices, staged, text_or_empty
from .njoin import shingle_sets
from .quality import MAX_TRAINING_ROWS, _logistic, training_rows

THRESHOLD = 0.5
#: English insults.
INSULTS = frozenset("bastard bitch bullshit clown creep cretin damn degenerate disgusting dumb dumbass fool freak garbage idiot idiotic imbecile jerk liar loser lowlife moron moronic parasite pathetic pig scum scumbag shit stupid trash vermin worthless".split())
PREFIXES = (3, 4, 5, 6)
GROUPS = 2  # mined lexicons of each length and strength, so that voters differ
LEAST_DOCS = 5
#: Lexicon strengths: how many times as frequent a key is in toxic rows as in clean ones, at least.
STRENGTHS = (40.0, 8.0, 3.0)
#: Mutual information of two voters' votes within a label from which their dependence is modelled.
LEAST_DEPENDENCE = 0.002
#: Words, and characters of a word, whose lookups a task keeps; beyond them it looks up again.
MET_WORDS, MET_CHARS = 200_000, 40
_WORD = re.compile(r"[^\W\d_]+")
TOXIC, CLEAN, SILENT = 1, 0, -1


def keys_of(text: str) -> set[tuple[int, str]]:
    """The words (kind 0) and word beginnings (kind: their length) of the whole text, lower-cased."""
    words = set(_WORD.findall(text.lower()))
    out = {(0, w) for w in words}
    for k in PREFIXES:
        out.update((k, p) for p in {w[:k] for w in words if len(w) > k})
    return out


def one_of_each_family(rows: DataFrame) -> DataFrame:
    """(text, y) of ``rows`` with near copies thinned out: of those that share the least hash of a five-word shingle one stays.

    Near copies of one toxic document carry its other words along, which would pass for toxic ones if each copy counted.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in slices(frames, "text", 500_000):
            doc, h, _ = shingle_sets(f["text"].map(text_or_empty).tolist(), 5)
            least = np.full(len(f), np.iinfo(np.uint64).max, dtype=np.uint64)
            np.minimum.at(least, doc, h)
            yield f.assign(family=least.view(np.int64))

    return rows.select("text", "y").mapInPandas(run, "text string, y int, family long").dropDuplicates(["family", "y"]).select("text", "y")


def mine(rows: DataFrame, least_docs: int = LEAST_DOCS) -> pd.DataFrame:
    """(kind, key, strength): keys that are more frequent in toxic than in clean training rows (text, y), by class of STRENGTHS.

    Frequencies are added up in Spark over all training rows but near copies, and every key that reaches the least strength is kept:
    no more than the training rows, a bounded number, hold in ``least_docs`` documents each.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in slices(frames, "text"):
            tox, clean = Counter(), Counter()
            for text, y in zip(f["text"].map(text_or_empty), f["y"], strict=True):
                (tox if y else clean).update(keys_of(text))
            keys = list(tox | clean)
            if keys:
                yield pd.DataFrame({"kind": [k for k, _ in keys], "key": [w for _, w in keys], "toxic": [tox[k] for k in keys], "clean": [clean[k] for k in keys]})

    rows = staged(one_of_each_family(rows), "families")
    n = rows.groupBy("y").count().collect()
    n_toxic, n_clean = (max(1, sum(r["count"] for r in n if r["y"] == y)) for y in (1, 0))
    counts = rows.mapInPandas(run, "kind int, key string, toxic long, clean long").groupBy("kind", "key").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    # One more clean document than seen, so that a rare key isn't taken for a sure one.
    lift = F.col("toxic") / n_toxic / ((F.col("clean") + 1) / (n_clean + 1))
    strength = F.size(F.filter(F.array(*[F.lit(x) for x in STRENGTHS]), lambda x: x > lift))
    strong = counts.where((F.col("toxic") >= least_docs) & (lift >= STRENGTHS[-1])).select("kind", "key", strength.alias("strength"))
    return strong.toPandas().sort_values(["kind", "key"], ignore_index=True)


@dataclass
class Voters:
    """Lexicons by name: key -> the voter that holds it. The first is the fixed list."""

    names: list[str]
    of_key: dict[tuple[int, str], int]  # the voter of a key
    index: dict[tuple[int, str], int]  # its column in the classifier
    strong: list[bool]  # by voter: is it of the first strength, or fixed?
    met: dict[str, tuple[tuple[int, int], ...]] = field(default_factory=dict)  # words looked up before, by task

    def trusted(self) -> np.ndarray:
        """By vote: does it come from strong lexicons only?"""
        return np.array([*self.strong, True, True, True, True])

    def word_hits(self, word: str) -> tuple[tuple[int, int], ...]:
        """(voter, column) of each lexicon that holds the word or its beginning; the fixed list has no column (-1)."""
        found = [(0, -1)] if word in INSULTS else []
        for key in [(0, word), *[(k, word[:k]) for k in PREFIXES if len(word) > k]]:
            if key in self.of_key:
                found.append((self.of_key[key], self.index[key]))
        return tuple(found)

    def hits(self, text: str) -> tuple[Counter, dict[int, float], int]:
        """Hits by voter, key occurrences by column, number of words. A task looks a word up in the lexicons once."""
        counts = Counter(_WORD.findall(text.lower()))
        by_voter: Counter = Counter()
        columns: dict[int, float] = {}
        met = self.met
        for word, n in counts.items():
            found = met.get(word)
            if found is None:
                found = self.word_hits(word)
                if len(word) <= MET_CHARS:
                    if len(met) >= MET_WORDS:
                        met.clear()
                    met[word] = found
            for voter, column in found:
                by_voter[voter] += n
                if column >= 0:
                    columns[column] = columns.get(column, 0) + n
        return by_voter, columns, counts.total()

    def votes(self, by_voter: Counter, words: int) -> np.ndarray:
        """One vote of each lexicon, then of the patterns: hits of several lexicons, dense hits of strong ones, no hit of a strong one, none in a long text."""
        n = len(self.names)
        out = np.full(n + 4, SILENT, dtype=np.int8)
        for i in by_voter:
            out[i] = TOXIC
        strong = sum(c for i, c in by_voter.items() if self.strong[i])
        if sum(self.strong[i] for i in by_voter) >= 2:
            out[n] = TOXIC
        if strong and strong >= 0.01 * words:
            out[n + 1] = TOXIC
        if not strong:
            out[n + 2] = CLEAN
            if words >= 50:
                out[n + 3] = CLEAN
        return out


def make_voters(lexicon: pd.DataFrame) -> Voters:
    names, of_key, index, strong = ["insults"], {}, {}, [True]
    place: dict[tuple[int, int, int], int] = {}
    for kind, key, strength in zip(lexicon["kind"].tolist(), lexicon["key"].tolist(), lexicon["strength"].tolist(), strict=True):
        group = (kind, strength, zlib.crc32(key.encode()) % GROUPS)
        if group not in place:
            place[group] = len(names)
            names.append("mined-{}-{}-{}".format(*group))
            strong.append(strength == 0)
        of_key[(kind, key)] = place[group]
        index[(kind, key)] = len(index)
    return Voters(names, of_key, index, strong)


@dataclass
class LabelModel:
    """P(vote | label, the parent's vote) for each voter; a voter without a parent has the root, which always says 0."""

    prior: float
    parent: np.ndarray  # by voter, -1: none
    chance: np.ndarray  # label, voter, parent's vote, vote

    def posterior(self, votes: np.ndarray) -> np.ndarray:
        state = votes + 1
        above = np.where(self.parent >= 0, state[:, self.parent], 0)
        at = np.arange(votes.shape[1])
        z = np.log(self.chance[1, at, above, state] / self.chance[0, at, above, state]).sum(axis=1)
        return _logistic(np.log(self.prior / (1 - self.prior)) + z)


def _parents(one_hot: np.ndarray, p: np.ndarray, m: int) -> np.ndarray:
    """For each voter the voter that it depends on most within the labels: a forest of the largest conditional mutual information."""
    info = np.zeros((m, m))
    for q in (p, 1 - p):
        joint = ((one_hot * q[:, None]).T @ one_hot / max(q.sum(), 1e-9)).reshape(m, 3, m, 3).transpose(0, 2, 1, 3)
        alone = np.einsum("iiaa->ia", joint)
        with np.errstate(divide="ignore", invalid="ignore"):
            part = joint * np.log(joint / (alone[:, None, :, None] * alone[None, :, None, :]))
        info += q.mean() * np.nan_to_num(part).sum(axis=(2, 3))
    np.fill_diagonal(info, 0)
    parent, inside = np.full(m, -1), np.zeros(m, dtype=bool)
    best, via = np.zeros(m), np.full(m, -1)
    for _ in range(m):  # a maximal spanning forest, grown voter by voter
        v = int(np.where(inside, -1, best).argmax())
        inside[v] = True
        parent[v] = via[v] if best[v] >= LEAST_DEPENDENCE else -1
        closer = ~inside & (info[v] > best)
        best[closer], via[closer] = info[v][closer], v
    return parent


def label_model(votes: np.ndarray, prior: float, trusted: np.ndarray | None = None, rounds: int = 40, dependent: bool = True) -> LabelModel:
    """Expectation maximisation over P(votes | label), started from the majority of the ``trusted`` voters (all, if not given).

    Each voter gets the parent that it depends on most within the labels, as they are known half-way.
    ``dependent=False`` leaves these pairs out.
    """
    n, m = votes.shape
    prior = min(max(prior, 1e-3), 0.5)
    state, at = votes + 1, np.arange(m)
    one_hot = np.eye(3)[state].reshape(n, 3 * m)
    some = votes if trusted is None else votes[:, trusted]
    said = (some == TOXIC).sum(axis=1) - (some == CLEAN).sum(axis=1)
    p = np.where(said > 0, 0.9, 0.02)
    model = LabelModel(prior, np.full(m, -1), np.full((2, m, 3, 3), 1 / 3))
    for step in range(rounds):
        if dependent and step == rounds // 2:
            model.parent = _parents(one_hot, p, m)
        above = np.where(model.parent >= 0, state[:, model.parent], 0)
        cell = (at * 3 + above) * 3 + state
        for y, q in ((1, p), (0, 1 - p)):
            counts = np.bincount(cell.ravel(), np.repeat(q, m), 9 * m).reshape(m, 3, 3)
            # An unseen pair of votes is as likely as the vote alone.
            plain = (counts.sum(axis=1, keepdims=True) + 0.5) / (q.sum() + 1.5)
            model.chance[y] = (counts + 2 * plain) / (counts.sum(axis=2, keepdims=True) + 2)
        p = model.posterior(votes)
    return model


@dataclass
class LinearModel:
    voters: Voters
    coefficients: np.ndarray  # by lexicon key
    by_vote: np.ndarray  # by voter and pattern: toxic or clean vote
    intercept: float

    def score(self, texts: pd.Series) -> np.ndarray:
        out = np.empty(len(texts))
        for i, text in enumerate(texts.map(text_or_empty)):
            by_voter, columns, words = self.voters.hits(text)
            votes = self.voters.votes(by_voter, words)
            z = self.intercept + float(((votes == TOXIC).astype(float) - (votes == CLEAN)) @ self.by_vote)
            for c, n in columns.items():
                z += self.coefficients[c] * np.log1p(n)
            out[i] = z
        return _logistic(out)


def linear(rows: np.ndarray, columns: np.ndarray, values: np.ndarray, votes: np.ndarray, n_columns: int, target: np.ndarray, rounds: int = 300) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression on soft targets by gradient steps with momentum (Adam); features as row, column, value."""
    n, m = votes.shape
    theta = np.zeros(n_columns + m + 1)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for t in range(1, rounds + 1):
        z = np.bincount(rows, theta[columns] * values, n) + votes @ theta[n_columns:-1] + theta[-1]
        e = (_logistic(z) - target) / max(1, n)
        g = np.concatenate([np.bincount(columns, e[rows] * values, n_columns), e @ votes, [e.sum()]]) + 1e-5 * np.concatenate([theta[:-1], [0]])
        first, second = 0.9 * first + 0.1 * g, 0.99 * second + 0.01 * g * g
        theta -= 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
    return theta[:n_columns], theta[n_columns:-1], float(theta[-1])


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", most: int = MAX_TRAINING_ROWS) -> LinearModel:
    """Mine lexicons, let voters vote on the training rows, fit the label model and then the classifier.

    Labels serve for mining and for the share of toxic rows. Without labelled rows only the fixed list votes.
    """
    rows = training_rows(docs, labels, label, most)
    voters = make_voters(mine(rows))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in slices(frames, "text"):
            out = []
            for text, y in zip(f["text"].map(text_or_empty), f["y"], strict=True):
                by_voter, columns, words = voters.hits(text)
                out.append((voters.votes(by_voter, words).tolist(), list(columns), list(columns.values()), int(y)))
            yield pd.DataFrame(out, columns=["votes", "columns", "counts", "y"])

    seen = rows.mapInPandas(run, "votes array<int>, columns array<int>, counts array<double>, y int").toPandas()  # at most ``most`` rows
    m = len(voters.names) + 4
    votes = np.array(seen["votes"].tolist(), dtype=np.int8).reshape(-1, m)
    order = np.lexsort([*votes.T, seen["columns"].map(lambda c: zlib.crc32(repr(sorted(c)).encode())).to_numpy()]) if len(seen) else np.empty(0, dtype=int)
    seen, votes = seen.iloc[order], votes[order]
    if not len(seen):
        by_vote = np.zeros(m)
        by_vote[0] = 4.0
        return LinearModel(voters, np.zeros(0), by_vote, -2.0)
    posterior = label_model(votes, float(seen["y"].mean()), voters.trusted()).posterior(votes)
    at = np.repeat(np.arange(len(seen)), seen["columns"].map(len))
    columns = np.concatenate([np.asarray(c, dtype=int) for c in seen["columns"]])
    values = np.log1p(np.concatenate([np.asarray(c, dtype=float) for c in seen["counts"]]))
    signed = (votes == TOXIC).astype(float) - (votes == CLEAN)
    coefficients, by_vote, intercept = linear(at, columns, values, signed, len(voters.index), posterior)
    z = np.bincount(at, coefficients[columns] * values, len(seen)) + signed @ by_vote + intercept
    return LinearModel(voters, coefficients, by_vote, intercept - best_cut(z, seen["y"].to_numpy()))


def best_cut(z: np.ndarray, y: np.ndarray) -> float:
    """Where a line through the scores parts the labels of the training rows best: the middle of the best places."""
    order = np.argsort(z, kind="stable")
    z, y = z[order], y[order] == 1
    right = np.concatenate([[y.sum()], y.sum() + np.cumsum(np.where(y, -1, 1))])  # rows on the right side, if the first i are called clean
    ends = np.concatenate([[z[0] - 1], (z[1:] + z[:-1]) / 2, [z[-1] + 1]])
    real = np.concatenate([[True], z[1:] > z[:-1], [True]])
    best = ends[real & (right == right[real].max())]
    return float(best[np.abs(best).argmin()])


def score_documents(docs: DataFrame, model: LinearModel, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, held_out, score, predicted for every row. Null texts count as empty; repeated rows are scored alike."""
    kind = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(model)  # keys that the bounded training rows hold

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in slices(frames, "text"):
            yield pd.DataFrame({"doc_id": f["doc_id"], "held_out": f["held_out"], "score": shared.value.score(f["text"])})

    rows = docs.select("doc_id", F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"), "text")
    return rows.mapInPandas(run, f"doc_id {kind}, held_out boolean, score double").withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def keep_clean(docs: DataFrame, model: LinearModel, threshold: float = THRESHOLD) -> DataFrame:
    """Rows of ``docs``, all columns, whose text scores below ``threshold``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(texts))

    return docs.where(score(F.col("text")) < threshold)


def op6_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row; nulls, ties, repeats and empty tables: as ``score_documents`` and ``train`` say."""
    return score_documents(docs, train(docs, labels))
