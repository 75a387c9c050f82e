"""The additive quality model and the URL models against plain forms of the same sums."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest

from tessera.llm import quality, urls


def test_scores_are_sums_of_looked_up_values():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, len(quality.FEATURES)))
    y = ((x[:, 0] > 0.3) ^ (x[:, 1] > 0)).astype(float)  # only the pair says anything
    model = quality.fit(x[:1000], y[:1000], rounds=20, pairs=4)
    got = model.score(x[1000:])
    assert ((got >= 0.5) == y[1000:]).mean() > 0.9  # the cuts run through bins of a twelfth of the rows
    assert {(0, 1)} <= {(a, b) for a, b, _ in model.pairs}
    place = lambda edges, v: sum(v >= e for e in edges)
    for row, score in zip(x[1000:1050], got, strict=False):
        z = model.intercept + sum(t[place(e, v)] for e, t, v in zip(model.edges, model.tables, row, strict=True))
        z += sum(t[place(model.pair_edges[a], row[a]), place(model.pair_edges[b], row[b])] for a, b, t in model.pairs)
        assert score == pytest.approx(1 / (1 + math.exp(-z)))


def test_a_tree_is_the_best_cut():
    rng = np.random.default_rng(4)
    g, h, n = rng.normal(size=12), np.full(12, 3.0), np.full(12, 50)
    got = quality._tree(g, h, n, leaves=2)
    gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + 1)
    cut = max(range(1, 12), key=lambda c: gain(0, c) + gain(c, 12))
    want = [g[:cut].sum() / (h[:cut].sum() + 1)] * cut + [g[cut:].sum() / (h[cut:].sum() + 1)] * (12 - cut)
    assert got == pytest.approx(np.array(want))


def test_models_without_rows_or_with_one_class():
    empty = np.empty((0, len(quality.FEATURES)))
    assert quality.fit(empty, np.empty(0)).score(np.zeros((2, len(quality.FEATURES)))) == pytest.approx([0.5, 0.5])
    assert quality.fit(np.ones((9, len(quality.FEATURES))), np.ones(9)).score(np.ones((1, len(quality.FEATURES))))[0] > 0.9


def test_the_markov_model_is_witten_bell():
    rng = random.Random(3)
    texts = ["".join(rng.choices("abc/.1", k=rng.randint(3, 30))) for _ in range(60)]
    counts = np.zeros(urls.SIZE ** (urls.ORDER + 1), dtype=np.int64)
    seen = [Counter() for _ in range(urls.ORDER + 1)]
    for t in texts:
        np.add.at(counts, urls.grams(t), 1)
        c = urls.codes(t)
        for i in range(urls.ORDER, len(c)):
            for k in range(urls.ORDER + 1):
                seen[k][tuple(c[i - k : i + 1])] += 1

    def plain(context, symbol):
        p = 1 / urls.SIZE
        for k in range(urls.ORDER + 1):
            own = context[len(context) - k :]
            after = {s: n for s in range(urls.SIZE) if (n := seen[k][(*own, s)])}
            if after:
                total = sum(after.values())
                p = (after.get(symbol, 0) + len(after) * p) / (total + len(after))
        return p

    table = urls.log_model(counts).reshape((urls.SIZE,) * 4)
    some = [urls.SYMBOLS.index(s) for s in "ab/1z"]
    for a, b, c, d in itertools.product(some, repeat=4):
        assert math.exp(table[a, b, c, d]) == pytest.approx(plain((a, b, c), d), rel=1e-4)


def test_grams_cover_every_character():
    assert len(urls.grams("example.com/a?b=É")) == len("example.com/a?b=É") and len(urls.grams("")) == 0
    assert (urls.grams("ABC") == urls.grams("abc")).all()
