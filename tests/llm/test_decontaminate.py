"""Benchmark passages against plain alignment of every window, and short items as whole words."""

import random

import numpy as np

from tessera.llm import decontaminate as dec

from .test_operators import words

DOC, ITEM = "doc_id BIGINT, text STRING, item_id INT, start STRING", "item_id BIGINT, text STRING, doc_id INT"


def least_edits(window, text):
    """Edits between a window and the part of the text that is nearest to it, by the full dynamic programme."""
    row = np.zeros(len(text) + 1, dtype=int)
    for i, c in enumerate(window, 1):
        new = np.minimum(row[:-1] + (text != c), row[1:] + 1)
        steps = np.arange(len(text) + 1)
        row = np.minimum.accumulate(np.concatenate([[i], new]) - steps) + steps
    return row.min()


def brute(rows, items):
    out = set()
    for d, text, *_ in rows:
        points = dec.normalise(text or "")
        for i, item, *_ in items:
            own = dec.normalise(item or "")
            n = len(own)
            if not 0 < n:
                continue
            if n < dec.SHORT_ITEM:
                hit = f" {own.tobytes().decode('utf-32-le')} " in f" {points.tobytes().decode('utf-32-le')} "
            else:
                cuts = [(s, min(n, dec.WINDOW), int(min(n, dec.WINDOW) * dec.EDIT_RATE)) for s in dec._starts(n, dec.WINDOW, dec.STRIDE)]
                cuts += [(s, dec.SHORT, dec.SHORT_EDITS) for s in dec._starts(n, dec.SHORT, dec.SHORT_STRIDE)] if n > dec.SHORT else []
                hit = any(least_edits(own[s : s + size], points) <= min(most, max((size - 1) // dec.Q - 1, 0)) for s, size, most in cuts)
            if hit:
                out.add((d, i))
    return out


def test_passages_equal_plain_alignment(spark):
    rng = random.Random(31)
    items = [(i, words(rng, n), 0) for i, n in enumerate([3, 6, 7, 9, 14, 20, 30, 45])] + [(90, "Yes!", 0), (91, "x", 0), (92, None, 0), (93, " ? ", 0), (94, "", 0)]
    rows = []
    for k in range(120):
        _, text, _ = items[k % 8]
        own = list(text)
        for _ in range(rng.choice([0, 0, 1, 2, 4, 7])):
            at = rng.randrange(len(own))
            own[at] = rng.choice(["", "q", own[at] + "z", own[at].upper()])
        lo = rng.randrange(len(own) // 2 + 1)
        part = "".join(own)[lo : lo + rng.choice([20, 52, 60, 300])]
        rows.append((k, f"{words(rng, 15)} {part} {words(rng, 15)}", 0, "s"))
    rows += [(200, "he said yes, twice", 0, "s"), (201, "yesterday eyes", 0, "s"), (202, "YES", 0, "s"), (203, "x", 0, "s"), (204, None, 0, "s"), (205, "", 0, "s"), (206, "a-x-b", 0, "s"), (206, "a-x-b", 0, "s")]
    docs, bench = spark.createDataFrame(rows, DOC), spark.createDataFrame(items, ITEM)
    found = dec.op1_decontamination(docs, bench).collect()
    want = brute(rows, items)
    assert {(r["doc_id"], r["item_id"]) for r in found} == want and len(want) > 30
    assert {(200, 90), (202, 90), (203, 91), (206, 91)} <= want and not {201} & {d for d, _ in want}
    assert sum(r["doc_id"] == 206 for r in found) == 2
    texts = {d: t for d, t, *_ in rows}
    assert {texts[r["doc_id"]][r["start"] : r["end"]].lower() for r in found if r["item_id"] == 90} == {"yes"}
    kept = dec.keep_clean(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d, *_ in rows} - {d for d, _ in want}
    small = dec.find(docs, bench, pass_chars=200).collect()
    assert {(r["doc_id"], r["item_id"]) for r in small} == want


def test_pieces_of_a_long_document_miss_nothing(monkeypatch):
    rng = random.Random(5)
    items = [(1, words(rng, 40)), (2, "zebra crossing")]
    text = " ".join([words(rng, 400), items[0][1], words(rng, 300), "zebra crossing", words(rng, 90), "zebra", "crossings"])
    whole = dec.matches(dec.normalise(text), dec.build(items))
    for piece in (50, 97, 333, 1000):
        monkeypatch.setattr(dec, "PIECE", piece)
        got = dec.matches(dec.normalise(text), dec.build(items))
        assert [m[0] for m in got] == [m[0] for m in whole] == [1, 2]
        assert all(abs(a - b) <= 5 for m, w in zip(got, whole, strict=True) for a, b in zip(m[1:3], w[1:3], strict=True))
