"""The n-gram join on words that defeat weak hashes, on large groups and on repeated ids."""

import random

from tessera.llm import njoin

from .test_operators import brute_components, words

ID = "doc_id BIGINT, text STRING"


def thue_morse(n):
    return "".join("ab"[bin(i).count("1") % 2] for i in range(n))


def test_words_of_any_length_are_told_apart(spark):
    t = thue_morse(1024)
    rng = random.Random(4)
    texts = [t, t.translate(str.maketrans("ab", "ba")), t, "a" * 100_000, "a" * 99_999, "a " * 5, "A\x0bB", "a b", "a b", "İ i", "i i"]
    for n in (1, 5, 50, 1000, 20_000):
        own = ["".join(rng.choices("xyz", k=n)) for _ in range(40)]
        texts += [" ".join(own), " ".join([*own, "q"]), " ".join(own[1:])]
    rows = list(enumerate(texts))
    found = njoin.op3_ngram_jaccard(spark.createDataFrame(rows, ID)).collect()
    assert {tuple(r) for r in found} == brute_components(rows, 3, 90, 100)
    assert {r["doc_id"]: r["component_id"] for r in found}[1] == 1


def test_shared_shingles_equal_plain_sets():
    rng = random.Random(1)
    for _ in range(2000):
        k = rng.choice([3, 5])
        x, y = (" ".join(rng.choice("abc") for _ in range(rng.randint(0, 12))) for _ in range(2))
        sets = [{tuple(w)} if 0 < len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} for w in (x.split(), y.split())]
        assert njoin.shared_shingles(x, y, k) == (len(sets[0] & sets[1]), len(sets[0]), len(sets[1]))


def test_large_signatures_are_searched_block_by_block(spark, monkeypatch):
    monkeypatch.setattr(njoin, "SMALL", 3)
    monkeypatch.setattr(njoin, "BLOCK_SHINGLES", 600)
    rng, rows = random.Random(8), []
    base = words(rng, 90).split()
    for g in range(12):  # families that share most of their text, so that signatures are hot
        family = base[:70] + words(rng, 30).split()
        for _ in range(3):
            own = list(family)
            own[rng.randrange(70, 100)] = f"w{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(own)))
    found = njoin.similar_classes(spark.createDataFrame(rows, ID), 5, 80, 100).collect()
    assert {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in found} == brute_components(rows, 5, 80, 100)


def test_one_row_of_each_group_stays(spark):
    a, b = words(random.Random(1), 50), words(random.Random(2), 50)
    rows = [(1, a, 1), (2, a + " end", 2), (2, b, 3), (5, b, 4), (7, None, 5), (7, None, 6), (None, a, 7), (9, "", 8)]
    kept = njoin.keep_one(spark.createDataFrame(rows, ID + ", _0 INT").withColumnRenamed("_0", "body")).collect()
    # 2 repeats an id: its copy of 1 goes, its own text leads another group and stays
    assert {(r["doc_id"], r["body"]) for r in kept} == {(1, 1), (2, 3), (7, 5), (7, 6), (None, 7), (9, 8)}
