"""Token alignment against plain loops over whole texts; cuts, counts, files that are mapped, hard rows."""

import hashlib
from collections import Counter

import numpy as np
import pandas as pd
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from tessera.llm import align, queries

from .test_operators import DOC, EXTRA, hard_rows

TEXTS = ["Hello world, naïve café  with  spaces\n\nand\tbreaks ", " leading", "<|endoftext|> and <s> <unk> <0x41>", "日本語のテキスト 🙂🙂 ok", "a▁b", "▁", "x" * 300 + " y", "don't  we'll 12345 1 2\r\n", "\x00 nul", "é é   nbsp 　", " ", "é"]


def tokens(text):
    """(ids, bytes) of both tokenizers over the whole text, None where a tokenizer changes it."""
    a, b = Tokenizer.from_file(align.BYTE_LEVEL), SentencePieceProcessor(model_file=align.PIECES)
    a.encode_special_tokens = True
    of = align.byte_of_character()
    x = a.encode(" " + text, add_special_tokens=False).ids if text else []
    y = b.encode(text) if text else []
    first = [bytes(of[c] for c in a.id_to_token(i)) for i in x]
    second = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in y]
    if not text or b"".join(first) != (" " + text).encode() or b"".join(second) != (" " + text).encode():
        return None
    return x, first, y, second


def plain(texts):
    """What the operator returns for each text, without its id."""
    groups, links = [], []
    for text in texts:
        found, own, group = tokens(text) if text else None, [], []
        if found:
            x, first, y, second = found
            i = j = p = q = 0
            at_i = at_j = 0
            while i < len(x) or j < len(y):
                if p <= q:
                    p += len(first[i])
                    i += 1
                else:
                    q += len(second[j])
                    j += 1
                if p == q:
                    group.append((x[at_i:i], y[at_j:j]))
                    own.append((x[i - 1], y[j - 1]))
                    at_i, at_j = i, j
        groups.append(group)
        links.append(own)
    count = Counter(link for own in links for link in own)
    best = Counter()
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    rows = []
    for group, own in zip(groups, links, strict=True):
        whole = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in group)
        n_a, n_b = (sum(len(g[k]) for g in group) for k in (0, 1))
        rows.append((n_a, n_b, len(group), len(own), sum(count[k] == best[k[1]] for k in own), sum(count[k] for k in own), hashlib.sha256(whole.encode()).hexdigest() if whole else ""))
    return rows


COLUMNS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def rows_of(found):
    return sorted(((r["doc_id"], *(r[c] for c in COLUMNS)) for r in found.collect()), key=str)


@pytest.mark.parametrize("mapped", [True, False])
def test_equals_plain_loops_on_hard_rows(spark, mapped):
    rows = [*hard_rows(), *((100 + i, t, None, None, None) for i, t in enumerate(TEXTS))]
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4) for r in rows], DOC + EXTRA).repartition(3)
    want = sorted(((r[0], *p) for r, p in zip(rows, plain([r[1] for r in rows]), strict=True)), key=str)
    assert rows_of(align.alignment(docs, align.Pair.read(), mapped)) == want
    assert align.alignment(docs.limit(0), align.Pair.read(), mapped).count() == 0


def test_query_equals_plain_loops_on_a_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    want = sorted(((r["doc_id"], *p) for r, p in zip(docs, plain([r["text"] for r in docs]), strict=True)), key=str)
    assert rows_of(queries.queries()["op12_token_alignment"](spark, sf)) == want


def test_units_are_put_together_as_whole_texts_are(monkeypatch):
    encoders = align._Encoders(align.Pair.read())
    texts = [*TEXTS, *(r[1] for r in hard_rows() if r[1] and len(r[1]) < 10_000), " ".join(TEXTS[:2]), "a  b c\n d e'll f's g  ", None, ""]
    assert encoders.cuts and any(len(encoders.cut(t)) > 2 for t in texts if t) and all(" ".join(encoders.cut(t)) == t for t in texts if t)
    texts = [t or "" for t in texts]

    def seen(own, step):
        found = [x for i in range(0, len(texts), step) for x in own.documents(texts[i : i + step])]
        return [x and (*x[:4], x[4].tolist(), x[5].tolist()) for x in found]

    want = seen(encoders, 100)
    assert [x and (*x[:3], hashlib.sha256(x[3].encode()).hexdigest()) for x in want] == [p[6] and (*p[:3], p[6]) or None for p in plain(texts)]
    assert seen(encoders, 100) == want and seen(encoders, 1) == want  # from what is kept
    for kept in (0, 3, 50):
        monkeypatch.setattr(align, "UNITS", kept)
        monkeypatch.setattr(align, "RUN", kept + 1)
        encoders.forget()
        assert seen(encoders, 1) == want and len(encoders.known.index) <= kept
    encoders.cuts = False
    encoders.forget()
    assert seen(encoders, 7) == want


def test_counts_are_added_up_in_parts(monkeypatch):
    rng = np.random.default_rng(1)
    frames = [pd.DataFrame({"keys": [rng.integers(0, 500, 30), rng.integers(0, 500, 0)], "times": [rng.integers(1, 9, 30), rng.integers(1, 9, 0)]}) for _ in range(40)]
    want = Counter()
    for f in frames:
        for k, n in zip(np.concatenate(f["keys"]), np.concatenate(f["times"]), strict=True):
            want[int(k)] += int(n)
    for held, given in ((10**6, 10**6), (50, 10**6), (50, 20)):
        monkeypatch.setattr(align, "HELD", held)
        monkeypatch.setattr(align, "GIVEN", given)
        partial = pd.concat(align._partial(iter(frames))).sort_values("key")
        assert (len(partial) > len(want)) == (given == 20)
        cut = [partial.iloc[i : i + 7] for i in range(0, len(partial), 7)]
        summed = pd.concat(align._run_sums(iter([*cut, partial.iloc[:0]])))
        assert summed["key"].is_monotonic_increasing and dict(zip(summed["key"], summed["n"], strict=True)) == want
    assert not list(align._run_sums(iter([partial.iloc[:0]])))


def test_shards_give_the_counts_they_were_made_of(spark):
    rows = [(int(k), i + 1) for i, k in enumerate(np.random.default_rng(2).permutation(5000))]
    counts = spark.createDataFrame(rows, "key BIGINT, n BIGINT")
    key = "spark.sql.adaptive.coalescePartitions.enabled"  # small ranges would become one file
    spark.conf.set(key, "false")
    try:
        shards = align.write_shards(counts)
    finally:
        spark.conf.unset(key)
    keys = np.arange(5000)
    assert len(shards.names) > 1 and dict(zip(keys.tolist(), shards.counts_of(keys).tolist(), strict=True)) == dict(rows)


def test_groups_themselves_come_back(spark):
    found = align.alignment(spark.createDataFrame([(1, "Hello world")], "doc_id INT, text STRING"), align.Pair.read(), with_groups=True).first()
    assert hashlib.sha256(found["groups"].encode()).hexdigest() == found["groups_sha256"] and found["groups"].count("|") == found["n_groups"]
