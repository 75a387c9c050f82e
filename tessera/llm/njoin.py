"""N-gram Jaccard self-join by universe partition and pigeonhole.

Sets of word shingles are banded by size. In a band, the universe of shingles is hashed into segments; two sets as
similar as asked differ in few shingles, so few that some segment holds equal subsets in both, or, where a segment
counts double, subsets that differ by one shingle. A set's signatures are its segments' subsets and, for the double
segments, their one-deletion neighbourhoods. How many segments count double is chosen for each band by cost: what is
sent against how many unrelated sets are expected to meet. Sets that share a signature are candidates and are verified
on their words.

Equal sets are one class and count once from then on. A signature's members are not paired with each other: each is
compared with the signature's least member, links are contracted into components, and only signatures whose members
still lie in several components are looked at again, small ones pair by pair, large ones block against block.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_rows, free_names, slices, staged, text_or_empty

WORDS, NUMERATOR, DENOMINATOR = 5, 80, 100
#: Members up to which a signature is looked at pair by pair.
SMALL = 32
#: Largest over least size of a band.
BAND_RATIO = 1.23
#: Bits of the sieve of shared signatures (8 MB), and signatures up to which it is of use.
SIEVE_BITS, SIEVE_SIGNATURES = 1 << 26, 8_000_000
#: Shingles of one block of a large signature.
BLOCK_SHINGLES = 1_000_000
#: Candidate documents up to which their ids are broadcast (8 bytes each).
BROADCAST_IDS = 1_000_000
#: Cells of the sketch that rules most candidates out before sets are fetched.
CELLS = 128
#: Chance that a shingle of one set is also in an unrelated set of its band, and cost of a candidate in signatures.
CHANCE, CANDIDATE_COST = 0.03, 3.0
PIECE = 500_000
#: Rows of a batch for a Python worker: some megabytes of texts.
BATCH_ROWS = 1000

_U = np.uint64
_C1, _C2, _C3 = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB)
#: Word digests that a task keeps, and the longest word that is kept.
DIGESTS, DIGEST_BYTES = 60_000, 40
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
_digests: dict[int, dict[bytes, bytes]] = {}


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _C2
    x = (x ^ (x >> _U(27))) * _C3
    return x ^ (x >> _U(31))


def words_of(text: str) -> Iterator[bytes]:
    """The words of a text in UTF-8, A-Z lower-cased; a long text is cut up bit by bit.

    ``bytes.split`` cuts at ASCII white space, ``bytes.lower`` knows A-Z only.
    """
    raw, at = text.encode("utf-8", "replace"), 0
    while at < len(raw):
        space = _SPACE.search(raw, at + PIECE)
        stop = space.start() if space else len(raw)
        yield from raw[at:stop].lower().split()
        at = stop


def word_digests(words: Iterator[bytes], seed: int) -> bytes:
    """128 bits of BLAKE2 for each word: words that differ can't be made to have one digest."""
    own, key = _digests.setdefault(seed, {}), seed.to_bytes(8, "little")
    out = bytearray()
    for w in words:
        digest = own.get(w)
        if digest is None:
            digest = blake2b(w, digest_size=16, key=key).digest()
            if len(w) <= DIGEST_BYTES:
                if len(own) >= DIGESTS:
                    own.clear()
                own[w] = digest
        out += digest
    return bytes(out)


def _chained(w: np.ndarray, k: int, start: int) -> np.ndarray:
    """A hash for each run of k rows of ``w``, column by column."""
    h = np.full((len(w) - k + 1, w.shape[1]), start, dtype=np.uint64)
    for j in range(k):
        h = h * _C2 + w[j : j + len(h)]
        h ^= h >> _U(29)
    return mix(h)


def shingle_sets(texts: list[str], k: int, seed: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document number, first hash, second hash) of each distinct shingle of all texts, sorted. A text with fewer than k words is one shingle."""
    digests = [word_digests(words_of(t), seed) for t in texts]
    sizes = np.array([len(x) // 16 for x in digests], dtype=np.int64)
    w, doc = np.frombuffer(b"".join(digests), dtype=np.uint64).reshape(-1, 2), np.repeat(np.arange(len(texts)), sizes)
    h, d = np.empty((0, 2), dtype=np.uint64), np.empty(0, dtype=np.int64)
    if len(w) >= k:
        whole = doc[: len(w) - k + 1] == doc[k - 1 :]
        h, d = _chained(w, k, k)[whole], doc[: len(w) - k + 1][whole]
    first = np.cumsum(sizes) - sizes
    short = np.flatnonzero((sizes > 0) & (sizes < k))
    if len(short):
        h = np.concatenate([h, *[_chained(w[first[i] : first[i] + sizes[i]], int(sizes[i]), int(sizes[i])) for i in short]])
        d = np.concatenate([d, short])
    order = np.lexsort((h[:, 1], h[:, 0], d))
    h, d = h[order], d[order]
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]).any(axis=1) | (d[1:] != d[:-1])
    return d[new], h[new, 0], h[new, 1]


def shared_shingles(x: str, y: str, k: int) -> tuple[int, int, int]:
    """Distinct shingles of both texts, of the first and of the second: by the words themselves, without hashes of them.

    Words get numbers as they come; a run of words is numbered by its first part's number and its last word's.
    """
    number: dict[bytes, int] = {}
    a, b = (np.array([number.setdefault(v, len(number)) for v in words_of(t)], dtype=np.int64) for t in (x, y))
    if min(len(a), len(b)) < k:  # a text of fewer words is one shingle, its words' whole sequence
        if max(len(a), len(b)) < k:
            return int(len(a) > 0 and np.array_equal(a, b)), int(len(a) > 0), int(len(b) > 0)
        return 0, *(int(0 < len(w)) if len(w) < k else len(np.unique(_runs(w, k, len(number)))) for w in (a, b))
    runs = _runs(np.concatenate([a, b]), k, len(number))
    p, q = np.unique(runs[: len(a) - k + 1]), np.unique(runs[len(a) :])
    return len(np.intersect1d(p, q, assume_unique=True)), len(p), len(q)


def _runs(w: np.ndarray, k: int, width: int) -> np.ndarray:
    """A number for each run of k of the numbers ``w``, which are below ``width``; equal runs have equal numbers."""
    runs = w
    for j in range(1, k):
        runs = np.unique(runs[:-1] * width + w[j:], return_inverse=True)[1]
    return runs


@dataclass(frozen=True)
class Bands:
    """Size bands, and for each: the number of segments, how many of them count double, and how many to spare.

    A set with no more empty segments than there are to spare sends no signature for them: the others still leave one in
    which a similar pair agrees. Without that, all sets with one segment empty would meet.
    """

    low: np.ndarray
    segments: np.ndarray
    double: np.ndarray
    spare: np.ndarray
    numerator: int
    denominator: int

    def of(self, size: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.low, size, side="right") - 1


def band_edges(most: int) -> np.ndarray:
    low, at = [], 1
    while at <= most:
        low.append(at)
        at = max(at + 1, int(at * BAND_RATIO))
    return np.array([*low, at], dtype=np.int64)


def allocate(num: int, den: int, most: int, members: dict[int, int]) -> Bands:
    """Segments by band. A pair whose smaller set is in a band differs in at most ``differ`` shingles, so segments that
    count one or two, ``differ + 1`` in all, leave one in which the pair differs by less than it counts."""
    low = band_edges(most)
    segments, double, spares = [], [], []
    for b in range(len(low)):
        high = int(low[b + 1]) - 1 if b + 1 < len(low) else int(low[b])
        differ = (high + high * den // num) * (den - num) // (den + num)
        twos = np.arange((differ + 1) // 2 + 1)
        ones = differ + 1 - 2 * twos
        per = high / (ones + twos)  # shingles of a segment
        meet = CHANCE**per + np.exp(-2 * per)
        sent = ones + twos * (1 + per)
        cost = sent + CANDIDATE_COST * members.get(b, 0) * (ones * meet + twos * (1 + per) * np.minimum(1, meet / CHANCE))
        best = int(cost.argmin())
        # Or single segments only, with some to spare for empty ones: their usual number and four deviations.
        spare = 0
        for _ in range(20):
            empty = (differ + 1 + spare) * np.exp(-int(low[b]) / (differ + 1 + spare))
            spare = int(np.ceil(empty + 4 * np.sqrt(empty)))
        m = differ + 1 + spare
        plain = m + CANDIDATE_COST * members.get(b, 0) * m * CHANCE ** (high / m)
        if spare <= differ + 1 and plain <= cost[best]:
            segments.append(m), double.append(0), spares.append(spare)
        else:
            segments.append(int(ones[best] + twos[best])), double.append(int(twos[best])), spares.append(0)
    return Bands(low, np.array(segments), np.array(double), np.array(spares), num, den)


def signatures(doc: np.ndarray, h: np.ndarray, n_docs: int, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """(document number, signature): under the document's own band, and under lower bands where a smaller partner may be."""
    size = np.bincount(doc, minlength=n_docs)
    own = bands.of(np.maximum(size, 1))
    least = bands.of(np.maximum(1, -(-size * bands.numerator // bands.denominator)))
    docs, sigs = [], []
    t = mix(h ^ _C3)
    for back in range(int((own - least).max(initial=0)) + 1):
        band = own - back
        use = (band >= least) & (size > 0)
        m = np.where(use, bands.segments[np.maximum(band, 0)], 0)
        base = np.cumsum(m) - m
        mine = use[doc]
        d, x, y = doc[mine], h[mine], t[mine]
        seg = (((x >> _U(32)) * m[d].astype(np.uint64)) >> _U(32)).astype(np.int64)
        key = base[d] + seg
        total = np.zeros(int(m.sum()), dtype=np.uint64)
        np.add.at(total, key, y)
        owner = np.repeat(np.arange(n_docs), m)
        number = np.arange(len(total)) - base[owner]
        salt = (band[owner] + 1).astype(np.uint64) * _C1 + (number + 1).astype(np.uint64) * _C2
        empty = np.bincount(key, minlength=len(total)) == 0
        skip = empty & (np.bincount(owner[empty], minlength=n_docs) <= bands.spare[np.maximum(band, 0)])[owner]
        docs.append(owner[~skip])
        sigs.append(mix(mix(total) + salt)[~skip])
        two = seg < bands.double[np.maximum(band, 0)][d]
        if two.any():
            docs.append(d[two])
            sigs.append(mix(mix(total[key[two]] - y[two]) + salt[key[two]]))
    return np.concatenate(docs), np.concatenate(sigs)


def sketch(doc: np.ndarray, h: np.ndarray, n_docs: int) -> np.ndarray:
    """Shingles by hash cell; two sets differ in at least as many shingles as their cells do in all."""
    cell = (h >> _U(64 - CELLS.bit_length() + 1)).astype(np.int64)
    return np.bincount(doc * CELLS + cell, minlength=n_docs * CELLS).reshape(n_docs, CELLS)


def _class_ids(doc: np.ndarray, h: np.ndarray, other: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit numbers for each document's set, from the shingles' first and from their second hashes."""
    one, two = np.zeros(len(n), dtype=np.uint64), np.zeros(len(n), dtype=np.uint64)
    np.add.at(one, doc, mix(h + _C1))
    np.add.at(two, doc, mix(other ^ _C2))
    return mix(one + n.astype(np.uint64)).view(np.int64), mix(two).view(np.int64)


#: (document numbers, their signatures, one row of numbers for each document) of (document numbers, hashes, documents).
Marks = Callable[[np.ndarray, np.ndarray, int], tuple[np.ndarray, np.ndarray, np.ndarray]]


def _prepared(docs: DataFrame, k: int, bands: Bands, seed: int) -> DataFrame:
    return prepared(docs, k, seed, lambda doc, h, n: (*signatures(doc, h, n, bands), sketch(doc, h, n)))


def prepared(docs: DataFrame, k: int, seed: int, marks: Marks) -> DataFrame:
    """doc_id, body, n_shingles, set1, set2 of every row, and of sets that their task hasn't met before: sigs, sketch."""
    kind = dict(docs.dtypes)["doc_id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for f in slices(frames, "text", PIECE):
            texts = f["text"].map(text_or_empty).tolist()
            doc, h, other = shingle_sets(texts, k, seed)
            n = np.bincount(doc, minlength=len(texts))
            one, two = _class_ids(doc, h, other, n)
            # A set that this task has met before needs no second lot of signatures.
            fresh = np.zeros(len(texts), dtype=bool)
            for i in range(len(texts)):
                if n[i] and int(one[i]) not in seen:
                    fresh[i] = True
                    if len(seen) < 1_000_000:
                        seen.add(int(one[i]))
            use = fresh[doc]
            owner, sig, cells = marks(doc[use], h[use], len(texts))
            order = np.argsort(owner, kind="stable")
            owner, sig = owner[order], sig[order].view(np.int64)
            ends = np.searchsorted(owner, np.arange(len(texts) + 1))
            cells = cells.astype(np.int32)
            yield pd.DataFrame({
                "doc_id": f["doc_id"].to_numpy(), "body": f["body"].to_numpy(), "n_shingles": n, "set1": one, "set2": two,
                "sigs": [sig[ends[i] : ends[i + 1]] if fresh[i] else None for i in range(len(texts))],
                "sketch": [cells[i] if fresh[i] else None for i in range(len(texts))],
            })

    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("body"))
    return rows.mapInPandas(run, f"doc_id {kind}, body long, n_shingles long, set1 long, set2 long, sigs array<long>, sketch array<int>")


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of the undirected edges (a, b): the component's least node. Alternating stars, a table a round."""
    star = staged(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges", small=True)
    state = [F.count("*"), *(F.sum(F.xxhash64(F.lit(i), "u", "v").cast("decimal(20,0)")) for i in (1, 2))]  # exact sums of two hashes
    before = None
    while True:
        both = star.select(F.col("u").alias("x"), F.col("v").alias("y")).unionByName(star.select(F.col("v").alias("x"), F.col("u").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(low.select("u", F.col("m").alias("v"))).distinct()
        star = staged(small, "stars", small=True)
        now = star.agg(*state).first()
        if now == before:
            break
        before = now
    return star.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(star.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _met(sets: DataFrame, rows: DataFrame, shared: DataFrame) -> DataFrame:
    """``rows`` (sig, set1) without most of those whose signature isn't shared, so that they aren't sent again.

    The sieve has SIEVE_BITS bits at any size of input; executors build it, in pieces of 32,768 bits. Above
    SIEVE_SIGNATURES shared signatures it would let most rows through and is left out; the join that follows gives the
    same result either way.
    """
    if shared.count() > SIEVE_SIGNATURES:
        return rows
    at = F.pmod("sig", F.lit(SIEVE_BITS)) + 1
    pieces = shared.groupBy(F.bitmap_bucket_number(at).alias("piece")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits"))
    sieve = np.zeros(SIEVE_BITS // 8, dtype=np.uint8)
    for piece, bits in pieces.collect():  # SIEVE_BITS / 8 bytes in all
        sieve[(piece - 1) * len(bits) : piece * len(bits)] = np.frombuffer(bits, dtype=np.uint8)
    packed = sets.sparkSession.sparkContext.broadcast(sieve)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            own = np.repeat(f["set1"].to_numpy(), f["sigs"].map(len))
            sig = np.concatenate([np.empty(0, dtype=np.int64), *f["sigs"]])
            at = sig % SIEVE_BITS
            hit = (packed.value[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
            yield pd.DataFrame({"sig": sig[hit], "set1": own[hit]})

    return sets.where("sigs IS NOT NULL").select("sigs", "set1").mapInPandas(run, "sig long, set1 long")


@dataclass(frozen=True)
class Search:
    """How candidates are found, and how most of them are ruled out before words are compared.

    ``prepare(docs, k, seed)`` gives each row its set's numbers, signatures and sketch; ``near(pairs)`` keeps of the rows
    (a, n_a, s_a, b, n_b, s_b) those that may be similar; ``sketches(doc, h, n_docs)`` makes sketches of sets of hashes, and
    ``close(s, n, rest, sizes)`` tells which of the sketches ``rest`` may be similar to the sketch ``s``.
    """

    prepare: Callable[[DataFrame, int, int], DataFrame]
    near: Callable[[DataFrame], DataFrame]
    sketches: Callable[[np.ndarray, np.ndarray, int], np.ndarray]
    close: Callable[[np.ndarray, int, np.ndarray, np.ndarray], np.ndarray]


def _partitioned(bands: Bands, num: int, den: int) -> Search:
    """Signatures from the partitioned universe, sketches that count shingles by cell."""

    def near(pairs: DataFrame) -> DataFrame:
        apart = F.aggregate(F.zip_with("s_a", "s_b", lambda x, y: F.abs(x - y)), F.lit(0), lambda t, x: t + x)
        return pairs.where(apart * (num + den) <= (F.col("n_a") + F.col("n_b")) * (den - num))

    def close(s: np.ndarray, n: int, rest: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        return np.abs(rest - s).sum(axis=1) * (num + den) <= (sizes + n) * (den - num)

    return Search(lambda docs, k, seed: _prepared(docs, k, bands, seed), near, sketch, close)


def _verified(pairs: DataFrame, classes: DataFrame, texts, k: int, num: int, den: int, search: Search) -> DataFrame:
    """(a, b) of ``pairs`` whose sets are similar: sizes first, then sketches, then the words themselves."""
    left = classes.select(F.col("set1").alias("a"), F.col("n").alias("n_a"), F.col("sketch").alias("s_a"))
    right = classes.select(F.col("set1").alias("b"), F.col("n").alias("n_b"), F.col("sketch").alias("s_b"))
    sized = pairs.join(left, "a").join(right, "b").where(F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num)
    near = staged(search.near(sized).select("a", "b"), "near-pairs", small=True)
    own = texts(near.select(F.col("a").alias("set1")).unionByName(near.select(F.col("b").alias("set1"))).distinct())
    met = near.join(own.select(F.col("set1").alias("b"), F.col("text").alias("y")), "b").join(own.select(F.col("set1").alias("a"), F.col("text").alias("x")), "a")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in slices(frames, "y", PIECE):
            both = [shared_shingles(x, y, k) for x, y in zip(f["x"], f["y"], strict=True)]
            yield f.loc[[den * i >= num * (p + q - i) for i, p, q in both], ["a", "b"]]

    return met.select("a", "b", "x", "y").mapInPandas(run, "a long, b long")


def _linked_in_block(frame: pd.DataFrame, num: int, den: int, search: Search) -> pd.DataFrame:
    """Links that join components of a large signature's members; pairs that are joined already are skipped."""
    ids, label = frame["set1"].to_numpy(), frame["label"].to_numpy()
    sets = [np.sort(np.asarray(x, dtype=np.int64)) for x in frame["shingles"]]
    n = np.array([len(s) for s in sets])
    side = frame["side"].to_numpy()
    # 32 sets at a time: a sketch may be made of more numbers than its set has
    cells = np.concatenate([search.sketches(np.repeat(np.arange(len(part)), [len(s) for s in part]), np.concatenate(part).view(np.uint64), len(part)).astype(np.int32) for part in (sets[i : i + 32] for i in range(0, len(sets), 32))])
    parent = {int(x): int(x) for x in label}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    found = []
    for i in range(len(ids)):
        later = np.arange(i + 1, len(ids))
        ok = (label[later] != label[i]) & (np.minimum(n[later], n[i]) * den >= np.maximum(n[later], n[i]) * num) & ((side[later] != side[i]) | (side.max() == side.min()))
        later = later[ok]
        if len(later):
            later = later[search.close(cells[i], n[i], cells[later], n[later])]
        for j in later:
            a, b = root(int(label[i])), root(int(label[j]))
            if a != b:
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both * den >= (n[i] + n[j] - both) * num:
                    parent[max(a, b)] = min(a, b)
                    found.append((ids[i], ids[j]))
    return pd.DataFrame(found, columns=["a", "b"], dtype=np.int64)


def similar_classes(docs: DataFrame, k: int = WORDS, num: int = NUMERATOR, den: int = DENOMINATOR) -> DataFrame:
    """One row per input row: doc_id, body (xxhash64 of the text), n_shingles, component_id, class_id (the least doc_id with an equal set).

    Two documents link when ``den * intersection >= num * union`` of their distinct k-word shingles (words lie between
    ASCII white space, A-Z are lower-cased; a text with fewer than k words is one shingle). component_id is the least
    doc_id that links lead to, the document's own included. Null and word-free texts have no shingles, link with nothing
    and are their own component. Rows that repeat a doc_id have equal results if their texts are equal. Null doc_ids take
    part and never name a component unless all of its ids are null. Only doc_id and text are read; an empty table gives
    an empty result.

    Sets are told apart by 128 bits of two hash chains; links are verified on the words. Should the two disagree, the
    work is done again with other hashes.
    """
    # Band sizes from text lengths, over all rows: an estimate that costs depend on, and no result.
    guess = F.greatest(F.lit(1), F.floor(F.octet_length("text") / 6)).cast("long")
    step = np.log(BAND_RATIO)
    rough = {r[0]: r[1] for r in docs.where("text IS NOT NULL").groupBy(F.floor(F.log(guess) / F.lit(float(step))).alias("b")).count().collect()}  # one row per power of the band ratio
    most = 1 + max([int(np.exp((b + 1) * step)) * 6 for b in rough], default=1)
    edges = band_edges(most)
    members = {b: rough.get(int(np.log(max(1, low)) / step), 0) for b, low in enumerate(edges)}
    return classes_by(_partitioned(allocate(num, den, most, members), num, den), docs, k, num, den)


def classes_by(search: Search, docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """What ``similar_classes`` returns, with candidates from ``search``."""
    for seed in range(4):
        with batch_rows(docs.sparkSession, BATCH_ROWS):
            found = _classes_of(search, docs, k, num, den, seed)
        if found is not None:
            return found
    raise RuntimeError("four seeds in turn gave different shingles one hash")


def _classes_of(search: Search, docs: DataFrame, k: int, num: int, den: int, seed: int) -> DataFrame | None:
    """What ``classes_by`` returns, or None if hashes under this seed tell too little apart."""
    prep = staged(search.prepare(docs, k, seed), "sets")
    some = prep.where("n_shingles > 0")
    named = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "body")))
    grouped = some.groupBy("set1").agg(F.min("set2").alias("low"), F.max("set2").alias("high"), F.coalesce(named, F.min(F.struct("doc_id", "body"))).alias("rep"), F.max("n_shingles").alias("n"), F.max("sketch").alias("sketch"))
    classes = staged(grouped.select("set1", "low", "high", F.col("rep.doc_id").alias("rep"), F.col("rep.body").alias("body"), "n", "sketch"), "classes")
    if not classes.where("low <> high").isEmpty():
        return None

    def texts(wanted: DataFrame) -> DataFrame:
        """(set1, text) of the wanted classes: one document's text each."""
        ids = staged(wanted.join(classes.select("set1", F.col("rep").alias("_id"), F.col("body").alias("_body")), "set1"), "wanted", small=True)
        near = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
        found = docs.select("doc_id", "text", F.xxhash64("text").alias("body")).join(near, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("body") == F.col("_body")))
        return staged(found.select("set1", "text").dropDuplicates(["set1"]), "texts")

    def sets(wanted: DataFrame) -> DataFrame:
        """(set1, shingles) of the wanted classes: the shingles' first hashes."""

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for f in slices(frames, "text", PIECE):
                doc, h, _ = shingle_sets(f["text"].map(text_or_empty).tolist(), k, seed)
                ends = np.searchsorted(doc, np.arange(len(f) + 1))
                yield pd.DataFrame({"set1": f["set1"], "shingles": [h[ends[i] : ends[i + 1]].view(np.int64) for i in range(len(f))]})

        return staged(texts(wanted).mapInPandas(run, "set1 long, shingles array<long>"), "shingles")

    rows = some.where("sigs IS NOT NULL").select(F.explode("sigs").alias("sig"), "set1")
    # Written out, so that both sides of the join are exchanged for it and a hot signature's side can be split.
    shared = staged(rows.groupBy("sig").agg(F.min("set1").alias("p"), F.max("set1").alias("q")).where("p < q").select("sig", "p"), "shared")
    members_of = staged(_met(some, rows, shared).join(shared, "sig").distinct(), "members")
    stars = members_of.where("set1 <> p").select(F.col("p").alias("a"), F.col("set1").alias("b")).distinct()
    links = staged(_verified(stars, classes, texts, k, num, den, search), "links", small=True)
    label = components(links)

    # Signatures whose members, three at least, are in several components still.
    labelled = members_of.join(label.withColumnRenamed("node", "set1"), "set1", "left").select("sig", "set1", F.coalesce("component", "set1").alias("label"))
    open_ = labelled.groupBy("sig").agg(F.count("*").alias("size"), F.min("label").alias("l"), F.max("label").alias("g"), F.sum(F.xxhash64("set1") % (1 << 40)).alias("f1"), F.bit_xor(F.xxhash64(F.lit(1), "set1")).alias("f2")).where("size > 2 AND l < g")
    once = open_.groupBy("size", "f1", "f2").agg(F.min("sig").alias("sig"))  # signatures with the same members
    again = staged(labelled.join(once.select("sig", "size"), "sig"), "open")
    few = again.where(F.col("size") <= SMALL)
    x, y = few.select("sig", F.col("set1").alias("a"), F.col("label").alias("la")), few.select("sig", F.col("set1").alias("b"), F.col("label").alias("lb"))
    more = x.join(y, "sig").where("a < b AND la <> lb").select("a", "b").distinct()
    many = again.where(F.col("size") > SMALL)
    joined = 0
    if not many.isEmpty():
        joining = staged(_block_links(many, classes, sets, num, den, search), "block-links", small=True).distinct()
        joined = joining.count()
        more = more.unionByName(joining).distinct()
    more = staged(_verified(more, classes, texts, k, num, den, search), "more-links", small=True)
    if joined and more.join(joining, ["a", "b"], "left_semi").count() < joined:
        return None  # a pair was passed over because of a link that isn't one
    if not more.isEmpty():
        label = components(links.unionByName(more))
    named = classes.select("set1", F.col("rep").alias("class_id")).join(label.withColumnRenamed("node", "set1"), "set1", "left")
    least = named.where("component IS NOT NULL").groupBy("component").agg(F.min("class_id").alias("component_id"))
    final = named.join(least, "component", "left").select("set1", "class_id", F.coalesce("component_id", "class_id").alias("component_id"))
    own = prep.select("doc_id", "body", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("set1")).alias("set1")).join(final, "set1", "left")
    return own.select("doc_id", "body", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"), F.coalesce("class_id", "doc_id").alias("class_id"))


def _block_links(many: DataFrame, classes: DataFrame, sets, num: int, den: int, search: Search) -> DataFrame:
    """(a, b) that join components of large signatures' members. Members are dealt into blocks, each pair of blocks is one group."""
    sized = many.join(classes.select("set1", "n"), "set1")
    # A hot signature's counts are added up before they are exchanged; the blocks of all signatures are few numbers each.
    blocks = sized.groupBy("sig").agg(F.ceil(F.sum("n") / BLOCK_SHINGLES).cast("int").alias("blocks"))
    placed = many.join(blocks, "sig").withColumn("block", F.pmod(F.xxhash64("set1"), F.col("blocks")).cast("int"))
    # A member goes to each pair of blocks that its own is in; a block is also compared with itself.
    other = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    sent = other.select("sig", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "set1", "label", F.col("block").alias("side")).join(sets(many.select("set1").distinct()), "set1")
    return sent.groupBy("sig", "i", "j").applyInPandas(lambda f: _linked_in_block(f, num, den, search), "a long, b long")


def keep_one(docs: DataFrame, k: int = WORDS, num: int = NUMERATOR, den: int = DENOMINATOR) -> DataFrame:
    """Rows of ``docs``, all columns: of each component the document with the least doc_id.

    Of rows that repeat an id, those go whose own text is a copy of another id's; those with an equal set of shingles
    all stay or all go. Rows with a null id stay. Further columns, whatever they are called, come back unchanged.
    """
    found = similar_classes(docs, k, num, den)
    body, key, gone = free_names(docs.columns, 3)
    drop = found.where("doc_id <> component_id").select(F.col("doc_id").alias(key), F.col("body").alias(gone)).distinct()
    marked = docs.withColumn(body, F.xxhash64("text"))
    return marked.join(drop, (F.col("doc_id") == F.col(key)) & (F.col(body) == F.col(gone)), "left_anti").drop(body)


OP3_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), sets AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) END AS s FROM words
), grams AS (
  SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets
), pairs AS (
  SELECT a.doc_id AS x, b.doc_id AS y FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
    AND 10 * least(a.n, b.n) >= 9 * greatest(a.n, b.n)
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))
), reach(doc_id, r) AS (
  SELECT doc_id, doc_id FROM sets UNION SELECT reach.doc_id, pairs.y FROM reach JOIN pairs ON reach.r = pairs.x
)
SELECT s.doc_id, CAST(len(s.s) AS BIGINT) AS n_shingles, min(r.r) AS component_id
FROM sets s JOIN reach r USING (doc_id) GROUP BY s.doc_id, s.s
"""


def op3_ngram_jaccard(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id of every row: three-word shingles, links at a similarity of 0.9 or more.

    Nulls, empty texts, ties, repeated rows and empty tables: as ``similar_classes`` says.
    """
    return similar_classes(docs, 3, 90, 100).select("doc_id", "n_shingles", "component_id")
