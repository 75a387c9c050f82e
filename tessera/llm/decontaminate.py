"""Benchmark decontamination: q-gram lemma filter over diagonal bands, then banded alignment.

Benchmark items are cut into long windows with a wider edit budget, and into short ones that start every few characters,
so that fragments and the stretches between changed words are found. A window of L characters occurs in a document with at most k edits only if the
two share at least L + 1 - q(k + 1) q-grams on diagonals at most k apart. So the q-grams that a document shares with
the benchmark are counted in overlapping bands of diagonals; bands that reach the bound go to a banded alignment, which
decides. Items too short for that are looked for as whole sequences of words. Documents stream past an index of the
benchmark; nothing is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_or_empty

Q = 10
WINDOW = 80
STRIDE = 20
EDIT_RATE = 0.06
#: The short windows: a verbatim fragment of SHORT + SHORT_STRIDE - 1 normalised characters holds one, wherever it lies.
SHORT = 50
SHORT_STRIDE = 4
SHORT_EDITS = 2
#: Normalised items shorter than this match exactly, between the ends of words; they have too few q-grams for edits.
SHORT_ITEM = 24
#: Benchmark characters that one pass over the documents holds as an index (about 20 bytes each); a larger benchmark takes several passes.
PASS_CHARS = 4_000_000
#: Document characters that are worked on at once.
PIECE = 1_000_000
_MIX = np.uint32(0xC2B2AE35)
#: Is the code point a letter or digit?
_ALNUM: np.ndarray | None = None


def _alnum() -> np.ndarray:
    global _ALNUM
    if _ALNUM is None:
        _ALNUM = np.fromiter((chr(c).isalnum() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _ALNUM


def normalise(text: str) -> np.ndarray:
    """Code points of the lower-cased text with every run of other than letters and digits as one space; ends trimmed."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inked = _alnum()[points]
    keep = inked.copy()
    keep[1:] |= inked[:-1]
    out = np.where(inked, points, 32)[keep].astype(np.uint32)
    return out[:-1] if len(out) and out[-1] == 32 else out


def origin(text: str, at: list[int]) -> list[int]:
    """Places in ``text`` of the characters of its normalised form with the numbers ``at``."""
    lowered = [c.lower() for c in text]
    owner = np.repeat(np.arange(len(text)), [len(c) for c in lowered])
    points = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    inked = _alnum()[points]
    keep = inked.copy()
    keep[1:] |= inked[:-1]
    places = owner[keep]
    return [int(places[min(i, len(places) - 1)]) for i in at]


def gram_hashes(points: np.ndarray, q: int = Q) -> np.ndarray:
    """A 32-bit number for each q-gram. Equal numbers of unequal grams cost an alignment at most.

    The gram is put together from halves, so that the work grows with log q.
    """
    if len(points) < q:
        return np.empty(0, dtype=np.uint32)
    n = len(points) - q + 1
    whole, have, power, width = None, 0, points * np.uint32(0x9E3779B1), 1
    rest = q
    while rest:
        if rest & 1:
            whole = power[:n].copy() if whole is None else whole * np.uint32(0x85EBCA6B) + power[have : have + n]
            have += width
        rest >>= 1
        if rest:
            power = power[:-width] * _MIX + power[width:]
            power ^= power >> np.uint32(15)
            width *= 2
    return whole


@dataclass
class Index:
    """The benchmark's items, their windows, and where each q-gram stands in the items."""

    text: np.ndarray  # all items' code points, one after the other
    items: np.ndarray  # item_id by window
    starts: np.ndarray  # of windows, in ``text``
    lengths: np.ndarray
    edits: np.ndarray  # allowed, by window
    bound: np.ndarray  # shared q-grams needed, by window
    band: int
    reach: int  # characters of the longest window and of a band
    grams: np.ndarray  # sorted distinct hashes
    first: np.ndarray  # of each gram in ``owner`` and ``place``
    owner: np.ndarray  # item's number, by gram occurrence
    place: np.ndarray  # of the gram in its item
    series: list[Series]
    sieve: np.ndarray  # does a hash with these high bits occur?
    q: int
    words: object  # automaton of short items, each between spaces; None without them
    begin: np.ndarray  # of items, in ``text``

    @property
    def least(self) -> int:
        return int(self.bound.min()) if len(self.bound) else 1 << 30


@dataclass
class Series:
    """Windows of one width and stride, by item: the number of the first, how many, and where the last starts."""

    width: int
    stride: int
    first: np.ndarray
    count: np.ndarray
    last: np.ndarray

    def covering(self, item: np.ndarray, place: np.ndarray, q: int) -> tuple[np.ndarray, np.ndarray]:
        """The least window that holds the q-gram at each place, and how many from it on do. An item's windows start each
        stride, the last one at the item's end."""
        low = np.maximum(0, -(-(place - (self.width - q)) // self.stride))
        high = np.where(place >= self.last[item], self.count[item] - 1, np.minimum(place // self.stride, self.count[item] - 1))
        return self.first[item] + np.minimum(low, self.count[item] - 1), np.where(self.count[item] > 0, np.maximum(high - np.minimum(low, high) + 1, 0), 0)


def _starts(n: int, window: int, stride: int) -> np.ndarray:
    return np.zeros(1, dtype=np.int64) if n <= window else np.append(np.arange(0, n - window, stride, dtype=np.int64), n - window)


def build(items: list[tuple[int, str]], q: int = Q, window: int = WINDOW, stride: int = STRIDE, rate: float = EDIT_RATE, short_item: int = SHORT_ITEM, short: int = SHORT, short_stride: int = SHORT_STRIDE, short_edits: int = SHORT_EDITS) -> Index:
    """Index the windows of (item_id, text). Items that are equal when normalised are known by their smallest id."""
    own: dict[bytes, int] = {}
    for item, text in items:
        key = normalise(text_or_empty(text)).tobytes()
        own[key] = min(item, own.get(key, item))
    brief = {key: item for key, item in own.items() if 0 < len(key) // 4 < max(short_item, q)}
    words = None
    if brief:
        import ahocorasick

        words = ahocorasick.Automaton()
        for key, item in brief.items():
            words.add_word(f" {key.decode('utf-32-le', 'surrogatepass')} ", (item, len(key) // 4))
        words.make_automaton()
    known = [(item, np.frombuffer(key, dtype=np.uint32)) for key, item in own.items() if len(key) // 4 >= max(short_item, q)]
    begin = np.cumsum([0] + [len(p) for _, p in known])
    ids, starts, lengths, allowed, series = [], [], [], [], []
    total = 0
    for width, step, most in ((window, stride, None), (short, short_stride, short_edits)):
        first, count, last = [], [], []
        for (item, points), at in zip(known, begin, strict=False):
            n = len(points)
            cuts = _starts(n, width, step) if most is None or width < min(n, window) else np.empty(0, dtype=np.int64)
            size = min(n, width)
            first.append(total), count.append(len(cuts)), last.append(n - size)
            total += len(cuts)
            ids.append(np.full(len(cuts), item, dtype=np.int64))
            starts.append(cuts + at)
            lengths.append(np.full(len(cuts), size))
            allowed.append(np.full(len(cuts), int(size * rate) if most is None else most))
        series.append(Series(width, step, *(np.array(x, dtype=np.int64) for x in (first, count, last))))
    flat = lambda x: np.concatenate(x) if x else np.empty(0, dtype=np.int64)
    lengths_a = flat(lengths)
    # As many edits as are allowed, but no more than leave the lemma a bound above zero.
    edits = np.minimum(flat(allowed), np.maximum((lengths_a - 1) // q - 1, 0))
    bound = lengths_a + 1 - q * (edits + 1)
    hashes = [gram_hashes(p, q) for _, p in known]
    h = np.concatenate(hashes) if hashes else np.empty(0, dtype=np.uint32)
    order = np.argsort(h, kind="stable")
    grams, first_of = np.unique(h[order], return_index=True)
    sieve = np.zeros(1 << 22, dtype=bool)
    sieve[grams >> np.uint32(10)] = True
    owner = np.repeat(np.arange(len(hashes), dtype=np.int32), [len(x) for x in hashes])
    place = np.arange(len(h), dtype=np.int64) - np.repeat(np.cumsum([0, *map(len, hashes)])[:-1], [len(x) for x in hashes]) if hashes else np.empty(0)
    text = np.concatenate([p for _, p in known]) if known else np.empty(0, dtype=np.uint32)
    band = int(edits.max(initial=0)) + 1
    return Index(text, flat(ids), flat(starts), lengths_a, edits, bound, band, window + band, grams, np.append(first_of, len(h)).astype(np.int64), owner[order], place[order].astype(np.int32), series, sieve, q, words, begin)


def candidates(points: np.ndarray, index: Index) -> tuple[np.ndarray, np.ndarray]:
    """(window, lowest diagonal of a band) pairs that reach the lemma's bound in ``points``. Diagonal: place - offset in the window."""
    none = np.empty(0, dtype=np.int64)
    h = gram_hashes(points, index.q)
    at = np.flatnonzero(index.sieve[h >> np.uint32(10)])
    if len(at) < index.least or not len(index.grams):
        return none, none
    place = np.searchsorted(index.grams, h[at])
    place[place == len(index.grams)] = 0
    real = index.grams[place] == h[at]
    at, place = at[real], place[real]
    # A first sieve on counts alone: a stretch as long as a window and its edits has the least bound of hits.
    reach, least = index.reach, index.least
    if len(at) < least:
        return none, none
    full = np.flatnonzero(at[least - 1 :] - at[: len(at) - least + 1] <= reach)
    if not len(full):
        return none, none
    mark = np.zeros(len(at) + 1, dtype=np.int64)
    np.add.at(mark, full, 1)
    np.add.at(mark, full + least, -1)
    hot = mark[:-1].cumsum() > 0
    at, place = at[hot], place[hot]
    width, span = index.band, len(points) + 2 * reach
    found_w, found_b = [], []
    many = index.first[place + 1] - index.first[place]
    # Hits are expanded stretch by stretch, to bound memory; stretches overlap by a window's reach.
    ends = np.cumsum(many)
    begin = 0
    while begin < len(at):
        stop = max(int(np.searchsorted(ends, ends[begin] + 100_000)), begin + 1)
        stop = min(len(at), max(stop, int(np.searchsorted(at, at[begin] + 2 * reach))))
        p, g, m = at[begin:stop], place[begin:stop], many[begin:stop]
        start = _spread(index.first[g], m)
        item, offset, hit = index.owner[start].astype(np.int64), index.place[start].astype(np.int64), np.repeat(p, m)
        for series in index.series:
            low, n = series.covering(item, offset, index.q)
            win = _spread(low, n)
            # place in the document, less the gram's offset in the window
            diagonal = np.repeat(hit - offset - index.begin[item], n) + index.starts[win] + reach
            for shift in (0, 1):  # two sets of bands of two widths each, overlapping by one
                band = (diagonal // width + shift) // 2
                key = (win * 2 + shift) * (span // width + 3) + band
                kinds, back, count = np.unique(key, return_inverse=True, return_counts=True)
                enough = count[back] >= index.bound[win]
                if enough.any():
                    k, one = np.unique(key[enough], return_index=True)
                    found_w.append(win[enough][one])
                    found_b.append((band[enough][one] * 2 - shift) * width - reach)
        if stop == len(at):
            break
        begin = max(begin + 1, int(np.searchsorted(at, at[stop - 1] - reach)))
    if not found_w:
        return none, none
    both = np.unique(np.stack([np.concatenate(found_w), np.concatenate(found_b)]), axis=1)
    return both[0], both[1]


def _spread(first: np.ndarray, n: np.ndarray) -> np.ndarray:
    """first, first + 1, ... n of them, for each."""
    return np.repeat(first - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(int(n.sum()))


def align(points: np.ndarray, index: Index, windows: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Least edits between each window and any part of ``points`` inside its band, and where that part ends.

    All candidates are aligned at once, row by row of the windows; a cell is a window place and a diagonal of the band.
    """
    n, wide = len(windows), 2 * index.band + 1
    lengths = index.lengths[windows]
    rows = index.text[np.minimum(index.starts[windows][:, None] + np.arange(int(lengths.max())), len(index.text) - 1)]
    steps = np.arange(wide)
    big = 1 << 20
    cost = np.where((low[:, None] + steps >= 0) & (low[:, None] + steps <= len(points)), 0, big).astype(np.int64)
    best, end = np.full(n, big), np.zeros(n, dtype=np.int64)
    for i in range(rows.shape[1]):
        place = low[:, None] + i + steps
        inside = (place >= 0) & (place < len(points))
        same = points[np.clip(place, 0, max(0, len(points) - 1))] == rows[:, i : i + 1]
        new = np.where(inside, cost + ~same, big)  # the window's character for the document's, on one diagonal
        new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)  # ... left out: from the diagonal above
        new = np.minimum.accumulate(new - steps, axis=1) + steps  # characters of the document left out
        cost = np.minimum(new, big)
        done = lengths == i + 1
        if done.any():
            at = cost[done].argmin(axis=1)
            best[done] = cost[done, at]
            end[done] = low[done] + i + 1 + at
    return best, end


def matches(points: np.ndarray, index: Index) -> list[tuple[int, int, int, int, int]]:
    """(item_id, start, end, windows, edits) of the benchmark parts in one normalised document; ends are exclusive."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    for piece in range(0, max(1, len(points)), PIECE):
        from_ = max(0, piece - index.reach - 2 * index.band)
        part = points[from_ : piece + PIECE]
        windows, low = candidates(part, index)
        for at in range(0, len(windows), 5000):
            w, lo = windows[at : at + 5000], low[at : at + 5000]
            edits, end = align(part, index, w, lo)
            for j in np.flatnonzero(edits <= index.edits[w]):
                stop = int(end[j]) + from_
                found.setdefault(int(index.items[w[j]]), []).append((max(0, stop - int(index.lengths[w[j]])), stop, int(w[j]), int(edits[j])))
        if index.words is not None:
            text = f" {part.tobytes().decode('utf-32-le', 'surrogatepass')} "
            for end, (item, n) in index.words.iter(text):
                # The piece's own ends are ends of words only where the document's are, or a space is.
                stop = from_ + end - 1
                if (stop == len(points) or points[stop] == 32) and (stop == n or points[stop - n - 1] == 32):
                    found.setdefault(item, []).append((stop - n, stop, -1, 0))
    out = []
    for item, spans in found.items():
        spans.sort()
        start, end, wins, edits = spans[0][0], spans[0][1], {spans[0][2]}, spans[0][3]
        for s, e, w, d in spans[1:]:
            if s > end:
                out.append((item, start, end, len(wins), edits))
                start, end, wins, edits = s, e, {w}, d
            else:
                end, edits = max(end, e), min(edits, d)
                wins.add(w)
        out.append((item, start, end, len(wins), edits))
    return sorted(out)


def _passes(benchmark: DataFrame, most: int) -> Iterator[list[tuple[int, str]]]:
    """The benchmark's distinct texts with their smallest id, in parts of about ``most`` characters. One part at a time is on the driver."""
    items = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").groupBy("text").agg(F.min("item_id").alias("item_id"))
    parts = -(-int(items.agg(F.coalesce(F.sum(F.length("text")), F.lit(0))).first()[0]) // most)
    for k in range(parts):
        yield [(r[0], r[1]) for r in items.where(F.pmod(F.xxhash64("text"), F.lit(parts)) == k).select("item_id", "text").collect()]


def find(docs: DataFrame, benchmark: DataFrame, pass_chars: int = PASS_CHARS, **how: object) -> DataFrame:
    """One row per document and benchmark passage in it: doc_id, item_id, start, end, n_windows, edits.

    ``start`` and ``end`` are code points of the text. A document holds an item if one of the item's windows (of
    WINDOW characters, each STRIDE; the whole item if shorter) is within EDIT_RATE edits of a part of it, or one of
    SHORT characters, each SHORT_STRIDE, within SHORT_EDITS, both normalised. Items under SHORT_ITEM normalised
    characters must occur as they are, as whole words. Null and empty texts match nothing, nor do items without a letter
    or digit. Equal items are reported under their smallest id; an item that occurs in several places of a document has
    a row for each. Repeated documents are reported each; empty tables give no rows. Other columns aren't read.
    """
    kind = dict(docs.dtypes)["doc_id"]
    schema = f"doc_id {kind}, item_id long, start long, end long, n_windows int, edits int"
    out = None
    for items in _passes(benchmark, pass_chars):
        index = docs.sparkSession.sparkContext.broadcast(build(items, **how))

        def run(frames: Iterator[pd.DataFrame], index=index) -> Iterator[pd.DataFrame]:
            for f in frames:
                rows = []
                for doc, text in zip(f["doc_id"], f["text"], strict=True):
                    text = text_or_empty(text)
                    for item, start, end, wins, edits in matches(normalise(text), index.value) if text else []:
                        a, b = origin(text, [start, end - 1])
                        rows.append((doc, item, a, b + 1, wins, edits))
                yield pd.DataFrame(rows, columns=["doc_id", "item_id", "start", "end", "n_windows", "edits"])

        part = docs.select("doc_id", "text").mapInPandas(run, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def _is_clean(index):
    @F.pandas_udf("boolean")
    def clean(texts: pd.Series) -> pd.Series:
        return pd.Series([not matches(normalise(t), index.value) if isinstance(t, str) and t else True for t in texts], dtype=bool)

    return clean


def keep_clean(docs: DataFrame, benchmark: DataFrame, pass_chars: int = PASS_CHARS, **how: object) -> DataFrame:
    """Rows of ``docs``, all columns whatever they are called, that hold no benchmark passage as ``find`` looks for it.

    Null and empty texts stay, repeated rows stay or go together, an empty benchmark leaves all rows.
    """
    for items in _passes(benchmark, pass_chars):
        index = docs.sparkSession.sparkContext.broadcast(build(items, **how))
        docs = docs.where(_is_clean(index)(F.col("text")))
    return docs


def op1_decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, item_id, start, end, n_windows, edits of every passage; nulls, ties, repeats and empty tables: as ``find`` says."""
    return find(docs, benchmark)
