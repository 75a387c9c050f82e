"""Alignment of two tokenizers on the same texts, and how often pairs of their tokens end together.

Each text is encoded by both tokenizers of a pair, and tokens get the byte ranges of the text that they stand for. Where a
token of each ends at the same byte the text is cut into a group, and the two tokens are linked. A pair of ids is one
64-bit key. Keys are counted within a task first, the counts are sorted over ranges of keys, and runs of one key are
added up. The sorted counts lie in files in the shared folder; tasks map them into memory and look keys up by binary
search, so that no document's links are exchanged. There are at most as many pairs as the vocabularies allow, however
large the corpus is.
"""

from __future__ import annotations

import os
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from hashlib import sha256
from itertools import chain
from urllib.parse import unquote, urlparse

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batch_rows, slices, staged, staging_path, text_or_empty

BYTE_LEVEL, PIECES = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
#: Bytes of the largest vocabulary file that is sent to the executors.
MAX_VOCABULARY = 32 << 20
#: Rows of a batch, characters of a slice of it.
BATCH_ROWS, SLICE = 1000, 500_000
#: Units that a task keeps, and the longest one that it keeps.
UNITS, UNIT_CHARS = 400_000, 40
#: Keys that a task holds before it adds them up, and distinct ones before it gives them out.
HELD, GIVEN = 2_000_000, 4_000_000
MASK = (1 << 32) - 1
#: A single space between two other characters: both tokenizers start a new token there, whatever lies before.
_SPACE = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")
#: Text that may stand between such spaces, and how many units are encoded as one text.
_EDGES, RUN = re.compile(r"[^\s▁](?:.*[^\s▁])?\Z", re.S), 500


@dataclass(frozen=True)
class Pair:
    """The files of a byte-level vocabulary (for ``tokenizers``) and of a piece vocabulary (for ``sentencepiece``)."""

    byte_level: bytes
    pieces: bytes

    @staticmethod
    def read(byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> Pair:
        """The driver reads the files; their size is checked, since executors get them."""
        found = []
        for path in (byte_level, pieces):
            if os.path.getsize(path) > MAX_VOCABULARY:
                raise ValueError(f"{path} is larger than {MAX_VOCABULARY} bytes")
            with open(path, "rb") as file:
                found.append(file.read())
        return Pair(*found)


def byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level entry stands for: printable ones stand for themselves, the others
    follow from code point 256 on."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


@dataclass
class _Known:
    """Aligned units: whether both tokenizers give their bytes back, numbers of tokens and groups, the groups as text, and
    the linked pairs, of which a unit's begin at ``start``."""

    index: dict[str, int]
    whole: np.ndarray
    n_a: np.ndarray
    n_b: np.ndarray
    n_groups: np.ndarray
    start: np.ndarray
    groups: list[str]
    pairs: np.ndarray


class _Encoders:
    """Both tokenizers, the bytes and the decimal strings of their tokens.

    Where both tokenizers start a new token at a space whatever lies before, a text is cut into units, words mostly, which
    are encoded by themselves and put together. Units that come again aren't encoded again.
    """

    def __init__(self, pair: Pair) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_str(pair.byte_level.decode("utf-8"))
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_proto=pair.pieces)
        of, entries = byte_of_character(), self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(entries.values()) + 1)
        for token, i in entries.items():
            self.bytes_a[i] = bytes(of[c] for c in token) if all(c in of for c in token) else token.encode("utf-8")
        self.bytes_b = [self._piece(i) for i in range(self.b.get_piece_size())]
        # A text may be cut at a space unless a piece of several words could lie across it.
        self.cuts = not any("▁" in self.b.id_to_piece(i).lstrip("▁") for i in range(len(self.bytes_b)))
        self.size_a, self.size_b = (np.array([len(x) for x in own], dtype=np.int64) for own in (self.bytes_a, self.bytes_b))
        n = max(len(self.bytes_a), len(self.bytes_b))
        self.comma, self.bar, self.semicolon = (np.array([f"{i}{end}" for i in range(n)], dtype=object) for end in ",|;")
        self.forget()

    def _piece(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:-1], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode("utf-8")

    def forget(self) -> None:
        none = np.empty(0, dtype=np.int64)
        self.known = _Known({}, np.empty(0, dtype=bool), none, none, none, none, [], none)

    def cut(self, text: str) -> list[str]:
        """The units of a text; the spaces between them are left out, since both tokenizers put one before a unit."""
        return _SPACE.split(text) if self.cuts else [text]

    def _encoded(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray] | None]:
        """The ids of both tokenizers for each text; None where either's bytes aren't the text's."""
        a = self.a.encode_batch_fast([" " + t for t in texts], add_special_tokens=False)
        for text, x, y in zip(texts, a, self.b.encode(texts, num_threads=1), strict=True):
            raw, ids = b" " + text.encode("utf-8", "replace"), x.ids
            same = b"".join(map(self.bytes_a.__getitem__, ids)) == raw and b"".join(map(self.bytes_b.__getitem__, y)) == raw
            yield (np.array(ids, dtype=np.int64), np.array(y, dtype=np.int64)) if same else None

    def learn(self, units: list[str]) -> _Known:
        """Align units, many at once: what is known of them.

        Units between which texts are cut are encoded as one text again, which costs less than one by one. Where that
        text's bytes don't come back, each is encoded by itself.
        """
        joint = [u for u in units if self.cuts and _EDGES.match(u)]
        alone = [u for u in units if not (self.cuts and _EDGES.match(u))]
        good, ids_a, ids_b = [], [], []
        runs = [joint[i : i + RUN] for i in range(0, len(joint), RUN)]
        for run, ids in zip(runs, self._encoded([" ".join(run) for run in runs]), strict=True):
            if ids is None:
                alone += run
            else:
                good += run
                ids_a.append(ids[0])
                ids_b.append(ids[1])
        bad = []
        for unit, ids in zip(alone, self._encoded(alone), strict=True):
            if ids is None:
                bad.append(unit)
            else:
                good.append(unit)
                ids_a.append(ids[0])
                ids_b.append(ids[1])
        none = np.empty(0, dtype=np.int64)
        a, b = np.concatenate([none, *ids_a]), np.concatenate([none, *ids_b])
        # All units behind each other are one long text; each unit ends at an end of both.
        i, j = self.align(a, b)
        texts = self.groups(a, b, i, j)
        ends = np.cumsum([1 + len(u.encode("utf-8", "replace")) for u in good], dtype=np.int64)
        n_a, n_b = (np.diff(np.searchsorted(size[own].cumsum(), ends) + 1, prepend=0) for size, own in ((self.size_a, a), (self.size_b, b)))
        n_groups = np.diff(np.searchsorted(i, np.cumsum(n_a)), prepend=0)
        last = np.cumsum(n_a + n_b).tolist()
        joined = ["".join(texts[s:e])[:-1] for s, e in zip([0, *last], last, strict=False)]
        more = np.zeros(len(bad), dtype=np.int64)
        n_a, n_b, n_groups = (np.concatenate([n, more]) for n in (n_a, n_b, n_groups))
        names = [*good, *bad]
        return _Known(dict(zip(names, range(len(names)), strict=True)), np.arange(len(names)) < len(good), n_a, n_b, n_groups, np.cumsum(n_groups) - n_groups, joined + [""] * len(bad), a[i] << 32 | b[j])

    def align(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Indexes of the tokens of both that end together, group by group."""
        _, i, j = np.intersect1d(self.size_a[a].cumsum(), self.size_b[b].cumsum(), assume_unique=True, return_indices=True)
        return i, j

    def groups(self, a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> list[str]:
        """The texts of all tokens, which joined are the groups as ``a1,a2|b1;a3|b2,b3;``."""
        at_a = np.arange(len(a)) + np.concatenate([[0], j + 1])[np.searchsorted(i, np.arange(len(a)))]
        at_b = np.arange(len(b)) + (i + 1)[np.searchsorted(j, np.arange(len(b)))]
        out = np.empty(len(a) + len(b), dtype=object)
        out[at_a], out[at_b] = self.comma[a], self.comma[b]
        out[at_a[i]], out[at_b[j]] = self.bar[a[i]], self.semicolon[b[j]]
        return out.tolist()

    def _kept(self, own: _Known) -> None:
        """Add what was learned to what is kept, long units left out; start anew where that would be too much."""
        keep = [i for i, u in enumerate(own.index) if len(u) <= UNIT_CHARS]
        if len(self.known.index) + len(keep) > UNITS:
            self.forget()
        if not keep or len(keep) > UNITS:
            return
        k, at, names = self.known, np.array(keep), list(own.index)
        sizes = own.n_groups[at]
        place = np.repeat(own.start[at] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        for name in ("whole", "n_a", "n_b", "n_groups"):
            setattr(k, name, np.concatenate([getattr(k, name), getattr(own, name)[at]]))
        k.start = np.concatenate([k.start, len(k.pairs) + np.cumsum(sizes) - sizes])
        k.pairs = np.concatenate([k.pairs, own.pairs[place]])
        for i in keep:
            k.index[names[i]] = len(k.groups)
            k.groups.append(own.groups[i])

    def documents(self, texts: list[str]) -> Iterator[tuple[int, int, int, str, np.ndarray, np.ndarray] | None]:
        """For each text the numbers of tokens and of groups, the groups, the distinct linked pairs and how often each is
        linked; None where a text is empty or either tokenizer's bytes aren't the text's."""
        cut = [self.cut(t) if t else [] for t in texts]
        old, base = self.known, len(self.known.groups)
        own = self.learn([u for u in dict.fromkeys(chain.from_iterable(cut)) if u not in old.index])
        number = old.index | {u: base + i for u, i in own.index.items()}
        whole, n_a, n_b, n_groups = (np.concatenate([getattr(old, n), getattr(own, n)]) for n in ("whole", "n_a", "n_b", "n_groups"))
        start, pairs = np.concatenate([old.start, len(old.pairs) + own.start]), np.concatenate([old.pairs, own.pairs])
        for text, units in zip(texts, cut, strict=True):
            at = np.array([*map(number.__getitem__, units)], dtype=np.int64)
            if not text or not whole[at].all():
                yield None
                continue
            groups = ";".join([old.groups[i] if i < base else own.groups[i - base] for i in at.tolist()])
            distinct, times = np.unique(at, return_counts=True)
            sizes = n_groups[distinct]
            place = np.repeat(start[distinct] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
            yield int(n_a[at].sum()), int(n_b[at].sum()), int(n_groups[at].sum()), groups, *_added_up(pairs[place], np.repeat(times, sizes))
        self._kept(own)


@lru_cache(maxsize=2)
def _encoders(pair: Pair) -> _Encoders:
    return _Encoders(pair)


def aligned(docs: DataFrame, pair: Pair, with_groups: bool = False) -> DataFrame:
    """One row per input row: row (a number of its own), doc_id, n_a, n_b, n_groups, n_links, groups_sha256, keys, times.

    ``keys`` are the linked pairs of the text, id of the first tokenizer times 2^32 plus id of the second, distinct and
    ascending, ``times`` their numbers. ``with_groups`` adds the groups themselves. Texts that are null or empty, or that a
    tokenizer doesn't give back byte for byte, have no tokens.
    """
    kind, sent = dict(docs.dtypes)["doc_id"], docs.sparkSession.sparkContext.broadcast(pair)
    none = np.empty(0, dtype=np.int64)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoders, number = _encoders(sent.value), TaskContext.get().partitionId() << 40
        for f in slices(frames, "text", SLICE):
            rows = []
            for found in encoders.documents(f["text"].map(text_or_empty).tolist()):
                if found is None:
                    rows.append((0, 0, 0, "", "", none, none))
                    continue
                n_a, n_b, n_groups, groups, keys, times = found
                rows.append((n_a, n_b, n_groups, sha256(groups.encode()).hexdigest(), groups if with_groups else "", keys, times))
            out = pd.DataFrame(rows, columns=["n_a", "n_b", "n_groups", "groups_sha256", "groups", "keys", "times"])
            out.insert(0, "row", np.arange(number, number + len(out)))
            out.insert(1, "doc_id", f["doc_id"].to_numpy())
            out.insert(5, "n_links", out["n_groups"])  # one pair of tokens ends where a group does
            number += len(out)
            yield out if with_groups else out.drop(columns="groups")

    more = "groups string, " if with_groups else ""
    schema = f"row long, doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, {more}keys array<long>, times array<long>"
    with batch_rows(docs.sparkSession, BATCH_ROWS):
        return staged(docs.select("doc_id", "text").mapInPandas(run, schema), "aligned")


def _added_up(keys: np.ndarray, amounts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys, ascending, and their amounts' sums."""
    order = np.argsort(keys)
    own, amounts = keys[order], amounts[order]
    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]])) if len(own) else np.empty(0, dtype=np.int64)
    return own[first], np.add.reduceat(amounts, first) if len(own) else amounts.astype(np.int64)


def _partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A task's keys and their counts: added up as they come, given out early where they are very many."""
    keys, counts, held = [], [], 0
    for f in frames:
        keys.extend(f["keys"])
        counts.extend(f["times"])
        held += int(f["keys"].map(len).sum())
        if held >= HELD:
            k, n = _added_up(np.concatenate(keys), np.concatenate(counts))
            keys, counts, held = [k], [n], 0
            if len(k) >= GIVEN:
                yield pd.DataFrame({"key": k, "n": n})
                keys, counts = [], []
    if keys:
        k, n = _added_up(np.concatenate(keys), np.concatenate(counts))
        yield pd.DataFrame({"key": k, "n": n})


def _run_sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sorted rows: each run of one key becomes a row. The last run of a batch waits for the next batch."""
    last, amount = None, 0
    for f in frames:
        if not len(f):
            continue
        k, n = f["key"].to_numpy(), f["n"].to_numpy()
        start = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        own, total = k[start], np.add.reduceat(n, start)
        if last is not None:
            if own[0] == last:
                total[0] += amount
            else:
                own, total = np.concatenate([[last], own]), np.concatenate([[amount], total])
        last, amount = own[-1], total[-1]
        yield pd.DataFrame({"key": own[:-1], "n": total[:-1]})
    if last is not None:
        yield pd.DataFrame({"key": [last], "n": [amount]})


def pair_counts(links: DataFrame) -> DataFrame:
    """(key, n): in how many links of ``aligned`` rows each pair of ids is, sorted within ranges of keys, as a staged table."""
    partial = staged(links.select("keys", "times").mapInPandas(_partial, "key long, n long"), "partial-counts")
    ranged = partial.repartitionByRange("key").sortWithinPartitions("key")
    return staged(ranged.mapInPandas(_run_sums, "key long, n long"), "pair-counts")


def best_counts(counts: DataFrame) -> DataFrame:
    """(b, best): the highest count of the pairs that hold each id of the second tokenizer; at most a row for each id."""
    return counts.groupBy(F.col("key").bitwiseAND(F.lit(MASK)).alias("b")).agg(F.max("n").alias("best"))


@dataclass(frozen=True)
class Shards:
    """Files of sorted keys and of their counts, and the first key of each."""

    folder: str
    names: tuple[str, ...]
    first: np.ndarray

    def counts_of(self, keys: np.ndarray) -> np.ndarray:
        """The counts of keys, all of which are in the shards."""
        out, shard = np.zeros(len(keys), dtype=np.int64), np.searchsorted(self.first, keys, side="right") - 1
        for s in np.unique(shard):
            own, n = _mapped(f"{self.folder}/{self.names[s]}")
            mine = shard == s
            out[mine] = n[np.searchsorted(own, keys[mine])]
        return out


@lru_cache(maxsize=4096)
def _mapped(path: str) -> tuple[np.ndarray, np.ndarray]:
    both = np.memmap(path, dtype=np.int64, mode="r").reshape(2, -1)
    return both[0], both[1]


def mappable(path: str) -> bool:
    """Whether tasks can map files under a path into memory: a shared folder that is mounted, not an object store."""
    return urlparse(path).scheme in ("", "file")


def write_shards(counts: DataFrame) -> Shards:
    """Write ``pair_counts`` as files to map: keys, then counts. A file gets its name when it is whole, so a task that runs
    again, or twice at a time, leaves the same file."""
    folder = unquote(urlparse(staging_path(counts.sparkSession, "shards")).path)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        whole = [f for f in frames if len(f)]
        if whole:
            os.makedirs(folder, exist_ok=True)
            keys, name = np.concatenate([f["key"] for f in whole]), f"{TaskContext.get().partitionId():06d}"
            own = f"{folder}/.{name}-{uuid.uuid4().hex}"
            with open(own, "wb") as file:
                file.write(keys.tobytes())
                file.write(np.concatenate([f["n"] for f in whole]).tobytes())
                file.flush()
                os.fsync(file.fileno())
            os.replace(own, f"{folder}/{name}")
            yield pd.DataFrame({"name": [name], "first": keys[:1]})

    ranged = counts.repartitionByRange("key").sortWithinPartitions("key")
    found = ranged.mapInPandas(run, "name string, first long").orderBy("first").collect()  # a row a file
    return Shards(folder, tuple(r["name"] for r in found), np.array([r["first"] for r in found], dtype=np.int64))


def _looked_up(links: DataFrame, counts: DataFrame) -> DataFrame:
    """(doc's columns, n_best, count_sum) by binary search in mapped files."""
    shards = write_shards(counts)
    found = best_counts(counts).collect()  # at most a row for each id of the second vocabulary
    best = np.zeros(max([b for b, _ in found], default=0) + 1, dtype=np.int64)
    for b, n in found:
        best[b] = n
    sent = links.sparkSession.sparkContext.broadcast((shards, best))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shards, best = sent.value
        for f in frames:
            sizes = f["keys"].map(len).to_numpy(dtype=np.int64)
            doc = np.repeat(np.arange(len(f)), sizes)
            keys = np.concatenate([np.empty(0, dtype=np.int64), *f["keys"]]).astype(np.int64)
            times = np.concatenate([np.empty(0, dtype=np.int64), *f["times"]]).astype(np.int64)
            own, at = np.unique(keys, return_inverse=True)
            n = shards.counts_of(own)[at] if len(own) else np.empty(0, dtype=np.int64)
            top, total = np.zeros(len(f), dtype=np.int64), np.zeros(len(f), dtype=np.int64)
            np.add.at(top, doc, times * (n == best[keys & MASK]))
            np.add.at(total, doc, times * n)
            out = f.drop(columns=["keys", "times"])
            yield out.assign(n_best=top, count_sum=total)

    kept = [c for c in links.columns if c not in ("keys", "times")]
    schema = ", ".join(f"`{name}` {kind}" for name, kind in links.select(*kept).dtypes)
    with batch_rows(links.sparkSession, BATCH_ROWS):
        return staged(links.mapInPandas(run, f"{schema}, n_best long, count_sum long"), "looked-up")


def _joined(links: DataFrame, counts: DataFrame) -> DataFrame:
    """What ``_looked_up`` returns, by joins: for shared folders that can't be mapped."""
    each = links.select("row", F.explode(F.arrays_zip("keys", "times")).alias("link")).select("row", F.col("link.keys").alias("key"), F.col("link.times").alias("times"))
    sized = counts.join(F.broadcast(best_counts(counts)), F.col("key").bitwiseAND(F.lit(MASK)) == F.col("b")).select("key", "n", (F.col("n") == F.col("best")).alias("top"))
    sums = each.join(sized, "key").groupBy("row").agg(F.sum(F.when(F.col("top"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = F.lit(0).cast("long")
    return links.drop("keys", "times").join(sums, "row", "left").withColumns({"n_best": F.coalesce("n_best", zero), "count_sum": F.coalesce("count_sum", zero)})


def alignment(docs: DataFrame, pair: Pair, mapped: bool | None = None, with_groups: bool = False) -> DataFrame:
    """``aligned`` rows without their keys, and n_best (links whose count is the highest of their second id, ties
    included) and count_sum (the counts' sum over links). Counts are those of all ``docs``.

    ``mapped`` tells whether counts are looked up in mapped files; without it they are where the shared folder allows it.
    """
    links = aligned(docs, pair, with_groups)
    counts = pair_counts(links)
    use = mappable(staging_path(docs.sparkSession, "shards")) if mapped is None else mapped
    return (_looked_up if use else _joined)(links, counts)


def op12_token_alignment(docs: DataFrame, byte_level: str = BYTE_LEVEL, pieces: str = PIECES) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of ``docs``.

    Null and empty texts, and texts that a tokenizer changes, have zeros and an empty ``groups_sha256``; their words count
    nowhere. Rows that repeat a document count each time. Long texts are cut where both tokenizers start a new token
    anyway. Only doc_id and text are read; null ids come back as they are; an empty table gives an empty result.
    """
    columns = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    return alignment(docs, Pair.read(byte_level, pieces)).select(*columns)
