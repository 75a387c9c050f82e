"""Secret scan: fixed patterns, and a token-efficiency test for random strings.

A tokenizer's vocabulary holds the pieces of ordinary words, so a random string needs many tokens for its length.
Runs of 16 or more key characters, with or without digits, are tokenised; runs of few characters per token are reported
as kind ``random``, after known digests (whole hexadecimal digests, UUIDs, integrity hashes), identifiers made of words,
numbers and dates are left out. Words of one case, and short runs, must be still less efficient.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, text_or_empty

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Bytes of the largest vocabulary that is sent to the executors.
MAX_VOCABULARY = 16 << 20
#: The split pattern that goes with byte-level vocabularies of this family.
SPLIT = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
LEAST_RUN, LONG_RUN = 16, 20
#: Characters per token up to which a run is random. Random strings of digits and both cases come near 1.3, of one case
#: near 1.65; prose and identifiers of LONG_RUN characters come over 2.2, shorter ones over 1.8 but for a few.
MOST_PER_TOKEN = 2.2
MOST_SHORT, MOST_ONE_CASE, MOST_SHORT_ONE_CASE = 1.75, 1.95, 1.5
RUN = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{LEAST_RUN},}}")
#: Letters of one case, a capital in front or not: an unknown word or a random string of a small alphabet.
ONE_CASE = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")
#: Hexadecimal lengths of common digests (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512).
DIGESTS = frozenset((32, 40, 56, 64, 96, 128))
_UUID = re.compile(r"[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", re.I)
_INTEGRITY = re.compile(r"sha(?:256|384|512)-[A-Za-z0-9+/]+=*")
_NUMERIC = re.compile(r"[0-9_+/=.TZ-]+")
_HEXADECIMAL = re.compile(r"[0-9a-fA-F]+")
#: A part of an identifier: letters of one case (or capitalised) up to a capital; or letters, a number of up to four digits or both, up to a separator or the end.
_IDENTIFIER = re.compile(r"(?:[A-Z]?[a-z]{2,}|[A-Z]{2,}|[a-zA-Z])(?=[A-Z])|(?:[A-Z]?[a-z]+|[A-Z]+)?[0-9]{0,4}(?:[_/+=-]+|$)")


@lru_cache(maxsize=2)
def _encoder(vocabulary: bytes):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}
    return tiktoken.Encoding("candidates", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def is_known(run: str) -> bool:
    """A digest, UUID, number, date or an identifier put together from several words: no secret."""
    if _NUMERIC.fullmatch(run) or _UUID.fullmatch(run) or _INTEGRITY.fullmatch(run):
        return True
    if _HEXADECIMAL.fullmatch(run) and len(run) in DIGESTS:
        return True
    if ONE_CASE.fullmatch(run):
        return False
    at = letters = pieces = 0
    while at < len(run):
        m = _IDENTIFIER.match(run, at)
        if not m or m.end() == at:
            return False
        own = sum(c.isalpha() for c in m[0])
        pieces += own > 0
        letters += own
        at = m.end()
    return letters >= 3 * pieces  # words of some length on the whole


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """The fixed patterns' spans as (start, kind's place, end), leftmost and not overlapping within a kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def random_spans(text: str, encode, base: list[tuple[int, int, int]], most_per_token: float = MOST_PER_TOKEN) -> list[tuple[int, int, int]]:
    """Runs that the tokenizer compresses badly, apart from those inside a base span."""
    out = []
    starts = [s for s, _, _ in base]
    reach = list(accumulate((e for _, _, e in base), max))  # the furthest end of the spans up to each
    for m in RUN.finditer(text):
        run, before = m[0], bisect_right(starts, m.start())
        if before and m.end() <= reach[before - 1] or is_known(run):
            continue
        one, long = bool(ONE_CASE.fullmatch(run)), len(run) >= LONG_RUN
        most = min(most_per_token, (MOST_ONE_CASE if one else most_per_token) if long else (MOST_SHORT_ONE_CASE if one else MOST_SHORT))
        if len(run) / len(encode(run)) <= most:
            out.append((m.start(), 3, m.end()))
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, vocabulary: str = VOCABULARY, most_per_token: float = MOST_PER_TOKEN) -> DataFrame:
    """doc_id, spans: array of (kind, start, end, secret) in code points, end exclusive, ordered by start then kind.

    Null and empty texts have none. Every row is scanned over its whole text; repeated rows give repeated results, an
    empty table gives none. Spans of several kinds may start at one place. Other columns aren't read. ``vocabulary`` is a
    file of token bytes (base 64) and ranks on the driver.
    """
    with open(vocabulary, "rb") as f:  # read on the driver, so that executors need no copy of the file
        content = f.read(MAX_VOCABULARY + 1)
    if len(content) > MAX_VOCABULARY:
        raise ValueError(f"{vocabulary} is larger than {MAX_VOCABULARY} bytes")
    shared = docs.sparkSession.sparkContext.broadcast(content)
    kind = dict(docs.dtypes)["doc_id"]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = _encoder(shared.value).encode_ordinary
        for f in slices(frames, "text"):
            rows = []
            for text in f["text"].map(text_or_empty):
                base = base_spans(text)
                rows.append([{"kind": KINDS[k], "start": s, "end": e, "secret": text[s:e]} for s, k, e in sorted(base + random_spans(text, encode, base, most_per_token))])
            yield pd.DataFrame({"doc_id": f["doc_id"], "spans": rows})

    return docs.select("doc_id", "text").mapInPandas(run, f"doc_id {kind}, spans array<struct<kind:string,start:long,end:long,secret:string>>")


def op2_secrets(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans of every row; nulls, ties, repeats and empty tables: as ``scan`` says."""
    found = scan(docs, vocabulary)
    text = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    base = F.filter("spans", lambda x: x["kind"] != "random")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(text(base).cast("binary"), 256).alias("base_sha256"), text(F.col("spans")).alias("spans"), count("random"))
