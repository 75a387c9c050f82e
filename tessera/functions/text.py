"""Scalar functions as Column expressions: names, titles, slugs, numbers, dates, URLs, confidences."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_name(c: Column) -> Column:
    """Trimmed of spaces and lower-cased."""
    return F.lower(F.trim(c))


def positive_id(c: Column) -> Column:
    """The text as a positive integer, else null. ``12.0`` and ``1e2`` count as integers."""
    n = c.try_cast("double")
    return F.when((n > 0) & (n == F.floor(n)), n.cast("long"))


def clamp_confidence(c: Column) -> Column:
    """Rounded half up into 0..100; null and NaN are 0."""
    usable = c.isNotNull() & ~F.isnan(c.cast("double"))
    return F.when(usable, F.least(F.lit(100), F.greatest(F.lit(0), F.floor(c.cast("double") + 0.5)))).otherwise(0).cast("int")


def status_of(confidence: Column) -> Column:
    return F.when(confidence >= 90, "confirmed").when(confidence >= 65, "likely").when(confidence >= 40, "possible").otherwise("unknown")


def default_confidence(source: Column, kind: Column, has_url: Column) -> Column:
    return (
        F.when((source == "manual") & (kind == "manual_verified"), 100)
        .when(kind.isin("provider_audio", "provider_subtitle", "official_announcement"), 90)
        .when(kind.isin("home_video_release", "voice_cast"), 75)
        .when((kind == "community_submission") & has_url, 50)
        .otherwise(20)
    )


#: Stands for "no further character" in the tables below; it is no character of any text (a Unicode noncharacter).
_NOTHING = "\uffff"


@cache
def _decompositions() -> tuple[str, list[str], str]:
    """(characters, their parts, other characters that change): the compatibility decompositions without marks.

    The first ones have several parts (of which the n-th string holds the n-th, _NOTHING where there are fewer); the last
    two-line string holds those with one part or none, over their counterparts.
    """
    one, many = {}, {}
    for code in range(0x80, 0x110000):
        if not 0xD800 <= code < 0xE000:
            c = chr(code)
            plain = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.category(x).startswith("M"))
            if plain != c:
                (one if len(plain) <= 1 else many)[c] = plain
    longest = max(map(len, many.values()))
    parts = ["".join(v[i] if i < len(v) else _NOTHING for v in many.values()) for i in range(longest)]
    # F.translate drops characters without a counterpart: those go last.
    kept, gone = [c for c, v in one.items() if v], [c for c, v in one.items() if not v]
    return "".join(many), parts, "".join(kept + gone) + "\n" + "".join(one[c] for c in kept)


#: Parts of the longest decompositions that a text is searched for at once; longer ones are few and looked up one by one.
_COMMON = 4


def decomposed(c: Column) -> Column:
    """The compatibility decomposition of a text, without marks: by tables of the Unicode data that Python has, in the JVM.

    ASCII texts are left alone. Characters with several parts are replaced one by one, by a table for each part.
    """
    many, parts, single = _decompositions()
    wide = set(c for i, c in enumerate(many) if parts[_COMMON][i] != _NOTHING)
    place = {c: i for i, c in enumerate(many)}
    few = "".join(c for c in many if c not in wide)
    tables = ["".join(part[place[c]] for c in few) for part in parts[:_COMMON]]

    def one(x: Column) -> Column:
        return F.replace(F.concat(*[F.translate(x, few, table) for table in tables]), F.lit(_NOTHING), F.lit(""))

    out = c
    for w in sorted(wide):
        out = F.replace(out, F.lit(w), F.lit("".join(part[place[w]] for part in parts).rstrip(_NOTHING)))
    has = "[" + "".join(f"\\x{{{ord(a):x}}}-\\x{{{ord(b):x}}}" for a, b in _ranges(few)) + "]"
    each = F.transform(F.split(out, ""), lambda x: F.when(x.rlike(has), one(x)).otherwise(x))
    whole = F.when(out.rlike(has), F.array_join(each, "")).otherwise(out)
    a, b = single.split("\n")
    return F.when(c.rlike(r"[^\x00-\x7f]"), F.regexp_replace(F.translate(whole, a, b), r"\p{M}+", "")).otherwise(c)


def _ranges(characters: str) -> list[tuple[str, str]]:
    """The characters as ranges of consecutive ones."""
    out: list[list[str]] = []
    for c in sorted(characters):
        if out and ord(c) == ord(out[-1][1]) + 1:
            out[-1][1] = c
        else:
            out.append([c, c])
    return [(a, b) for a, b in out]


def comparable_title(c: Column, ascii_only: bool = False) -> Column:
    """Compatibility-decomposed, without marks, lower case, other than letters and digits as single spaces, trimmed.

    ``ascii_only`` leaves the decomposition out, for texts that are known to need none.
    """
    plain = c if ascii_only else decomposed(c)
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(plain), r"[^\p{L}\p{N}\s]", " "), r"\s+", " "))


def json_set(document: Column, path: list[str], value: Column) -> Column:
    """The JSON text of an object with the text ``value`` at ``path``, in keys' order; other members stay as they are.

    A missing last key is added, a missing or non-object parent leaves the document alone, and so does a document that
    is no object; a null document or value gives null.
    """
    def put(current: Column, keys: list[str]) -> Column:
        own = F.try_variant_get(current, "$", "map<string,variant>")
        if len(keys) == 1:
            inner = F.parse_json(F.to_json(F.struct(value.alias("v"))))
            new = F.variant_get(inner, "$.v", "variant")
        else:
            there = F.element_at(own, keys[0])
            new = put(there, keys[1:])
        kept = F.map_filter(own, lambda k, _: k != F.lit(keys[0]))
        added = F.map_concat(kept, F.create_map(F.lit(keys[0]), new))
        sound = own.isNotNull() if len(keys) == 1 else own.isNotNull() & F.map_contains_key(own, keys[0]) & new.isNotNull()
        ordered = F.map_from_entries(F.array_sort(F.map_entries(F.transform_values(F.when(sound, added), lambda _, v: F.to_json(v)))))
        text = F.concat(F.lit("{"), F.array_join(F.transform(F.map_entries(ordered), lambda e: F.concat(F.to_json(F.struct(e["key"].alias("k"))).substr(F.lit(6), F.length(F.to_json(F.struct(e["key"].alias("k")))) - 6), F.lit(":"), e["value"])), ","), F.lit("}"))
        return F.parse_json(text)

    parsed = F.try_parse_json(document)
    return F.when(value.isNull(), None).otherwise(F.coalesce(F.to_json(put(parsed, path)), document))


def tokens(title: Column) -> Column:
    return F.array_distinct(F.filter(F.split(title, " "), lambda t: t != ""))


def grams(title: Column, n: int = 3) -> Column:
    """Distinct character n-grams; a text of n characters or fewer is one gram."""
    many = F.transform(F.sequence(F.lit(1), F.greatest(F.char_length(title) - (n - 1), F.lit(1))), lambda i: F.substring(title, i, n))
    return F.array_distinct(many)


def token_jaccard(a: Column, b: Column) -> Column:
    x, y = tokens(a), tokens(b)
    both = F.size(F.array_union(x, y))
    return F.when(both > 0, F.size(F.array_intersect(x, y)) / both).otherwise(0.0)


def gram_dice(a: Column, b: Column) -> Column:
    x, y = grams(a), grams(b)
    return 2.0 * F.size(F.array_intersect(x, y)) / (F.size(x) + F.size(y))


def title_similarity(a: Column, b: Column) -> Column:
    """Of two comparable titles: 0 if one is blank, 1 if equal, else the greater of token Jaccard and gram Dice."""
    blank = F.coalesce(a, F.lit("")).isin("") | F.coalesce(b, F.lit("")).isin("")
    return F.when(blank, 0.0).when(a == b, 1.0).otherwise(F.greatest(token_jaccard(a, b), gram_dice(a, b)))


def slugify(c: Column) -> Column:
    s = F.regexp_replace(F.trim(F.lower(c)), r"[^A-Za-z0-9_ \t\n\r-]", "")
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(s, r"[ \t\n\r_]+", "-"), "-+", "-"), "^-|-$", "")


#: Words that announce an episode number.
NUMBERED = r"(?i)\b(?:episode|ep|session|act|case|chapter)\s*#?\s*(\d{1,4})\b"


def explicit_number(title: Column) -> Column:
    """The number that a title names (``Session #3``), else one after ``#``; null if none or 0."""
    first = F.nullif(F.regexp_extract(title, NUMBERED, 1), F.lit(""))
    n = F.coalesce(first, F.nullif(F.regexp_extract(title, r"#\s*(\d{1,4})\b", 1), F.lit(""))).cast("int")
    return F.when(n > 0, n)


def composite_id(c: Column) -> tuple[Column, Column]:
    """``a:b`` as two positive integers; anything else gives nulls."""
    pattern = r"^([1-9][0-9]*):([1-9][0-9]*)$"
    return tuple(F.nullif(F.regexp_extract(c, pattern, i), F.lit("")).cast("long") for i in (1, 2))


def partial_date(year: Column, month: Column, day: Column) -> Column:
    """ISO text; a missing month or day is 01, a missing year gives null."""
    two = [F.lpad(F.coalesce(x, F.lit(1)).cast("string"), 2, "0") for x in (month, day)]
    return F.when(year.isNotNull(), F.concat_ws("-", F.lpad(year.cast("string"), 4, "0"), *two))


def strict_date(c: Column) -> Column:
    """A real calendar date written YYYY-MM-DD, else null."""
    return F.when(F.trim(c).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.trim(c).try_cast("date"))


def year_of(c: Column) -> Column:
    year = F.substring(c, 1, 4).try_cast("int")
    return F.when(year >= 1900, year)


def days_apart(a: Column, b: Column) -> Column:
    return F.abs(F.datediff(a, b))


def url_parts(url: Column) -> tuple[Column, Column]:
    """(host in lower case, path) of an http(s) address; nulls for others."""
    pattern = r"^(?i:https?)://([^/?#]+)([^?#]*)"
    host = F.nullif(F.lower(F.regexp_extract(url, pattern, 1)), F.lit(""))
    return host, F.when(host.isNotNull(), F.regexp_extract(url, pattern, 2))


def range_label(first: Column, last: Column) -> Column:
    return F.when(first == last, first.cast("string")).otherwise(F.concat_ws("-", first.cast("string"), last.cast("string")))


def json_strings(c: Column) -> Column:
    """The strings of a JSON array; other elements are dropped and bad input is an empty array."""
    parts = F.try_variant_get(F.try_parse_json(c), "$", "array<variant>")
    kept = F.filter(parts, lambda v: F.schema_of_variant(v) == "STRING")
    return F.coalesce(F.transform(kept, lambda v: F.try_variant_get(v, "$", "string")), F.array().cast("array<string>"))


def language_code(c: Column) -> Column:
    """Trimmed and lower-cased; null for a blank one, which the caller rejects."""
    return F.nullif(F.lower(F.trim(c)), F.lit(""))


def composite_prefix(c: Column) -> tuple[Column, Column]:
    """The first two parts of ``a:b:...`` as positive integers; further parts are ignored, and both are null if either is wrong."""
    a, b = (positive_id(F.try_element_at(F.split(c, ":"), F.lit(i))) for i in (1, 2))
    both = a.isNotNull() & b.isNotNull()
    return F.when(both, a), F.when(both, b)


def path_segments(path: Column) -> Column:
    """The path's non-empty segments with %xx decoded; a plus sign is one, and a segment that can't be decoded stays as it is."""
    return F.transform(F.filter(F.split(path, "/"), lambda x: x != ""), lambda x: F.coalesce(decoded(x), x))


def decoded(c: Column) -> Column:
    """%xx decoded, null if that can't be; in a path a plus sign is no space."""
    return F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))


def encoded(c: Column) -> Column:
    """The text as a part of a path: all but letters, digits and ``-_.!~*'()`` as %xx."""
    out = F.url_encode(c)
    for code, plain in (("+", "%20"), ("%21", "!"), ("%27", "'"), ("%28", "("), ("%29", ")"), ("%7E", "~")):
        out = F.replace(out, F.lit(code), F.lit(plain))
    return out


def earliest_date(texts: Column) -> Column:
    """Of an array of texts the one with the earliest real date, trimmed; null without any."""
    dated = F.filter(F.transform(texts, lambda t: F.struct(strict_date(t).alias("d"), F.trim(t).alias("t"))), lambda x: x["d"].isNotNull())
    return F.array_min(dated)["t"]


def anime_id(url: Column) -> Column:
    return F.regexp_extract(url, r"/anime/(\d+)", 1).try_cast("long")


#: The timestamp that stands for none; statuses of one provider; words of errors that pass.
UNSET = "0001-01-01T00:00:00Z"
STATUSES = {"CURRENT": "RELEASING", "FINISHED": "FINISHED", "UPCOMING": "NOT_YET_RELEASED", "UNRELEASED": "NOT_YET_RELEASED", "TBA": "NOT_YET_RELEASED"}
TRANSIENT = r"(?i)\b(?:status\s*)?5\d{2}\b|timeout|timed out|connection reset|network error|fetch failed"


def set_time(c: Column) -> Column:
    return F.nullif(c, F.lit(UNSET))


def recoded(c: Column, values: dict[str, str]) -> Column:
    """The value's counterpart; null for an unknown one."""
    return F.coalesce(*[F.when(c == a, b) for a, b in values.items()])


def error_class(message: Column) -> Column:
    """rate-limit, transient or other, by the words of a message."""
    low = F.lower(message)
    limited = message.contains("429") | low.contains("rate limit") | low.contains("too many requests")
    return F.when(limited, "rate-limit").when(message.rlike(TRANSIENT), "transient").otherwise("other")


def derived_languages(country: Column) -> Column:
    """(code, media) that a title's country of origin implies: Japanese audio for JP, nothing for others."""
    pair = F.array(F.struct(F.lit("ja").alias("code"), F.lit("audio").alias("media")))
    return F.when(F.upper(F.trim(country)).eqNullSafe("JP"), pair).otherwise(F.slice(pair, 1, 0))


def base_title(title: Column) -> Column:
    """The title without a season, part or number behind it; null if nothing changes or fewer than three characters are left."""
    out = title
    for suffix in SEASON_SUFFIXES:
        out = F.regexp_replace(out, suffix, "")
    out = F.trim(out)
    return F.when((out != title) & (F.char_length(out) >= 3), out)


#: Endings that name a season or part, in the order in which they are taken off.
SEASON_SUFFIXES = (
    r"(?i)\s+(?:season|part|series|cour)\s*\d+\s*$", r"(?i)\s+\d+(?:st|nd|rd|th)\s+(?:season|series|cour)\s*$",
    r"(?i)\s+(?:second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth)\s+(?:season|series|cour)\s*$", r"(?i)\s+(?:II|III|IV|VI{0,3}|IX)\s*$", r"\s+\d+\s*$",
)
