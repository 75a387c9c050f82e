"""Main text of web pages by two-pass block rules.

A page is cut into blocks of text at block-level tags. Parts that the page itself declares as something else (menus,
footers, forms, elements named as adverts or comments) are set aside, unless such an element holds the headline and most
of the page's dense text: then its name says nothing. First pass over the rest: the share of link text, the length and
the share of stop words decide a block or leave it open. Second pass: an open block takes the label of the nearest decided
blocks before and after it. ``article`` and ``main`` are no decision, only where neighbours are looked for and what holds
without any; what lies outside of them stays if it is a story of its own.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame

from .common import slices, text_or_empty

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = frozenset(
    "a an and are as at be been but by can for from had has have he her his if in into is it its not of on or she so that the their there they this to was we were which will with would you "
    "aber als am auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich im ist mit nach nicht noch oder sein sich sie sind so und um unter vom von vor war wenn werden wie wird zu zum zur über "
    "au aux avec ce ces cette comme d dans de des du elle en est et il ils je l la le les leur lui mais ne nous on ou où par pas plus pour qu que qui sa se ses son sont sur un une vous "
    "al como con cuando del donde el ella entre era es esta este fue ha la las lo los más muy ni no o para pero por que se si sin sobre su sus también una uno y ya".split()
)
#: Elements whose text is never main text, and those whose content isn't markup.
OUTSIDE = frozenset("nav header footer aside form head title button select option textarea label dialog menu noscript template iframe object svg canvas".split())
RAW = frozenset("script style textarea title template noscript iframe svg xmp".split())
#: Elements that begin and end blocks.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html li main menu nav ol option p pre section select summary table tbody td template textarea tfoot th thead title tr ul".split())
#: Elements without an end tag.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class, id and role which mark parts that aren't the article. The first ones do wherever a name ends
#: with them or begins with them and tells a kind of box; the second ones mean many things and do as whole names, or
#: behind a word for the whole site only.
MARKS = frozenset(
    "ad ads adv advert advertisement advertising adsense breadcrumb breadcrumbs comment comments consent contentinfo cookie cookies copyright disqus footer gdpr masthead menu menubar modal nav navbar navigation newsletter pagination pager popup promo promotion recommended reply replies share sharing sidebar sidebars signup sponsor sponsored subscribe toolbar".split()
)
VAGUE = frozenset("banner dialog header notice notices notification related social widget".split())
BOXES = frozenset("area bar block body box bubble button buttons container content form group holder inner item items label links list nav panel row section slot text title unit widget wrap wrapper".split())
SITES = frozenset("ad cookie cookies footer global page privacy sidebar site top".split())
#: Of these, the words which mark reader comments; they count for an ``article`` element too, as whole class names.
COMMENTS = frozenset("comment comments disqus reply replies".split())
#: Beginnings of class names that say something about a layout ("with-sidebar"), and elements that hold it.
ABOUT = ("with", "has", "no", "without", "not", "is")
LAYOUT = frozenset("html body main article".split())
#: Elements that may stand in the head.
HEAD = frozenset("base basefont bgsound link meta title noscript noframes style script template".split())
#: Elements that a next one of the same group ends.
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
MAX_LINKS = 0.5
SHORT_CHARS = 80
LONG_CHARS = 200
STOP_LOW, STOP_HIGH = 0.08, 0.25

_ATTRIBUTES = r"""(?:[\s/]++(?:[^\s=>/"'][^\s=>/]*+(?:\s*+=\s*+(?:"[^"]*+"|'[^']*+'|[^\s>"'][^\s>]*+))?+)?+)*+"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)(?:({_ATTRIBUTES})\s*+>|([^>]*+)>)|<[!?][^>]*>", re.S)
_NAMED = re.compile(r"""(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_WORD = re.compile(r"[^\W\d_]+")

GOOD, BAD, OPEN = 1, 0, 2


def marked(name: str, attributes: str, inside: bool = False) -> bool:
    """Do the attributes name a part that isn't the article? An element that holds the layout is judged by whole names for
    comments only; inside an article a header is the article's own."""
    if not attributes:
        return False
    for value in _NAMED.findall(attributes):
        for token in value.strip("\"'").lower().split():
            if name in LAYOUT:
                if name == "article" and token in COMMENTS:
                    return True
            elif not (inside and token == "header") and names_a_part([w for w in re.split(r"[^a-z]+", token) if w]):
                return True
    return bool(_HIDDEN.search(attributes))


def names_a_part(words: list[str]) -> bool:
    """Does a name of these words stand for a part that isn't the article? ``post-share`` and ``comment-list`` do, ``ad-free``,
    ``entry-header`` and ``elementor-widget-container`` don't."""
    if not words or words[0] in ABOUT:
        return False
    if words[-1] in MARKS or (words[0] in MARKS and all(w in BOXES or w in MARKS or w in VAGUE for w in words[1:])):
        return True
    return words[-1] in VAGUE and (len(words) == 1 or words[0] in SITES or words[0] in MARKS) or (words[0] in VAGUE and len(words) > 1 and all(w in BOXES for w in words[1:]) and words[0] not in ("header", "widget"))


@dataclass
class Block:
    text: str
    aside: bool  # in a part that the page declares as something else
    home: int  # number of the article or main element that it stands in, 0 for none
    links: float  # share of link text
    tag: str = ""  # the block element that it stands in
    mark: int = 0  # number of the outermost element that its name sets aside, 0 for none or where an element's kind does
    top: bool = False  # set aside only by a header outside of articles
    label: int = OPEN
    by: str = ""  # what decided: aside, links, stop words, neighbours, home


#: Elements that hold a page's main part or its headline.
CORE = frozenset(("h1", "article", "main"))


def unmarked(found: list[Block], core: set[int]) -> None:
    """A mark on an element that holds the headline or the article and most of the page's dense text isn't believed, and a
    headline in the page's header stays open where no other one is."""
    dense = [len(b.text) if len(b.text) >= SHORT_CHARS and b.links <= MAX_LINKS and stop_share(b.text) >= STOP_LOW else 0 for b in found]
    for mark in core:
        if 2 * sum(n for n, b in zip(dense, found, strict=True) if b.mark == mark) > sum(dense):
            for b in found:
                if b.mark == mark:
                    b.aside = False
    tops = [b for b in found if b.top and b.tag == "h1"]
    if len(tops) == 1 and not any(b.tag == "h1" and not b.top or b.home and not b.aside for b in found):
        tops[0].aside = False


def blocks(page: str) -> list[Block]:
    """The page's blocks of text in order."""
    found: list[Block] = []
    stack: list[tuple[str, bool, int, int, bool]] = []  # element, aside, article, mark, header only
    core: set[int] = set()  # marks of elements that hold a headline or an article
    marks = 0
    depth: Counter[str] = Counter()  # open elements by name, so that a stray end tag needs no search
    pieces: list[tuple[str, bool]] = []
    links = homes = 0
    mute: list = []  # a marked inline element: its name, how many of that name are open, blocks around it

    def close() -> None:
        if pieces:
            text = " ".join(entities.unescape("".join(x for x, _ in pieces)).split())
            if text:
                linked, whole = sum(len(x.strip()) for x, link in pieces if link), sum(len(x.strip()) for x, _ in pieces)
                tag, aside, home, mark, top = stack[-1] if stack else ("", False, 0, 0, False)
                found.append(Block(text, aside, home, linked / max(1, whole), tag, mark, top))
            pieces.clear()

    def pop() -> str:
        name = stack.pop()[0]
        depth[name] -= 1
        if mute and len(stack) < mute[2]:
            mute.clear()
        return name

    def say(text: str) -> None:
        if not mute:
            pieces.append((text, links > 0))

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            rest = page[at:]
            cut = re.search(r"<[/!?a-zA-Z][^<]*\Z", rest)  # a tag that the page's end cuts off is no text
            say(rest[: cut.start()] if cut else rest)
            break
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        name, attributes = (m[2] or "").lower(), m[3] or m[4] or ""
        if not name:
            continue
        if m[1]:  # an end tag
            if name == "a":
                links = max(0, links - 1)
            if name in BLOCKS:
                close()
                if depth[name]:
                    while pop() != name:
                        pass
            elif mute and name == mute[0]:
                mute[1] -= 1
                if not mute[1]:
                    mute.clear()
            continue
        if name in RAW:
            if name in BLOCKS:
                close()
            stop = re.compile(rf"</{name}\b[^>]*>?", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if stack and stack[-1][0] == "head" and name not in HEAD:  # its end tag may be left out
            close()
            pop()
        if name in BLOCKS:
            close()
            links = 0
            if stack and (stack[-1][0] == "p" or stack[-1][0] in SIBLINGS.get(name, ())):
                pop()
            _, aside, home, mark, top = stack[-1] if stack else ("", False, 0, 0, False)
            named = marked(name, attributes, home > 0)
            if mark and name in CORE and not named:
                core.add(mark)
            if name in ("article", "main") and not named:
                homes += 1
                home = home or homes
            # a header inside the article holds its headline
            outside = bool(mute) or (name in OUTSIDE and not (name == "header" and home))
            if named and not aside and not outside and not _HIDDEN.search(attributes) and not COMMENTS.intersection(re.split(r"[^a-z]+", attributes.lower())):
                marks += 1
                mark = marks
            elif outside or named:
                mark = 0  # its kind sets it aside, or what can't be doubted
            top = not named and not mute and (top and name not in OUTSIDE or name == "header" and outside and not aside)
            aside = aside or outside or named
            stack.append((name, aside, home, mark, top))
            depth[name] += 1
        elif name == "br":
            say(" ")
        elif name not in VOID:
            if name == "a":
                links += 1
            if mute:
                mute[1] += name == mute[0]
            elif not attributes.endswith("/") and marked(name, attributes):
                mute[:] = [name, 1, len(stack)]
    close()
    unmarked(found, core)
    return found


def stop_share(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def first_pass(block: Block) -> tuple[int, str]:
    """Label and reason. In an article a lack of stop words leaves a block open, and so do links: bylines and lists of
    sources are its own; elsewhere both speak against it."""
    if block.aside:
        return BAD, "aside"
    if block.links > MAX_LINKS:
        return (OPEN, "") if block.home else (BAD, "links")
    n, stops = len(block.text), stop_share(block.text)
    if n >= LONG_CHARS and stops >= STOP_LOW or n >= SHORT_CHARS and stops >= STOP_HIGH:
        return GOOD, "stop words"
    if SHORT_CHARS <= n < LONG_CHARS and stops < STOP_LOW and not block.home:
        return BAD, "stop words"
    return OPEN, ""


def second_pass(found: list[Block]) -> None:
    """Open blocks take the label of the nearest decided neighbours in the same article, or outside all of them. Where the two differ, the nearer one
    counts, at equal distance the good one in an article and the bad one elsewhere; without any, an article's block is good.
    Parts set aside aren't neighbours."""
    by_home: dict[int, list[Block]] = {}
    for b in found:
        if not b.aside:
            by_home.setdefault(b.home, []).append(b)
    for home, own in by_home.items():
        labels, n = [b.label for b in own], len(own)
        before, after = [None] * n, [None] * n
        last = None
        for i in range(n):
            before[i] = last
            last = i if labels[i] != OPEN else last
        last = None
        for i in range(n - 1, -1, -1):
            after[i] = last
            last = i if labels[i] != OPEN else last
        for i, block in enumerate(own):
            if labels[i] == OPEN:
                near = sorted((abs(i - j), labels[j] != (GOOD if home else BAD), labels[j]) for j in (before[i], after[i]) if j is not None)
                block.label, block.by = (near[0][2], "neighbours") if near else (GOOD if home else BAD, "home")


def classify(page: str) -> list[Block]:
    """The page's blocks with their labels and what decided them."""
    found = blocks(page)
    for b in found:
        b.label, b.by = first_pass(b)
    rest = [b for b in found if not b.aside]
    if not any(b.home for b in rest) and all(b.label != GOOD for b in rest):
        for b in rest:  # no article, and no language that the stop words know: length alone
            if len(b.text) >= LONG_CHARS and b.label == OPEN:
                b.label, b.by = GOOD, "length"
    second_pass(found)
    if any(b.home and b.label == GOOD for b in found):
        # Where there is an article, text outside is something else, but for another story: a heading and dense blocks.
        for run in _outside(found):
            story = sum(b.by == "stop words" and b.label == GOOD for b in run) >= 2 and any(b.tag in HEADINGS for b in run)
            for b in run:
                if b.label == GOOD and not story:
                    b.label, b.by = BAD, "home"
    return found


HEADINGS = frozenset("h1 h2 h3".split())


def _outside(found: list[Block]) -> Iterator[list[Block]]:
    """Runs of blocks outside of articles that nothing set aside or in an article interrupts."""
    run: list[Block] = []
    for b in found:
        if b.home or b.aside:
            yield run
            run = []
        else:
            run.append(b)
    yield run


def main_text(page: str) -> str:
    return "\n".join(b.text for b in classify(page) if b.label == GOOD)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row. A null, empty or text-free page has an empty text.

    The whole page is read, however long; nothing is capped. Rows that repeat give repeated results, an empty table gives
    none. Only page_id, url and html are read, whatever else the table has.
    """
    kinds = dict(pages.dtypes)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in slices(frames, "html"):
            text = [main_text(text_or_empty(x)) for x in f["html"]]
            yield pd.DataFrame({"page_id": f["page_id"], "url": f["url"], "text": text, "n_chars": [len(x) for x in text]})

    return pages.select("page_id", "url", "html").mapInPandas(run, f"page_id {kinds['page_id']}, url string, text string, n_chars long")


def op8_html_extraction(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row; nulls, repeats and empty tables: as ``extract`` says."""
    return extract(pages)
