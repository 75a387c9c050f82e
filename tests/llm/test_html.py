"""Block rules on generated pages whose article is known, on hostile markup and on the test pages."""

import random
import time
from collections import Counter

import duckdb
import pytest

from tessera.llm import html

PROSE = "the {} of the {} is in a {} and it was not {} to the {} that they have {} with".split()


def sentence(rng, n):
    return " ".join(w if w != "{}" else "".join(rng.choices("aeionrst", k=rng.randint(3, 9))) for w in (PROSE * n)[: n * 6]).capitalize() + "."


def article(rng):
    texts = [sentence(rng, 1)[:30].strip()]
    for _ in range(rng.randint(1, 8)):
        texts.append(rng.choice([sentence(rng, 12), sentence(rng, 12), sentence(rng, 4), "Short one.", "Zxq wvu tsr " * 30, "Licensed under CC BY-NC 4.0."]).strip())
    return [" ".join(t.split()) for t in texts] + [sentence(rng, 9)]


JUNK = (
    "<nav><ul><li><a href=/>Home</a></li><li><a href=/b>Blog and more</a></li></ul></nav>", "<div class='ad'>{}</div>", "<aside>{}</aside>", "<div class=\"cookie-notice\">{}</div>",
    "<form><label>{}</label><input name=q></form>", "<section id=comments><p>{}</p><article class='comment'>{}</article></section>", "<div style='display: none'>{}</div>", "<footer>&copy; {}</footer>",
    "<script>var a = '<p>{}</p>';</script>", "<!-- {} -->", "<p class=advertisement>{}", "<div class='post-share'>{}</div>",
)


def page(rng, body, wrap):
    junk = lambda: rng.choice(JUNK).replace("{}", sentence(rng, rng.choice([1, 12])))
    inner = f"<h1>{body[0]}</h1>"
    for t in body[1:]:
        t = t.replace("the", "<b>the</b>", 1) if rng.random() < 0.3 else t.replace(" ", "\n  ", 2)
        inner += rng.choice([f"<p>{t}</p>", f"<p>{t}", f"<div>{t}</div>", f"<ul><li>{t}</ul>", f"<p>{t}<span class='ad'>buy {sentence(rng, 1)}</span></p>", f"<p title=it's>{t}</p>"])
        if rng.random() < 0.3:
            inner += junk()
    around = [junk() if rng.random() < 0.8 else "" for _ in range(4)]
    head = rng.choice(["<html><head><title>T</title><style>p{}</style></head>", "<html><head><title>T</title>", ""])
    return head + rng.choice(["<body>", "<body class='page with-sidebar'>", "<body class=has-comments>", "<body class='single no-ads'>"]) + around[0] + around[1] + wrap.replace("{}", inner) + around[2] + around[3]


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<main><div class=content>{}</div></main>", "<div class='layout has-sidebar'><article class='post with-ads'>{}</article></div>"])
def test_generated_pages(wrap):
    rng = random.Random(len(wrap))
    for _ in range(400):
        body = article(rng)
        source = page(rng, body, wrap)
        assert html.main_text(source) == "\n".join(body), source


def test_pages_without_article():
    rng = random.Random(3)
    for _ in range(200):
        body = [sentence(rng, 12) for _ in range(4)] + ["Short one.", sentence(rng, 10)]
        inner = "".join(f"<div><p>{t}</p></div>" for t in body)
        source = f"<body><div><a href=/>Some link text</a> <a href=/x>and more of it</a></div><div>Tag cloud: xq zt wv</div>{inner}<footer>{sentence(rng, 12)}</footer>"
        assert html.main_text(source) == "\n".join(body)
    foreign = "Zażółć gęślą jaźń " * 20
    assert html.main_text(f"<div><a href=x>Menu</a></div><p>{foreign}</p>") == foreign.strip()


def test_every_rule_decides():
    con = duckdb.connect()
    pages = [r[0] for r in con.execute("SELECT html FROM '/root/testdata/sf0.01/pages.parquet' WHERE html IS NOT NULL").fetchall()]
    by = Counter((b.by, b.label, b.home > 0) for p in pages for b in html.classify(p))
    assert by["stop words", html.GOOD, True] > 1000 and by["neighbours", html.GOOD, True] > 300 and by["aside", html.BAD, False] > 300
    for p in pages:  # all of the article's text and nothing else: what plain cutting at its tags gives
        inner = p[p.index("<article>") : p.index("</article>")]
        assert "".join(html.main_text(p).split()) == "".join(" ".join(b.text for b in html.blocks(inner)).split())


@pytest.mark.parametrize("source", ["<p title=it's>a b</p>", '<p title="a>b" x=\'>\'>a b</p>', "<p class=a\">a b</p>", "<p>a&#32;b</p>", "<p>a<br>b</p>", "a b", "<p>a b<", "<p>a b</p><div", "<p>a <span hidden>x<span>y</span>z</span>b", "<p>a <i class=ad>x</p><p></i></p>"])
def test_markup(source):
    text = html.main_text(f"<article>{source}")
    assert text in ("a b", "a b<", "a") and "title" not in text


def test_deep_and_stray_tags_take_linear_time():
    start = time.perf_counter()
    html.main_text("<div>" * 40_000 + "</p>" * 40_000 + "x")
    html.main_text("<p " + "a " * 200_000 + "<" * 1000)
    assert time.perf_counter() - start < 4


def test_hard_rows(spark):
    long = "<article>" + "<p>The word of the day is here and there.</p>" * 20_000
    rows = [(1, None, None, 1), (1, "u", "", 1), (2, "u", long, 1), (3, "u", "<p>", 1), (3, "u", "<p>", 1)]
    got = html.op8_html_extraction(spark.createDataFrame(rows, "page_id BIGINT, url STRING, html STRING, n_chars INT")).collect()
    assert sorted((r["page_id"], r["n_chars"]) for r in got) == [(1, 0), (1, 0), (2, 20_000 * 39 - 1), (3, 0), (3, 0)]
    assert html.op8_html_extraction(spark.createDataFrame([], "page_id BIGINT, url STRING, html STRING")).count() == 0


BODY = "".join(f"<p>{sentence(random.Random(i), 12)}</p>" for i in range(3))
TEXT = "\n".join(sentence(random.Random(i), 12) for i in range(3))


@pytest.mark.parametrize("name", ["elementor-widget-container", "elementor-widget elementor-widget-text-editor", "ad-free", "post-header-layout", "share-price-report", "entry-content has-sidebar", "social-science", "related-work", "noticeboard", "promotional", "adventure", "menuetto", "content widget-free"])
@pytest.mark.parametrize("wrap", ["<main><div class='{}'>", "<article><div class='{}'>", "<article><section id='{}'>"])
def test_names_that_only_contain_a_mark(name, wrap):
    assert html.main_text(f"<nav><a href=/>x</a></nav>{wrap.format(name)}<h1>Title of it</h1>{BODY}") == "Title of it\n" + TEXT


@pytest.mark.parametrize("name", ["ad", "post-share", "comment-list", "cookie-notice", "site-header", "sidebar-widget", "share-buttons", "newsletter-signup-box", "widget", "notice", "related", "ad-banner", "social", "promo-box", "breadcrumbs", "menu-item"])
def test_names_that_stand_for_another_part(name):
    assert html.main_text(f"<article><h1>Title of it</h1>{BODY}<div class='{name}'>{BODY}</div></article>") == "Title of it\n" + TEXT


def test_headlines_stay():
    for source in (f"<article><div class='entry-header'><h1>Title of it</h1></div>{BODY}", f"<header><h1>Title of it</h1></header>{BODY}", f"<article><header class='header'><h1>Title of it</h1></header>{BODY}", f"<div class='widget promo'><h1>Title of it</h1>{BODY}</div><footer>x</footer>"):
        assert html.main_text(source) == "Title of it\n" + TEXT, source
    assert html.main_text(f"<header><h1>Site name</h1></header><article><h1>Title of it</h1>{BODY}") == "Title of it\n" + TEXT
    assert html.main_text(f"<div class='comments'><h1>Comments</h1>{BODY}{BODY}</div><article>{BODY}") == TEXT


def test_links_of_the_article_stay():
    by, sources = "<p><a href=/a>By Jane Doe</a></p>", "<ul><li><a href=/1>A whole sentence that is a source of it</a></li><li><a href=/2>Another one of these</a></li></ul>"
    want = "Title of it\nBy Jane Doe\n" + TEXT + "\nA whole sentence that is a source of it\nAnother one of these"
    assert html.main_text(f"<nav><a href=/>Home</a></nav><article><h1>Title of it</h1>{by}{BODY}{sources}</article><div><a href=/>More</a></div>") == want


def test_another_story_behind_the_article_stays():
    story = f"<div><h2>Second story</h2>{BODY}</div>"
    assert html.main_text(f"<article><h1>One</h1>{BODY}</article>{story}<footer>f</footer>") == f"One\n{TEXT}\nSecond story\n{TEXT}"
    assert html.main_text(f"<article><h1>One</h1>{BODY}</article><div>{sentence(random.Random(9), 12)}</div>") == f"One\n{TEXT}"
