import math
import random
import re
import time
from html.parser import HTMLParser

import pytest
from pyspark.sql import functions as F

from granary.llm.html import BOILERPLATE_TAGS, BOILERPLATE_WORDS, MAX_LINKS, SHARE, extract, main_text

PAGE = """<!DOCTYPE html><html><head><title>T &amp; x</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>Site</header><nav><ul><li><a href="/a">menu</a></li></ul></nav><!-- ad --><div class="ad">Buy this, now.</div>
<div id="cookie-notice">We use cookies.</div>
<article><h1>Head &amp; line</h1><p><b>First<br>para.<p>Se&#99;ond&nbsp;  one,
 with <a href="x">link</a>.</p>loose text<ul><li>item one</li><li>item two</ul>
<section class="comments"><p>Nice, very nice article!</p></section><form><p>Sign up</p></form></article>
<aside><p>Related things.</p></aside><footer>&copy; me</footer>"""


def test_article():
    assert main_text(PAGE) == "Head & line\n\nFirst para.\n\nSecond one, with link.\n\nloose text\n\nitem one\n\nitem two"


def test_without_article_tag():
    body = "".join(f"<p>Sentence number {k}, which has some words, and marks. It goes on, as sentences do.</p>" for k in range(6))
    page = f'<body><div class="top"><div>Home</div></div><div class="story"><h2>A title</h2>{body}<p>End.</p></div><div class="links"><ul><li><a href="a">one of the links</a></li><li><a href="b">another link there</a></li></ul></div><div class="legal">All rights.</div></body>'
    got = main_text(page).split("\n\n")
    assert got[0] == "A title" and got[-1] == "End." and len(got) == 8


@pytest.mark.parametrize("page, text", [(None, ""), ("", ""), ("plain words", "plain words"), ("<p>a<p>b", "a\n\nb"), ("<article><p>cut &am", "cut &am"), ("<article><p>x<script>never closed", "x"), ("<article>1 < 2 & 3</article>", "1 < 2 & 3"), ("<article><p>a</p><!-- open", "a"), ("<head>no end<p>text", "no end\n\ntext"), ("<article><p title='a>b'>q</p></article>", "q"), ('<article><p>y<span class="ad">buy</span> z</p></article>', "y\n\nz")])
def test_odd_pages(page, text):
    assert main_text(page) == text


def test_long_page_and_frames(spark):
    long_page = "<article>" + "<p>word, word.</p>" * 20000 + "</article>"
    rows = [(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "v", long_page)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    out = extract(df)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = {r["page_id"]: r for r in out.collect()}
    assert out.count() == 4 and got[None]["n_chars"] == 0 and got[2]["n_chars"] == len(got[2]["text"])
    assert got[2]["text"].count("\n\n") == 19999
    assert extract(df.limit(0)).count() == 0


LONG = "<p>" + "A sentence of the story, with a few words and marks. " * 6 + "</p>"


def test_story_in_div_beside_article_teasers():
    teasers = "".join(f"<article><h3><a href='/{k}'>Teaser {k}</a></h3><p>Read it.</p></article>" for k in range(5))
    got = main_text(f"<body><div class='story'>{LONG * 8}</div><div class='more'>{teasers}</div></body>")
    assert got.count("A sentence of the story") == 48 and "Teaser" not in got


@pytest.mark.parametrize("page", ["<html class='menu-closed'><body class='no-sidebar'><div id='page' class='sticky-header'><article class='post share'>{}</article></div>", "<div data-hidden='false'><div data-url='/hidden-gems'>{}</div></div>", "<div class='share'><main>{}</main></div>", "<div title='class=ad'>{}</div>", "<div class='ad'>no</div><div class='share'><article>{}</article></div>", "<div class='cookie-notice'>We use cookies.</div><div class='post-with-sidebar'>{}</div>"])
def test_layout_classes(page):
    assert main_text(page.format("<p>Some words, here.</p>")) == "Some words, here."


def test_links_and_math_of_an_article():
    page = f"<article><h1><a href='/'>Title</a></h1>{LONG}<p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> hold.</p><ul><li><a href='a'>Source one</a></li><li><a href='b'>Source two</a></li></ul></article>"
    got = main_text(page).split("\n\n")
    assert got[0] == "Title" and got[2:] == ["Let x=2 hold.", "Source one", "Source two"]


def test_nested_parts_of_a_long_story():
    items = "".join(f"<li>Item {k}, of a list that is part of the story.</li>" for k in range(10))
    page = f"<body><div class='top'><div>Home</div></div><div class='story'>{LONG * 40}<ul>{items}</ul><blockquote><p>A quote, short.</p></blockquote><table><tr><td>cell</td></tr></table></div><div class='legal'>All rights.</div></body>"
    got = main_text(page)
    assert got.count("Item ") == 10 and "A quote" in got and "cell" in got and "Home" not in got and "All rights" not in got


class _Slow(HTMLParser):
    """Blocks of a page whose block tags are all closed, with whole paths of (number, tag, class, kind of boilerplate)."""

    def __init__(self, page):
        super().__init__()
        self.path, self.n, self.found, self.mains, self.text, self.link, self.links = [], 0, [], [], "", 0, 0
        self.feed(page)
        self.flush()

    def flush(self):
        if self.text.split():
            self.found.append((tuple(self.path), " ".join(self.text.split()), min(self.links, len(" ".join(self.text.split())))))
        self.text, self.links = "", 0

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            self.link = 1
            return
        self.flush()
        a, self.n = dict(attrs), self.n + 1
        words = [w for k in ("class", "id") for w in (a.get(k) or "").split()]
        kind = "!" if tag in BOILERPLATE_TAGS else "?" if tag not in ("article", "main", "html", "body") and BOILERPLATE_WORDS & set(words) else ""
        if tag in ("article", "main"):
            self.mains.append((tag, {x[0] for x in self.path}))
        self.path.append((self.n, tag, a.get("class") or "", kind))

    def handle_endtag(self, tag):
        if tag == "a":
            self.link = 0
            return
        self.flush()
        self.path.pop()

    def handle_data(self, data):
        self.text += data
        self.links += len(data) * self.link


def slow_text(page):
    """The module's definition, word by word, over whole paths."""
    s = _Slow(page)
    outer = set.intersection(*(x for _, x in s.mains)) if s.mains else set()
    outer = outer.union(*(x for tag, x in s.mains if tag == "main"))
    rows = [(tuple(x[1:3] for x in path), text, links) for path, text, links in s.found if not any(x[3] == "!" or x[3] == "?" and x[0] not in outer for x in path)]
    box = lambda p: p[:-1] or p
    share = lambda rs: sum(r[2] for r in rs) <= MAX_LINKS * sum(len(r[1]) for r in rs)
    raw = []
    for p, _, _ in rows:
        same = [r for r in rows if r[0] == p]
        n, marks = len(same), sum(sum(r[1].count(c) for c in ".,;:!?") for r in same)
        raw.append(math.sqrt(sum(len(r[1]) - r[2] for r in same) / n * (1 + marks / n)))
    smooth = [(raw[max(k - 1, 0)] + 2 * x + raw[min(k + 1, len(raw) - 1)]) / 4 for k, x in enumerate(raw)]
    boxes = list(dict.fromkeys(box(p) for p, _, _ in rows))
    free = [c for c in boxes if share([r for r in rows if box(r[0]) == c])]
    if not free:
        return ""
    total = lambda c, xs: sum(x for r, x in zip(rows, xs, strict=True) if box(r[0]) == c)
    mean = lambda c, xs: total(c, xs) / sum(box(r[0]) == c for r in rows)
    best = max(free, key=lambda c: total(c, smooth))
    inside = lambda p: next((p[: k + 1] for k, x in enumerate(p) if x[0] in ("article", "main")), ())
    least = SHARE * mean(best, smooth)
    chosen = {c for c in free if mean(c, smooth) >= least and (c == best[: len(c)] or mean(c, raw) >= least) and (not inside(best) or inside(c))}
    whole = {c for c in chosen if c != best[: len(c)]} | {inside(best) or best}

    def content(p):
        around = [p[:k] for k in range(len(p) + 1) if p[:k] in whole]
        return box(p) in chosen or inside(best) != () and p == inside(best) or any(a and a[-1][0] not in ("html", "body") for a in around) or bool(around) and box(p) in free

    return "\n\n".join(text for p, text, _ in rows if content(p))


def random_page(rng):
    words = lambda n: " ".join(rng.choice(["rain", "river,", "stone.", "light", "over", "when;", "north"]) for _ in range(n))

    def part(depth):
        kind = rng.random()
        if depth > 3 or kind < 0.5:
            return f"<{(t := rng.choice(['p', 'p', 'h2', 'li']))}>{words(rng.choice([1, 4, 30, 60]))}</{t}>"
        if kind < 0.6:
            return "<ul>" + "".join(f"<li><a href='x'>{words(3)}</a></li>" for _ in range(rng.randint(1, 5))) + "</ul>"
        tag = rng.choice(["div", "div", "section", "article", "aside", "blockquote", "main"])
        of = rng.choice(["", "", " class='story'", " class='related'", " id='share'", " class='card share-x'"])
        return f"<{tag}{of}>" + "".join(part(depth + 1) for _ in range(rng.randint(1, 5))) + rng.choice(["", words(2)]) + f"</{tag}>"

    return "<html><body>" + "".join(part(0) for _ in range(rng.randint(1, 6))) + "</body></html>"


def test_against_brute_force():
    rng = random.Random(5)
    pages = [random_page(rng) for _ in range(600)]
    assert all(main_text(p) == slow_text(p) for p in pages)
    assert sum("<article" in p for p in pages) > 100 and sum("<article" not in p and "<main" not in p for p in pages) > 100
    assert sum(0 < len(main_text(p)) < len(re.sub("<.*?>", "", p)) * 0.8 for p in pages) > 200


@pytest.mark.parametrize("page", ["<div>x" * 50_000, "<div>x" * 50_000 + "</p>" * 50_000, "<a " * 100_000, "<a \"'>x" * 50_000, "<head>" * 50_000, "<p class='" * 50_000, "<li>" * 50_000 + "x"])
def test_time_grows_with_length_only(page):
    began = time.perf_counter()
    main_text(page)
    assert time.perf_counter() - began < 10


def test_wrappers_with_boilerplate_words_keep_the_story():
    for wrap in ("<body class='has-sidebar'>", "<body class='page no-header'><article>", "<article class='post has-comments'>", "<main id='search-results'>", "<div class='social-science'>", "<html class='ad-free'>", "<section id='notice-of-award'>"):
        assert main_text(f"{wrap}<p>A story, with words.</p>") == "A story, with words."
