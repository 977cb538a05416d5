"""Main text of web pages by the ratios of tag paths.

A page is read into blocks: runs of text between block tags, each with its tag path from the root to the
leaf (inline tags are transparent). For every path, text length, punctuation and link text are summed over
its blocks; text outside links and punctuation per block, smoothed over the neighbouring blocks of the page,
are fused to one score. A container (the path without its leaf) is content if the mean score of its blocks
reaches a share of the best container's, which is the one with the largest sum; so is all that is nested in
it. Containers that are mostly links are not chosen. Where the best container lies in an article or main
tag, that tag's bounds are the content's. Paths through boilerplate tags, classes or roles never are content.

Elements and paths are numbers that point to their parents, so that time and memory grow with the length of
a page, however deep its tags are nested.
"""

from __future__ import annotations

import html as references
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from granary.llm._common import table

_MARKUP = re.compile(r"""<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<[!?/][^>]*+(?:>|\Z)""", re.S)
#: The same where quotes do not pair up any more: a tag ends at the next ">".
_LOOSE = re.compile(r"""<!--(?:.*?-->|.*)|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+(?:>|\Z)""", re.S)
_START = re.compile(r"<[a-zA-Z!?/]")
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_CHARS = re.compile(r"[.,;:!?…。、]")

# How HTML tags behave, and words that mark what is not the article.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var br wbr img math mi mn mo ms mtext mrow mfrac msqrt mroot mstyle merror mpadded msub msup msubsup munder mover munderover mmultiscripts mtable mtr mtd semantics".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style noscript template iframe object svg annotation annotation-xml canvas textarea select title head video audio".split())
BOILERPLATE_TAGS = set("nav header footer aside form menu button dialog fieldset".split())
BOILERPLATE_WORDS = set("ad ads advert adverts advertisement banner breadcrumb breadcrumbs comment comments cookie cookies consent footer header menu nav navbar navigation newsletter notice popup promo related share sharing sidebar social sponsor sponsored subscribe widget complementary contentinfo search".split())
MAIN, ROOT = {"article", "main"}, {"html", "body"}
#: Starting one of these ends an open paragraph; starting a key ends an open element of its set.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

#: Share of the best container's mean score that content has, and the largest share of link text of a container.
SHARE, MAX_LINKS = 0.25, 0.6
_RAW_END = {tag: re.compile(rf"</{tag}\s*>" if tag != "head" else r"</head\s*>|(?=<body[\s>])", re.I) for tag in RAW}
_WORDS = re.compile(r"[-_]+")


@dataclass
class Tree:
    """Elements by number, each with its parent's; element 0 is the page.

    mark is "!" for boilerplate and "?" for boilerplate by class, id or role. name is "tag" or "tag.class".
    blocks are (element, text, characters in links) in page order.
    """

    parent: list[int] = field(default_factory=lambda: [0])
    tag: list[str] = field(default_factory=lambda: [""])
    name: list[str] = field(default_factory=lambda: [""])
    mark: list[str] = field(default_factory=lambda: [""])
    blocks: list[tuple[int, str, int]] = field(default_factory=list)


def _describe(tag: str, attributes: str) -> tuple[str, str]:
    """(name, mark) of an element."""
    off, named, kind = tag in BOILERPLATE_TAGS, False, ""
    for name, *values in _ATTRIBUTE.findall(attributes) if attributes else ():
        name, value = name.lower(), (values[0] or values[1] or values[2]).lower()
        off |= name == "hidden" or name == "aria-hidden" and value == "true"
        off |= name == "style" and "display:none" in value.replace(" ", "")
        kind = " ".join(value.split()) if name == "class" else kind
        named |= name in ("class", "id", "role") and any(BOILERPLATE_WORDS.issuperset(_WORDS.split(x)) for x in value.split())
    return f"{tag}.{kind}" if kind else tag, "!" if off else "?" if named and tag not in MAIN and tag not in ROOT else ""


def read(page: str) -> Tree:
    """Elements and blocks of a page. Unclosed comments, tags and raw elements take the rest of it, as browsers have it."""
    t = Tree()
    stack, open_tags = [0], Counter()
    text: list[str] = []
    links = in_link = 0
    at, size, markup, headed = 0, len(page), _MARKUP, False

    def opened(tag: str, name: str, mark: str) -> None:
        t.parent.append(stack[-1])
        t.tag.append(tag)
        t.name.append(name)
        t.mark.append(mark)
        stack.append(len(t.parent) - 1)
        open_tags[tag] += 1

    def closed() -> None:
        open_tags[t.tag[stack.pop()]] -= 1

    def flush() -> None:
        nonlocal links
        if joined := " ".join("".join(text).split()):
            t.blocks.append((stack[-1], joined, min(links, len(joined))))
        text.clear()
        links = 0

    def said(piece: str) -> None:
        nonlocal links
        piece = references.unescape(piece) if "&" in piece else piece
        text.append(piece)
        if in_link:
            links += len(piece)

    while at < size:
        start = _START.search(page, at)
        if not start:
            said(page[at:])
            break
        m = markup.match(page, start.start())
        if not m and markup is _MARKUP:
            # a quote is never closed: from here on quotes count for nothing, so that this is tried once a page
            markup = _LOOSE
            m = markup.match(page, start.start())
        if start.start() > at:
            said(page[at : start.start()])
        if not m:
            break
        at = m.end()
        if not m[2]:
            continue
        tag, closing, attributes = m[2].lower(), bool(m[1]), m[3]
        if tag in RAW:
            if not closing and not attributes.endswith("/") and not (tag == "head" and headed):
                end = _RAW_END[tag].search(page, at)
                headed |= tag == "head"
                at = end.end() if end else at if tag == "head" else size
                text.append(" ")
        elif tag in INLINE:
            if tag == "a":
                in_link = 0 if closing else 1
            elif tag in ("br", "wbr"):
                text.append(" " if tag == "br" else "")
            elif closing:
                if t.mark[stack[-1]] and t.tag[stack[-1]] == tag:
                    flush()
                    closed()
            elif attributes and (found := _describe(tag, attributes))[1]:
                flush()
                opened(tag, *found)
        else:
            in_link = 0
            flush()
            if closing:
                if open_tags[tag]:
                    while t.tag[stack[-1]] != tag:
                        closed()
                    closed()
            elif tag not in VOID:
                if t.tag[stack[-1]] == "p" or t.tag[stack[-1]] in CLOSED_BY.get(tag, ()):
                    closed()
                if not attributes.endswith("/"):
                    opened(tag, *_describe(tag, attributes))
    flush()
    return t


def boilerplate(t: Tree) -> list[bool]:
    """For each element whether it is, or lies in, boilerplate. What lies around a main tag, or around all article tags, is none by its class, id or role."""
    n = len(t.parent)
    mains = [0] * n  # article and main tags below an element, and whether a main tag is
    around = [False] * n
    for e in range(n - 1, 0, -1):
        p = t.parent[e]
        mains[p] += mains[e] + (t.tag[e] in MAIN)
        around[p] |= around[e] or t.tag[e] == "main"
    off = [False] * n
    for e in range(1, n):
        cleared = around[e] or mains[0] and mains[e] == mains[0]
        off[e] = off[t.parent[e]] or t.mark[e] == "!" or t.mark[e] == "?" and not cleared
    return off


def main_text(page: str | None) -> str:
    """Blocks of the main content in page order, joined by an empty line; null and empty pages have none."""
    t = read(page or "")
    off = boilerplate(t)
    found = [b for b in t.blocks if not off[b[0]]]
    if not found:
        return ""
    # paths by number, parents first: elements with equal steps from the root share one
    numbers: dict[tuple[int, str], int] = {}
    path_of, up, last = [0], [0], [""]
    for e in range(1, len(t.parent)):
        key = (path_of[t.parent[e]], t.name[e])
        p = numbers.setdefault(key, len(up))
        if p == len(up):
            up.append(key[0])
            last.append(t.tag[e])
        path_of.append(p)
    container = [up[p] or p for p in range(len(up))]
    paths = [path_of[e] for e, _, _ in found]
    n = len(up)
    chars, marks, links, nodes = ([0] * n for _ in range(4))
    own_chars, own_links, size = ([0] * n for _ in range(3))  # the same by container
    for p, (_, text, linked) in zip(paths, found, strict=True):
        chars[p] += len(text)
        links[p] += linked
        nodes[p] += 1
        marks[p] += len(_CHARS.findall(text))
        c = container[p]
        own_chars[c] += len(text)
        own_links[c] += linked
        size[c] += 1
    ratio = [math.sqrt((chars[p] - links[p]) / nodes[p] * (1 + marks[p] / nodes[p])) for p in paths]
    smooth = [(ratio[max(k - 1, 0)] + 2 * ratio[k] + ratio[min(k + 1, len(ratio) - 1)]) / 4 for k in range(len(ratio))]
    score, own = [0.0] * n, [0.0] * n
    for p, s, r in zip(paths, smooth, ratio, strict=True):
        score[container[p]] += s
        own[container[p]] += r
    linked_off = [size[c] > 0 and own_links[c] > MAX_LINKS * own_chars[c] for c in range(n)]
    seen = list(dict.fromkeys(container[p] for p in paths))
    free = [c for c in seen if not linked_off[c]]
    if not free:
        return ""
    best = max(free, key=lambda c: score[c])
    mean = score[best] / size[best]
    around = {best}  # the containers around the best one, itself included
    p = best
    while p:
        p = up[p]
        around.add(p)
    # the outermost article or main tag of each path, 0 without one
    marked = [0] * n
    for p in range(1, n):
        marked[p] = marked[up[p]] or (p if last[p] in MAIN else 0)
    # around the best container the smoothed mean counts, as for titles; elsewhere a neighbour alone must not lift a container
    chosen = {c for c in free if score[c] / size[c] >= SHARE * mean and (c in around or own[c] / size[c] >= SHARE * mean)}
    if marked[best]:  # the page says where its article is, and the scores agree: what is outside is not part of it
        chosen = {c for c in chosen if marked[c]}
    whole = (chosen - around) | {marked[best] or best}
    # nested[p]: p lies in what counts as a whole; 2 if that is more than the page's own elements
    nested = [1 if 0 in whole else 0]
    for p in range(1, n):
        nested.append(2 if p in whole and last[p] not in ROOT else max(nested[up[p]], int(p in whole)))
    # a page's own text says little of the lists of links that the page holds
    content = [container[p] in chosen or p == marked[best] != 0 or nested[p] == 2 or nested[p] == 1 and not linked_off[container[p]] for p in range(n)]
    return "\n\n".join(text for p, (_, text, _) in zip(paths, found, strict=True) if content[p])


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars): one row per row of pages; repeated rows give repeated rows.

    Null and empty pages, and pages without text, have an empty text; null ids and urls stay null. Other
    columns of pages are not looked at, whatever their names. No rows give no rows. A page is handled alone, in
    time and memory in proportion to its length.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(h.as_py()) for h in b.column(2)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    source = pages.select(F.col(f"`{id_col}`").alias("page_id"), F.col(f"`{url_col}`").alias("url"), F.col(f"`{html_col}`").alias("html"))
    return source.mapInArrow(run, T.StructType([*source.schema.fields[:2], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of each page of `pages`, by the scores of its tag paths."""
    return extract(table(spark, sf_dir, "pages"))
