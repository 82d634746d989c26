"""Main text of web pages from flat text blocks and a small decision tree.

A page becomes a flat list of text blocks in page order. A block is described
by its word count and link density, those of the blocks before and after it,
its length against the page's longest block, what element it is, and where it
lies: between long paragraphs, in which article and how much of the articles'
text that one holds, inside page furniture by tag or by name, and how much of
the page that furniture holds. A decision tree, grown from the labelled pages
below, says which blocks are article text. Names of classes are features among
others: a page wrapped in one form or one "widget" is read as any other, and
furniture without a name is found by its neighbours.

Null and empty html is an empty page; a page without article text gives "".
Broken markup is read as browsers read it: unclosed elements stay open, a tag
cut off by the end of the page is dropped; a link never closed ends with its
block. Very long pages are read whole, in one pass. Repeated rows and equal
pages give equal results, each its own row; an empty table gives an empty
result. The kept columns may have any names; of columns called text or n_chars
among them, the result has both.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldlens.llm import textkit as tk

_TAG = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>[^>"']+|"[^"]*"|'[^']*')*)(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z_:][-\w:.]*)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
#: Elements of HTML by what they do to text.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead title tr ul".split())
SKIPPED = frozenset("script style title noscript template textarea select iframe object svg math canvas audio video map button datalist noembed noframes xmp".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = frozenset("nav footer aside menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar".split())
#: Words that name page furniture in classes and ids, and words that may stand beside them without changing that.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertisements advertising adsense adslot sponsor sponsors sponsored sponsorship promo promos promoted promotion promotions banner banners "
    "sidebar sidebars aside side rail comment comments commentlist disqus reply replies respond cookie cookies consent gdpr notice notices notification notifications alert alerts popup popups "
    "modal overlay dialog newsletter newsletters subscribe subscription signup login share sharing social related recommend recommended recommendations trending breadcrumb breadcrumbs menu menus "
    "nav navbar navigation topbar toolbar footer footers foot masthead widget widgets pagination pager copyright disclaimer search skip toc".split()
)
BESIDE = frozenset(
    "site page main top bottom left right upper lower list lists item items box block blocks wrapper wrap container inner outer area section bar button buttons link links group panel row post posts "
    "article articles entry blog story stories primary secondary global header headline body text form field js module mod unit slot zone label title heading thread count author meta date avatar "
    "message sticky fixed mini small large desktop mobile reader readers user users visitor visitors icon icons tag tags by the for more".split()
)
#: Words that may name lists beside the article or answers to it, but also parts of it, and words that name its notes.
HINTS = frozenset("responses response feedback discussion talk opinions latest recent popular news headlines more read also teaser teasers next trending offers deals partner partners community replies thoughts".split())
NOTES = frozenset("references footnotes endnotes bibliography citations sources works notes".split())
HEADERS = frozenset("header site page global top main wrapper container inner bar".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p blockquote pre figcaption".split())
ITEMS = frozenset("li td th dd dt caption".split())
_LINK = re.compile(r"<(/?)a(?=[\s/>])", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+(?:x\d+)?")


@dataclass
class Block:
    """One text block: its text, words, words inside links, the region it lies in, what element it is (3 a heading, 2 a paragraph, 1 an item or a cell), whether in an ordered list."""

    text: str
    words: int
    linked: int
    region: int
    kind: int
    ordered: bool


@dataclass
class Region:
    """An element that tells where text lies: "article", "main", "furniture", "form", or a name (2 furniture, 1 a hint, -1 notes); the region around it."""

    kind: str
    named: int
    parent: int


def names_furniture(name: str, in_article: bool) -> bool:
    """Whether a class or id as a whole names page furniture: "related-posts" does, "related-work" doesn't."""
    parts = {p.lower() for p in _PART.findall(name) if not p[0].isdigit()}
    if not in_article and "header" in parts and parts <= HEADERS:
        return True
    return bool(parts & NAMES) and parts <= NAMES | BESIDE


def _named(names: str, in_article: bool) -> int:
    """What classes and ids say: 2 furniture, 1 perhaps, -1 notes of an article, 0 nothing."""
    values = [0]
    for name in names.split():
        parts = {p.lower() for p in _PART.findall(name) if not p[0].isdigit()}
        if names_furniture(name, in_article):
            values.append(2)
        elif parts & HINTS and parts <= HINTS | BESIDE:
            values.append(1)
        elif parts & NOTES and parts <= NOTES | BESIDE:
            values.append(-1)
    return max(values) or min(values)


def _region(tag: str, attributes: str, in_article: bool) -> tuple[str, int]:
    """Kind and name of the region that an element opens; ("", 0) opens none."""
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
    role = found.get("role", "").lower()
    hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none", found.get("style", ""), re.I)
    named = _named(f"{found.get('class', '')} {found.get('id', '')}", in_article) if tag not in ("html", "body", "main") else 0
    if tag in FURNITURE or (tag == "header" and not in_article) or role in ROLES or hidden:
        return "furniture", named
    if tag == "form" or role == "form":
        return "form", named
    if tag == "article" or role == "article" or found.get("itemprop", "").lower() == "articlebody":
        return "article", named
    if tag == "main" or role == "main":
        return "main", named
    return "", named


def blocks(page: str) -> tuple[list[Block], list[Region]]:
    """The page's text blocks and regions in order; region 0 is the page. Text of inline furniture (a share link in a sentence) belongs to no block."""
    out: list[Block] = []
    regions = [Region("", 0, 0)]
    stack: list[tuple[str, int, bool, bool]] = []  # tag, region, in an ordered list, inline furniture
    inline = articles = 0
    linked_until, loose = 0, False
    kind, in_p = 0, 0
    parts: list[tuple[str, bool]] = []

    def flush() -> None:
        nonlocal parts
        if parts:
            text = " ".join("".join([p for p, _ in parts]).split())
            if text:
                linked = sum(len(p.split()) for p, inside in parts if inside)
                out.append(Block(text, text.count(" ") + 1, linked, in_p or (stack[-1][1] if stack else 0), kind, bool(stack) and stack[-1][2]))
            parts = []

    at, end = 0, len(page)
    while at < end:
        m = _TAG.search(page, at)
        text = page[at : m.start() if m else end]
        if text and not inline:
            parts.append((html.unescape(text), loose or at < linked_until))
        if not m:
            break
        at = m.end()
        tag = (m[2] or m[5] or "").lower()
        if not tag:
            continue
        closing, attributes = bool(m[1] or m[4]), m[3] or m[6] or ""
        if tag in SKIPPED:
            if not closing and not attributes.endswith("/"):
                close = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
                at = close.end() if close else end
            if tag in BLOCK:
                flush()
            continue
        if tag == "br":
            parts.append((" ", loose or at < linked_until))
            continue
        if tag == "a":
            following = None if closing else _LINK.search(page, at)
            linked_until = following.start() + 1 if following and following[1] else 0
            loose = not closing and not linked_until
        if tag in BLOCK:
            flush()
            in_p = inline = 0
            loose = False
            kind = 0 if closing else 3 if tag in HEADINGS else 2 if tag in PARAGRAPHS else 1 if tag in ITEMS else 0
        if tag in VOID:
            continue
        around = stack[-1] if stack else ("", 0, False, False)
        if tag == "p":
            found = ("", 0) if closing else _region(tag, attributes, articles > 0)
            if found != ("", 0):
                in_p = len(regions)
                regions.append(Region(*found, around[1]))
        elif closing:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    for j in range(i, len(stack)):
                        inline -= stack[j][3]
                        outer = stack[j - 1][1] if j else 0
                        articles -= stack[j][1] != outer and regions[stack[j][1]].kind in ("article", "main")
                    inline = max(inline, 0)
                    del stack[i:]
                    break
        elif tag in BLOCK:
            found, here = _region(tag, attributes, articles > 0), around[1]
            if found != ("", 0):
                here = len(regions)
                regions.append(Region(*found, around[1]))
                articles += found[0] in ("article", "main")
            stack.append((tag, here, tag == "ol" or (around[2] and tag != "ul"), False))
        elif tag in ("a", "span", "ins", "small", "strong", "em", "b", "i", "label"):
            found = _region(tag, attributes, articles > 0)
            hides = found[0] == "furniture" or found[1] == 2
            inline += hides
            stack.append((tag, around[1], around[2], hides))
    flush()
    return out, regions


FEATURES = (
    "words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "share_of_longest", "kind", "ordered",
    "long_before", "long_after", "paragraph_share", "furniture", "named", "region_share", "article", "page_article", "article_share",
)
NEIGHBOURS = ("words_before", "link_density_before", "words_after", "link_density_after")

#: The labelled table, made by hand: what may stand before, in and after the article of a page, and around all of it.
#: {9} are nine words, [9] nine words in a link; a plus marks words of the article. Every body is put together with
#: VARIANTS heads, tails and frames in turn, its longer runs of words made shorter or longer in turn.
HEADS = """
<nav><ul><li>[1]</li><li>[2]</li><li>[1]</li></ul></nav>
<header><h1>[2]</h1><p>{6}</p><nav>[1] [1] [2]</nav></header><div class="ad">{9}</div>
<div>[1] [1] [2] [1]</div><div>{14} [1]</div>
<ul><li>[1]</li><li>[1]</li><li>[2]</li><li>[1]</li><li>[3]</li></ul>
<div>{16}</div><div>[2]</div><ul><li>[1]</li><li>[1]</li></ul>
<div id="cookie-notice"><p>{24}</p></div><div class="menu">[1] [1] [1]</div>
<table><tr><td>[1]</td><td>[1]</td><td>[2]</td></tr></table>

<nav>[1] [1]</nav><div class="ad">{20}</div>
<div class="breadcrumbs">[1] [2] {3}</div>
<div>[2]</div><div>{3}</div><div>[1]</div><div>[1]</div><div>[1]</div>
<div><ul><li>[2]</li><li>[1]</li></ul></div><div>{11}</div>
<nav><ol><li>[1]</li><li>[1]</li></ol></nav><!-- ad --><div class="ad">{6}</div>
<p>[1] {1} [1] {1} [2]</p><p>{12} [2]</p>
""".strip("\n").split("\n")
BODIES = """
<article><h1>{8+}</h1><p>{45+}</p><p>{60+}</p><h2>{3+}</h2><p>{52+}</p><p>{70+}[4+]{9+}</p></article>
<article><h1>{9+}</h1><p>{19+}</p><p>{33+}</p><p>{5+}</p><p>{90+}</p><p>{28+}</p><p>{2+}</p></article>
<article><h1>{7+}</h1><div>{3+}</div><p>{45+}</p><ul><li>{7+}</li><li>{12+}</li><li>{2+}</li></ul><p>{30+}</p><table><tr><th>{1+}</th><th>{2+}</th></tr><tr><td>{1+}</td><td>{1+}</td></tr></table><blockquote>{22+}</blockquote><p>{40+}</p></article>
<article><h1>{5+}</h1><p>{40+}</p><div class="ad">{12}</div><p>{50+}</p><figure><figcaption>{9+}</figcaption></figure><aside><p>{30}</p></aside><p>{35+}</p><p class="promo">{18}</p><p>{20+}</p></article>
<article><h1>{6+}</h1><p>{48+}</p><p>{55+}</p><h2>{1+}</h2><ol><li>[9+]</li><li>[12+]</li><li>[8+]</li></ol></article>
<article><h1>{6+}</h1><p>{48+}</p><p>{35+}</p><h2>{1+}</h2><ul class="references"><li>[10+]</li><li>[7+]</li><li>[11+]</li></ul></article>
<article><h2>{1+}</h2><p>{44+}</p><h3>{2+}</h3><ol><li>[5+]</li><li>{3+}[6+]</li><li>[9+]</li><li>[4+]</li></ol></article>
<article><h1>{6+}</h1><p>{48+}</p><p>{55+}</p><ul><li>[1]</li><li>[2]</li><li>[1]</li></ul></article>
<article><h1>{6+}</h1><p>{38+}</p><p>{65+}</p><div><h3>{2}</h3><ul><li>[8]</li><li>[10]</li><li>[7]</li></ul></div></article>
<article><h1>{8+}</h1><p>{70+}</p><p>{45+}</p><p>{60+}</p></article><article><h2>[6]</h2><p>{18}</p></article><article><h2>[5]</h2><p>{22}</p></article>
<main><article><h1>{8+}</h1><p>{80+}</p><p>{55+}</p></article><article><h3>{5}</h3><p>{14}</p></article></main>
<main><h1>{5+}</h1><p>{60+}</p><p>{42+}</p><div class="latest-news"><h3>{2}</h3><div>{7}</div><div>{9}</div><div>{8}</div></div></main>
<main><h1>{7+}</h1><p>{50+}</p><p>{32+}</p><p>{64+}</p><div class="latest-news"><ul><li>[8]</li><li>[6]</li><li>[9]</li></ul></div></main>
<main><h1>{7+}</h1><p>{34+}</p><p>{58+}</p><div><a><div><h3>{6}</h3><p>{15}</p></div></a><a><div><h3>{7}</h3><p>{19}</p></div></a></div></main>
<main><article><header><h1>{3+}</h1></header><p>{8+}</p><p>{2+}</p><div class="ad-slot">{3}</div><p>{1+}</p><section class="comments"><article class="comment"><p>{14}</p></article></section></article></main>
<article><h1>{6+}</h1><p>{50+}</p><p>{44+}</p><section class="comments"><h3>{2}</h3><div class="comment"><b>{1}</b><p>{30}</p></div><div class="comment"><b>{2}</b><p>{41}</p></div></section></article>
<article><h1>{6+}</h1><p>{50+}</p><p>{64+}</p><section class="responses"><h3>{2}</h3><div>{2}</div><p>{20}</p><div>{1}</div><p>{31}</p><div>{2}</div><p>{12}</p></section></article>
<article><h1>{8+}</h1><p>{40+}</p><p>{52+}</p></article><section class="feedback"><h3>{1}</h3><p>{26}</p><p>{9}</p><p>{15}</p></section>
<article><h1>{8+}</h1><p>{33+}</p><p>{82+}</p></article><section class="discussion"><div><b>{2}</b><p>{18}</p></div><div><b>{1}</b><p>{24}</p></div></section>
<article><h1>{8+}</h1><section><h2>{2+}</h2><p>{52+}</p><p>{40+}</p></section><section class="discussion"><h2>{1+}</h2><p>{60+}</p><p>{72+}</p><p>{48+}</p></section></article>
<article class="related-work"><h2>{2+}</h2><p>{6+}</p><p class="ad">{2}</p><section id="search-methods"><p>{2+}</p></section><div class="no-js">{4+}</div><div>{3+}</div></article>
<article>{1+}<p>{1+}</p><p>{1+}</p><p>{1+}</p><p>{1+}</p><p>{1+}</p></article>
<article>{9+}</article>
<article><div>{40+}</div><div>{22+}</div><div>{61+}</div><div>{5+}</div></article>
<article><h1>{6+}</h1>{4+}<p>{55+}</p><pre>{12+}</pre><p>{44+}</p><div class="share-buttons">[1] [1] [1]</div><div class="related-posts"><ul><li>[7]</li><li>[8]</li></ul></div></article>
<article><h1>{8+}</h1><p>{30+}[12+]</p><p>[14+]{20+}</p><p>{4+}[3+]</p><p>{40+}</p></article>
<h1>{7+}</h1><p>{42+}</p><p>{28+}</p><p>{5+}</p><p>{60+}</p>
<div><h1>{6+}</h1><p>{40+}</p><ul><li>{9+}</li><li>{12+}</li><li>{5+}</li></ul><p>{30+}</p><table><tr><th>{2+}</th><th>{1+}</th></tr><tr><td>{3+}</td><td>{1+}</td></tr><tr><td>{2+}</td><td>{1+}</td></tr></table><p>{44+}</p></div>
<div><h2>{5+}</h2><p>{35+}</p><ol><li>{19+}</li><li>{4+}</li><li>{13+}</li></ol></div>
<div><h1>{6+}</h1><p>{22+}</p><table><tr><td>{3+}</td><td>{2+}</td></tr><tr><td>{1+}</td><td>{1+}</td></tr></table><ul><li>{6+}</li><li>{8+}</li></ul></div>
<div><h1>{8+}</h1><p>{52+}</p><p>{38+}</p></div><div><h3>{2}</h3><ul><li>[6]</li><li>[8]</li><li>[5]</li></ul></div><div>{10} [1]</div>
<div><h1>{8+}</h1><p>{30+}</p><p>{46+}</p></div><div><div>{2}</div><div>{14}</div><div>[1] [1]</div><div>{2}</div><div>{22}</div><div>[1] [1]</div></div>
<div id="content"><h1>{8+}</h1><p>{20+}</p><p>{18+}</p><p>{3+}</p></div><div id="footer">{1}</div>
<div class="content"><h1>{6+}</h1><p>{10+}</p><p>{55+}</p><p class="promo">{20}</p><p>{4+}</p><p>{14+}</p></div><section id="comments"><h3>{2}</h3><p>{38}</p></section>
<div class="content"><h1>{4+}</h1><p>{3+}</p><p>{12+}</p><aside>{20}</aside><p>{5+}</p><p>{66+}</p></div><form><label>{4}</label></form>
<div>{40+}</div><div>{60+}</div><div>{33+}</div><div>{52+}</div>
<div><b>{6+}</b></div><div>{70+}</div><div>{8+}</div><div>{45+}</div>
<p>{5+}</p><p>{7+}</p>
<p>{4+}</p><p>{9+}</p><p>{6+}</p>
<div class="content-sidebar widget"><h1>{7+}</h1><p>{50+}</p><p>{43+}</p><p>{30+}</p><p>{61+}</p></div>
<div class="widget"><article><h1>{7+}</h1><p>{50+}</p><p>{6+}</p><p>{30+}</p><p>{61+}</p></article></div>
<div><h1>{8+}</h1><p>{20+}[3+]{20+}</p><p>{30+}[2+]</p><h2>{3+}</h2><p>[2+]{40+}</p><p>{14+}[3+]</p><p>{55+}[3+]{10+}</p></div>
<div><h1>{6+}</h1><p>{12+}[2+]{9+}</p><p>{60+}</p><ul><li>{9+}[2+]</li><li>{14+}</li><li>{4+}</li></ul><blockquote><p>{18+}[1+]</p></blockquote><p>{33+}[6+]</p></div><div><h3>{2}</h3><ul><li>[7]</li><li>[5]</li><li>[9]</li></ul></div>
<h1>{9+}</h1><p>{24+}[5+]{7+}</p><p>{5+}</p><p>{40+}</p><p>{3+}</p><p>{26+}</p><div><p>[6]</p><p>{3}</p><p>[8]</p><p>{2}</p><p>[5]</p><p>{3}</p></div>
<div><p>[5]</p><p>{2}</p><p>[7]</p><p>{3}</p></div><div><h1>{6+}</h1><p>{35+}</p><p>{4+}</p><p>{48+}[2+]{5+}</p></div><div><p>[8]</p><p>{3}</p><p>[6]</p><p>{2}</p></div>
<div><h1>{7+}</h1><p>{45+}</p><p>{30+}[3+]</p><p>{52+}</p></div><div><h3>[6]</h3><p>{12}</p><h3>[7]</h3><p>{16}</p><h3>[5]</h3><p>{10}</p></div>
<article><h1>{7+}</h1><p>{45+}</p><p>{3+}</p><p>{30+}[3+]</p><p>{2+}</p><p>{52+}</p><p>[6]</p><p>{3}</p><p>[7]</p><p>{2}</p><p>[8]</p><p>{3}</p></article>
<article><h1>{7+}</h1><p>{25+}</p><h2>{2+}</h2><p>{50+}</p><h2>{2}</h2><ul><li>[8]</li><li>[6]</li><li>[7]</li></ul></article>
<article><h1>{5+}</h1><p>{38+}</p><h3>{3+}</h3><p>{44+}</p><ul><li>{4+}</li><li>{3+}</li><li>{11+}</li></ul><p>{20+}</p><h3>{2}</h3><ul><li>[6]</li><li>{3}</li><li>[9]</li><li>{2}</li><li>[7]</li></ul></article>
<article><h1>{9+}</h1><p>{12+}</p><p>{15+}</p></article><p>{9}</p><p>{26}</p><p>{31}</p>
<p>{16}</p><p>{29}</p><article><h1>{6+}</h1><p>{31+}</p><p>{10+}</p><p>{22+}</p></article><p>{36}</p>
""".strip("\n").split("\n")
TAILS = """
<footer>{8}</footer>
<footer><p>{14}</p><ul><li>[1]</li><li>[2]</li></ul></footer>
<div>{7}</div>
<div>{5}[2]</div><div>[1] [1] [1]</div>

<div>[2] [1] [2]</div><div>{9}</div>
<div class="related"><h3>{2}</h3><a><div><h4>{7}</h4></div></a><a><div><h4>{9}</h4></div></a></div><footer>{6}</footer>
<form><label>{6}</label><p>{9}</p></form><div>{6}</div>
<aside class="sidebar"><h3>{2}</h3><p>{20}</p></aside><footer>{10}</footer>
<div>{18} [1]</div><div>{6}</div>
<ul><li>[6]</li><li>[7]</li><li>[9]</li></ul><div>{7}</div>
""".strip("\n").split("\n")
FRAMES = """
<body>*</body>
<body><div class="page">*</div></body>
<body><form id="aspnetForm">*</form></body>
<body><div><div>*</div></div></body>
<body class="has-sidebar">*</body>
""".strip("\n").split("\n")
VARIANTS = 15


def labelled_pages() -> Iterator[str]:
    """The pages of the labelled table; words of the article are k."""
    for i, body in enumerate(BODIES):
        for j in range(VARIANTS):
            whole = FRAMES[(i + j) % len(FRAMES)].replace("*", HEADS[(i + j) % len(HEADS)] + body + TAILS[(3 * i + j) % len(TAILS)])
            scale = (1.0, 0.6, 1.6)[(i + j) % 3]
            said = lambda m: " ".join(["k" if m[2] else "w"] * (round(int(m[1]) * scale) if int(m[1]) > 4 else int(m[1])))  # noqa: B023, E731
            whole = re.sub(r"\{(\d+)(\+?)\}", said, whole)
            yield re.sub(r"\[(\d+)(\+?)\]", lambda m: f"<a>{said(m)}</a>", whole)  # noqa: B023


def labelled_rows() -> list[tuple]:
    """FEATURES and label of every block of the labelled pages."""
    rows = []
    for page in labelled_pages():
        found, regions = blocks(page)
        rows += [(*row, int(b.text[0] == "k")) for row, b in zip(page_features(found, regions), found, strict=True)]
    return rows


def page_features(page: list[Block], regions: list[Region]) -> list[tuple]:
    """FEATURES of each block of a page."""
    words = [b.words for b in page]
    density = [min(b.linked / b.words, 1.0) for b in page]
    plain = [max(b.words - b.linked, 0) for b in page]
    held = [0] * len(regions)
    for b, n in zip(page, plain, strict=True):
        held[b.region] += n
    for i in range(len(regions) - 1, 0, -1):
        held[regions[i].parent] += held[i]
    everything = max(held[0], 1)
    furniture, named, share, article = [0], [0], [1.0], [0]
    for i, r in enumerate(regions[1:], 1):
        outer = r.parent
        furniture.append(max(furniture[outer], 2 if r.kind == "furniture" else int(r.kind == "form")))
        named.append(r.named or named[outer])
        share.append(min(share[outer], held[i] / everything) if r.named > 0 or r.kind in ("furniture", "form") else share[outer])
        article.append(i if r.kind in ("article", "main") else article[outer])
    told = [0] * len(regions)
    for b, n in zip(page, plain, strict=True):
        if furniture[b.region] < 2 and not (named[b.region] > 0 and share[b.region] < 0.5):
            told[article[b.region]] += n
    most = max(told[1:], default=0)
    rank = [0 if not article[i] else 1 if regions[article[i]].kind == "main" else 2 for i in range(len(regions))]
    page_article = max((rank[b.region] for b in page if furniture[b.region] < 2), default=0)
    free = [furniture[b.region] < 2 and named[b.region] < 2 for b in page]
    longest = max((n for n, ok in zip(words, free, strict=True) if ok), default=1)
    paragraphs = sum(n for b, n, ok in zip(page, plain, free, strict=True) if ok and b.kind >= 2) / max(sum(n for n, ok in zip(plain, free, strict=True) if ok), 1)
    long = [i for i, b in enumerate(page) if free[i] and b.kind != 3 and 3 * plain[i] >= longest and density[i] < 0.5]
    first, last = (long[0], long[-1]) if long else (len(page), -1)
    around = lambda x, i: x[i] if 0 <= i < len(x) else 0
    return [
        (
            b.words, density[i], around(words, i - 1), around(density, i - 1), around(words, i + 1), around(density, i + 1), min(b.words / longest, 1.0), b.kind, b.ordered,
            first < i, i < last, paragraphs, furniture[b.region], named[b.region], share[b.region], rank[b.region], page_article, told[article[b.region]] / most if article[b.region] and most else 0.0,
        )
        for i, b in enumerate(page)
    ]


def grow(x: np.ndarray, y: np.ndarray, depth: int = 12, least: int = 4) -> tuple:
    """A binary tree by Gini impurity: (feature, threshold, below, from) or (label,). Each side of a split has ``least`` rows at least, so that no single block decides."""
    n, total = len(y), int(y.sum())
    leaf = (int(2 * total >= n and n > 0),)
    if depth == 0 or n < 2 * least or total in (0, n):
        return leaf
    order = np.argsort(x, axis=0, kind="stable")
    ordered, ones, k = np.take_along_axis(x, order, 0), np.cumsum(y[order], axis=0)[:-1], np.arange(1, n)[:, None]
    gain = ones**2 / k + (total - ones) ** 2 / (n - k) - total**2 / n
    gain[(ordered[1:] == ordered[:-1]) | (k < least) | (n - k < least)] = 0
    at, j = divmod(int(gain.argmax()), x.shape[1])
    if gain[at, j] <= 1e-9:
        return leaf
    bar = float(ordered[at, j] + ordered[at + 1, j]) / 2
    low = x[:, j] < bar
    return j, bar, grow(x[low], y[low], depth - 1, least), grow(x[~low], y[~low], depth - 1, least)


def train(without: tuple[str, ...] = ()) -> tuple:
    """The tree of the labelled table; features named in ``without`` are not looked at."""
    rows = np.array(labelled_rows(), float)
    for name in without:
        rows[:, FEATURES.index(name)] = 0
    return grow(rows[:, :-1], rows[:, -1].astype(int))


def decide(tree: tuple, row: tuple) -> int:
    while len(tree) > 1:
        tree = tree[2] if row[tree[0]] < tree[1] else tree[3]
    return tree[0]


def main_text(page: str, tree: tuple) -> str:
    """The page's article: its blocks, two line breaks apart."""
    found, regions = blocks(page)
    return "\n\n".join([b.text for b, row in zip(found, page_features(found, regions), strict=True) if decide(tree, row)])


def extract(pages: DataFrame, keep: list[str], html_col: str = "html", batch_bytes: int = 4 << 20) -> DataFrame:
    """Adds text and n_chars (code points) to the ``keep`` columns."""
    tree = train()
    names, kinds = tk.kept(pages, keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = tk.as_strings(batch.column(batch.num_columns - 1))
            out: list[str] = []
            held = done = 0
            for i in range(len(texts)):
                out.append(main_text(texts[i].as_py(), tree))
                held += len(out[-1])
                if held > batch_bytes or i == len(texts) - 1:
                    yield pa.RecordBatch.from_arrays([*(batch.column(j).slice(done, len(out)) for j in range(batch.num_columns - 1)), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64())], [*names, "text", "n_chars"])
                    out, held, done = [], 0, i + 1

    return pages.select(*keep, F.col(html_col).alias("__html")).mapInArrow(tk.tidy(run), f"{kinds}, text string, n_chars long").toDF(*keep, "text", "n_chars")
