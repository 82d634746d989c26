import math
import random
import zlib

import numpy as np
import pytest

from fieldlens.llm import html_text, sharding, topk


def test_shards_are_even_and_slots_gapless(spark):
    rng = random.Random(1)
    rows = [(i, "x" * rng.choice([3, 30, 300, 3000]), "hot" if i % 3 else f"s{i % 7}", "en") for i in range(2000)]
    rows += [(None, None, None, None), (5, "dup", "a", "b"), (5, "dup", "a", "b")]
    got = sharding.kd_shards(spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")).collect()
    assert len(got) == len(rows) and {r["shard"] for r in got} == set(range(16))
    size, slots = [0] * 16, [[] for _ in range(16)]
    for r in got:
        size[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
    assert max(size) - min(size) <= 2 * 3001
    assert all(sorted(s) == list(range(len(s))) for s in slots)
    texts = sorted((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for _, t, _, _ in rows)
    assert sorted((r["size"], r["text_crc32"]) for r in got) == texts
    assert {r["law"] for r in got} == {"bytes"} and {r["grown_shard"] for r in got} == {None}


def test_ids_that_are_no_numbers(spark):
    """Text ids, empty ones and texts of numbers that aren't finite shard as any others."""
    ids = [f"doc-{i}" for i in range(300)] + ["17", " 18 ", "", "NaN", "Infinity", "1e400", "-3.5", None]
    got = sharding.kd_shards(spark.createDataFrame([(i, "some text", "s", "en") for i in ids], "doc_id string, text string, source string, lang string")).collect()
    assert sorted(map(str, ids)) == sorted(str(r["doc_id"]) for r in got)
    counts = [sum(r["shard"] == x for r in got) for x in range(16)]
    assert max(counts) - min(counts) <= 4


def test_equal_rows_and_few_rows_are_split(spark):
    schema = "doc_id long, text string, source string, lang string"
    same = sharding.kd_shards(spark.createDataFrame([(i, "same text", "s", "en") for i in range(160)], schema)).groupBy("shard").count().collect()
    assert len(same) == 16 and max(r["count"] for r in same) - min(r["count"] for r in same) <= 4
    assert sharding.kd_shards(spark.createDataFrame([(1, "a", "s", "en")], schema)).count() == 1
    assert sharding.kd_shards(spark.createDataFrame([], schema)).count() == 0


def brute_top(rows, k):
    whole = {i: [math.floor(1024 * x) for x in v] for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q in whole:
        if q % 10 == 0:
            scores = sorted((-sum(a * b for a, b in zip(whole[q], v, strict=False)), i) for i, v in whole.items() if i != q)
            out |= {(q, rank, i, -s) for rank, (s, i) in enumerate(scores[:k], 1)}
    return out


def test_top_k_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(120)]
    rows += [(i, rows[3][1]) for i in range(120, 160)]  # many ties
    rows += [(160, None), (161, [1.0, None, 0.0]), (162, [float("nan")] * 6), (163, [float("inf")] * 6), (164, []), (170, [2.5]), (None, [1.0] * 6)]
    from pyspark.sql import functions as F

    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    got = topk.top_k(table, F.col("vec_id") % 10 == 0, k=5, n_pivots=4, queries_per_block=4)
    assert {tuple(r) for r in got.collect()} == brute_top(rows, 5)
    assert topk.top_k(table.filter("false"), F.col("vec_id") % 10 == 0).count() == 0


def clustered(n):
    rng = np.random.default_rng(0)
    centres = rng.normal(0, 300, (8, 16))
    return np.floor(centres[rng.integers(0, 8, n)] + rng.normal(0, 5, (n, 16)))


def test_bounds_save_work_on_clustered_vectors():
    x = clustered(4000)
    pivots = topk.choose_pivots(x[:500], 32)
    q, ids = x[:20], np.arange(len(x))
    table, norm = topk.distances(x, pivots), np.sqrt((x**2).sum(1))
    got = topk.block_top((ids[:20], q, table[:20], norm[:20], np.full(20, -np.inf)), (ids, x, table, norm), 10, float(np.sqrt((pivots**2).sum(1)).max()))
    for a in range(20):
        s = (x @ q[a]).astype(np.int64)
        best = [i for i in np.lexsort((ids, -s)) if i != a][:10]
        assert got[1][got[0] == a].tolist() == best
    assert got[3] < 0.6 * 20 * len(x)


def test_queries_visit_few_cells_of_clustered_vectors(spark):
    x = clustered(3000)
    rows = spark.createDataFrame([(i, v.tolist(), i % 100 == 0) for i, v in enumerate(x)], "id long, v array<double>, asks boolean")
    placed, cells, _, _ = topk.place(rows, 1.0, 32, 24, 1024, 64, cell_rows=100)
    assert len(cells.cell) == 24 and cells.lanes.sum() > 40
    visited = 0
    for r in placed.filter("asks").collect():
        bar = np.sort(x @ x[r["id"]])[-11]
        most = cells.bounds(np.array(r["d"], np.float64), r["norm"])
        scores = x @ x[r["id"]]
        assert all(most[list(cells.cell).index(c["cell"])] >= scores[c["id"]] for c in placed.select("id", "cell").collect())
        visited += (most >= bar).sum()
    assert visited < 0.5 * 30 * 24


def test_top_k_in_many_cells_lanes_and_query_blocks(spark):
    from pyspark.sql import functions as F

    rng = random.Random(6)
    rows = [(i, [rng.gauss(0, 1) + 4 * (i % 3) for _ in range(5)]) for i in range(400)]
    rows += [(i, [1.5, 2.0, 0.0, 0.0, 1.0]) for i in range(400, 600)]  # a third of all are equal
    rows += [(i, [10.0**250, -(10.0**14), 1e7, 0.0, 0.5]) for i in range(600, 606)] + [(i, [3e5, -3e5, 3e6, 2e9, -1.0]) for i in range(606, 616)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    expected = {(a, b, c, max(-(2**63), min(2**63 - 1, d))) for a, b, c, d in brute_top(rows, 4) if a < 600}
    got = topk.top_k(table, F.col("vec_id") % 10 == 0, k=4, n_pivots=6, most_cells=12, queries_per_block=5, block_rows=32)
    assert {tuple(r) for r in got.collect() if r[0] < 600} == expected
    repeated = topk.top_k(spark.createDataFrame([(0, [1.0]), (0, [3.0]), (1, [2.0]), (1, [2.0])], "vec_id long, embedding array<double>"), F.col("vec_id") == 0, k=3)
    assert [tuple(r) for r in repeated.orderBy("rank").collect()] == [(0, 1, 1, 2097152), (0, 2, 1, 2097152)]


def test_top_k_of_long_vectors_that_point_apart(spark):
    """Scores below zero, where bounds are tightest."""
    from pyspark.sql import functions as F

    rng = random.Random(8)
    rows = [(i, [(-1) ** i * 100 * (1 + rng.random() / 50), rng.random()]) for i in range(60)]
    rows = [(i, v) for i, v in rows if i % 2 or i == 0 or i > 56]
    got = topk.top_k(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), F.col("vec_id") % 10 == 0, k=5, n_pivots=8)
    assert {tuple(r) for r in got.collect()} == brute_top(rows, 5)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body class="has-sidebar"><header class=top><h1>Site</h1></header>
<div id="cookie-notice">We use cookies.</div><nav><ul><li><a href="/x">Home</a></li></ul></nav><!-- <p>no</p> -->
<main><article class="post has-comments"><header><h1>Title &amp; more</h1></header><p>Hello <b>wor</b>ld &lt;x&gt;\n a < b<br>c<p>Short.
<div class="ad-slot">Buy now</div><form><label>Mail</label><input></form><script>var t="</p>";</script><p>End.</p>
<section class="comments"><article class="comment"><p>I like it very much because of the many words it has in it</p></article></section></article></main>
<aside class=sidebar><p>Popular posts of this week and the last</p></aside><footer>&copy; 2020 by us</footer><script>if (a<b) write("<p>x</p>")"""


def test_article_text_is_kept_and_furniture_goes(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (2, "v", None), (3, None, ""), (None, "w", "<article><p>x &eacute;  y</p><p></p>")], "page_id long, url string, html string")
    got = {r["page_id"]: r for r in html_text.extract(pages, ["page_id", "url"]).collect()}
    assert got[1]["text"] == "Title & more\n\nHello world <x> a < b c\n\nShort.\n\nEnd."
    assert (got[2]["text"], got[2]["n_chars"], got[3]["text"]) == ("", 0, "")
    assert (got[None]["text"], got[None]["n_chars"]) == ("x é y", 5)
    assert html_text.extract(pages.filter("false"), ["page_id"]).count() == 0


def test_pages_without_an_article_element():
    long = "This paragraph has more than enough words to be taken for article text by anyone who reads it."
    page = f"<body><div class=menu><a>Home</a><a>News</a></div><div id=content><h1>A title of the story here</h1><p>{long}</p><p>{long}</p><p>Short end here.</p></div><div id=footer>Copyright</div>"
    assert html_text.main_text(page, html_text.train()) == "\n\n".join(["A title of the story here", long, long, "Short end here."])


def test_broken_markup_and_long_pages():
    tree = html_text.train()
    assert [html_text.main_text(x, tree) for x in ["", "<", "<p", "<article>x", "<article><p>a<script>b", "<article>a<p class='x"]] == ["", "", "", "x", "a", "a"]
    text = html_text.main_text("<article>" + "".join(f"<p>{i}</p>" for i in range(20000)), tree)
    assert text.split("\n\n") == [str(i) for i in range(20000)]
    html_text.main_text("<article>" + '<a "' * 50000, tree)


def test_names_are_matched_as_a_whole():
    furniture = ["ad", "ads", "ad-slot", "adBanner", "sidebar", "right-sidebar", "comments", "comment-list", "site-footer", "cookie-notice", "related-posts", "shareButtons", "newsletter-signup", "ad-300x250", "nav_menu", "site-header"]
    text = ["related-work", "search-methods", "side-effects-study", "no-js", "has-sidebar", "shadow", "header-less", "commentary", "content", "adventure", "notice-of-the-hearing", "post", "entry-content", "download"]
    assert [n for n in furniture if not html_text.names_furniture(n, False)] == []
    assert [n for n in text if html_text.names_furniture(n, False)] == []
    assert not html_text.names_furniture("site-header", True) and not html_text.names_furniture("entry-header", False)


def test_furniture_on_paragraphs_links_and_spans():
    tree = html_text.train()
    text = html_text.main_text('<article class="related-work"><h2>Related work</h2><p>We read <span class="ad">now cheaper</span>it all <a class="share-button" href="/s">Share</a>twice.</p><p class="ad">Buy this</p><section id="search-methods"><p>We searched.</p></section><div class="no-js side-effects-study"><p>Nobody fell ill.</p></div></article>', tree)
    assert text == "Related work\n\nWe read it all twice.\n\nWe searched.\n\nNobody fell ill."
    assert html_text.main_text("<body><p>Two short paragraphs here.</p><p>This is the second of them.</p></body>", tree) == "Two short paragraphs here.\n\nThis is the second of them."
    assert html_text.main_text("<article><p>one &amp;amp; two\u00a0three&nbsp;four &#233; &unknown; &lt;b&gt;</p></article>", tree) == "one &amp; two three four é &unknown; <b>"


def made_page(rng):
    """A page and the blocks of its article."""
    say = lambda a, b: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(a, b)))
    article = [say(3, 10)] + [say(*rng.choice([(2, 6), (8, 20), (25, 80)])) for _ in range(rng.randint(2, 9))]
    ad = lambda: rng.choice([f"<div class='ad-slot'>{say(3, 15)}</div>", f"<p class=promo>{say(5, 30)}</p>", f"<aside>{say(10, 30)}</aside>", f"<!-- {say(3, 9)} -->", f"<script>var x='<p>{say(3, 5)}</p>'</script>", f"<figure hidden>{say(4, 9)}</figure>"])
    links = "".join(f"<li><a href='/{i}'>{say(1, 4)}</a></li>" for i in range(rng.randint(3, 9)))
    body = f"<h1>{article[0]}</h1>" + "".join((ad() if rng.random() < 0.2 else "") + f"<p>{x}</p>" for x in article[1:])
    top = rng.choice([f"<header><h2>{say(1, 4)}</h2><nav><ul>{links}</ul></nav></header>", f"<div id='top-nav'><ul>{links}</ul></div>", f"<nav>{links}</nav><div class='cookie-notice'><p>{say(10, 40)}</p></div>"])
    after = rng.choice([f"<section id='comments'><h3>{say(1, 3)}</h3><p>{say(10, 60)}</p></section>", f"<div class='related-posts'><ul>{links}</ul></div>", f"<form><label>{say(2, 5)}</label><button>{say(1, 2)}</button></form>", ""])
    marked = rng.random() < 0.7
    body = f"<article>{body}{after}</article>" if marked else f"<div class='{rng.choice(['content', 'entry', 'main-text'])}'>{body}</div>{after}"
    return f"<html><head><title>{say(3, 6)}</title><style>p{{}}</style></head><body>{top}{body}<footer><p>{say(5, 20)}</p></footer></body></html>", article


LONG = " ".join(f"w{i}" for i in range(40))
STORY = f"<h1>A title here</h1><p>{LONG}</p><p>{LONG} and more</p><p>{LONG} to the end</p>"
TOLD = ["A title here", LONG, f"{LONG} and more", f"{LONG} to the end"]


@pytest.mark.parametrize(
    ("page", "told"),
    [
        (f'<body><form id="aspnetForm"><div><a href="/">Home</a> <a>News</a></div>{STORY}</form></body>', TOLD),
        (f'<article>{STORY}</article><section class="responses"><h3>Two replies</h3><div><b>Ann</b><p>I liked this a lot, thank you for it.</p></div><div><b>Bob</b><p>Not so sure about the end.</p></div></section>', TOLD),
        (f'<article>{STORY}<section class="feedback"><p>Great piece of work!</p><p>I do not agree with that at all.</p></section></article>', TOLD),
        (f'<article>{STORY}</article><section class="discussion"><div>Ann</div><p>I liked this a lot, thank you for it.</p><div>Bob</div><p>Not so sure about the end.</p></section>', TOLD),
        (f'<main>{STORY}<a href="/1"><div><h3>Another one of these</h3><p>{LONG}</p></div></a><a href="/2"><div>{LONG}</div></a></main>', TOLD),
        (f'<main>{STORY}<div class="latest-news"><h3>Latest</h3><p>Minister resigns after the vote</p><p>Storm hits the northern coast today</p></div></main>', TOLD),
        (f'<main>{STORY}<div class="latest-news"><ul><li><a>Minister resigns after the vote</a><li><a>Storm hits the northern coast</a></ul></div></main>', TOLD),
        (f"<article>{STORY}</article><article><h2>Another story</h2><p>A teaser of some words that lead to it.</p></article>", TOLD),
        (f"<body><div>We use cookies to make this site better for you. Accept</div>{STORY}<div>Copyright 2020 Example Media. All rights reserved.</div></body>", TOLD),
        (f"<body><h1>A title here</h1><p>{LONG}</p><ul><li>a first point</li><li>another point that is longer</li></ul><p>{LONG} and more</p><table><tr><th>Year</th><th>Sum</th></tr><tr><td>2020</td><td>15 tons</td></tr></table><p>{LONG} to the end</p></body>", [*TOLD[:2], "a first point", "another point that is longer", TOLD[2], "Year", "Sum", "2020", "15 tons", TOLD[3]]),
        (f"<article>{STORY}<h2>References</h2><ol><li><a>Smith 2001, On the matter of things</a></li><li><a>Jones 2004, More of the same matter</a></li></ol></article>", [*TOLD, "References", "Smith 2001, On the matter of things", "Jones 2004, More of the same matter"]),
        (f'<article><h1>A title here</h1><p>{LONG}</p><section class="discussion"><h2>Discussion</h2><p>{LONG} and more</p><p>{LONG} to the end</p></section></article>', [*TOLD[:2], "Discussion", *TOLD[2:]]),
        (f'<body><a name="top"><div>{STORY}</div></body>', TOLD),
    ],
    ids=["page in a form", "responses", "feedback", "answers", "link cards", "headlines", "linked headlines", "teaser", "notices without names", "lists and tables", "references", "part named discussion", "anchor never closed"],
)
def test_furniture_without_telling_names(page, told):
    assert html_text.main_text(page, html_text.train()).split("\n\n") == told


def plain_page(rng):
    """A page whose furniture has no telling class, and the blocks of its article."""
    say = lambda a, b: " ".join("".join(rng.choice("hijklmn") for _ in range(rng.randint(2, 9))) for _ in range(rng.randint(a, b)))
    tag = lambda name, x: f"<{name}{rng.choice(['', '', f' class={say(1, 1)}', f' id={say(1, 1)}'])}>{x}</{name}>"
    link = lambda a, b: f"<a href='/{rng.random()}'>{say(a, b)}</a>"
    links = lambda a, b: tag("ul", "".join(tag("li", link(a, b)) for _ in range(rng.randint(3, 8)))) if rng.random() < 0.5 else tag("div", " | ".join(link(a, b) for _ in range(rng.randint(3, 8))))
    told: list[str] = []

    def part(x, name):
        told.append(x)
        return tag(name, x)

    body = part(say(4, 12), "h1")
    for i in range(rng.randint(3, 10)):
        kind = rng.random()
        if kind < 0.12 and i:
            body += part(say(1, 6), "h2") + part(say(25, 70), "p")
        elif kind < 0.22 and i:
            body += tag("ul", "".join(part(say(4, 20), "li") for _ in range(rng.randint(2, 6))))
        elif kind < 0.3 and i:
            body += tag("blockquote", part(say(10, 40), "p"))
        else:
            x = say(*rng.choice([(15, 40), (30, 90)]))
            told.append(x)
            words = x.split()
            body += f"<p>{' '.join(words[:3])} <a href='/x'>{' '.join(words[3:5])}</a> <em>{words[5]}</em> {' '.join(words[6:])}</p>"
    body += part(say(30, 60), "p")
    marked = rng.random() < 0.5
    notice = tag("div", f"{say(8, 20)} {link(1, 2)}") if rng.random() < 0.4 else ""
    top = notice + tag("div", tag("div", link(1, 3)) + links(1, 3))
    after = rng.choice([links(4, 9), tag("div", "".join(f"<a href='/y'><div><h4>{say(3, 8)}</h4><span>{say(6, 18)}</span></div></a>" for _ in range(3))), tag("div", tag("h3", say(1, 3)) + links(5, 10)), tag("div", "".join(tag("p", link(4, 10)) + tag("p", say(1, 3)) for _ in range(rng.randint(2, 5)))), ""])
    inside = rng.random() < 0.3
    if inside:
        body += tag(rng.choice(["h2", "h3"]), say(1, 3)) + tag("ul", "".join(tag("li", link(4, 9)) + (tag("li", say(1, 3)) if rng.random() < 0.3 else "") for _ in range(rng.randint(2, 5))))
    last = tag("div", f"{say(3, 9)} {rng.choice(['', link(1, 2)])}") + (links(1, 2) if rng.random() < 0.5 else "")
    page = top + tag("article" if marked else "div", body) + after + last
    if rng.random() < 0.2:
        page = f"<form method=post>{page}</form>"
    return f"<html><body>{page}</body></html>", told


def precision_and_recall(make, tree, seed):
    rng = random.Random(seed)
    right = kept = wanted = 0
    for _ in range(400):
        page, article = make(rng)
        found, regions = html_text.blocks(page)
        rows = html_text.page_features(found, regions)
        got = {b.text for b, row in zip(found, rows, strict=True) if html_text.decide(tree, row)}
        right, kept, wanted = right + len(got & set(article)), kept + len(got), wanted + len(set(article))
    return right / kept, right / wanted


def test_precision_and_recall_without_names():
    precision, recall = precision_and_recall(plain_page, html_text.train(), 5)
    assert precision >= 0.95 and recall >= 0.95


def test_precision_and_recall_on_labelled_pages():
    precision, recall = precision_and_recall(made_page, html_text.train(), 21)
    assert precision >= 0.95 and recall >= 0.95


def test_neighbours_decide():
    """Without the words and links of the blocks around, fewer blocks are told apart, on held-out pages too."""
    tree, blind = html_text.train(), html_text.train(html_text.NEIGHBOURS)
    splits = lambda t: [] if len(t) == 1 else [html_text.FEATURES[t[0]], *splits(t[2]), *splits(t[3])]
    assert set(html_text.NEIGHBOURS) <= set(splits(tree)) and not set(html_text.NEIGHBOURS) & set(splits(blind))
    for make in (plain_page, made_page):
        assert sum(precision_and_recall(make, tree, 8)) > sum(precision_and_recall(make, blind, 8)) + 0.02


def test_repeated_clashing_and_very_long_pages(spark):
    long = "<article><p>" + "word " * 10_000_000 + "</p></article>"
    rows = [(1, "a", PAGE), (1, "a", PAGE), (2, "b", long)]
    got = html_text.extract(spark.createDataFrame(rows, "page_id long, n_chars string, html string").withColumnRenamed("n_chars", "html2"), ["page_id", "html2"]).collect()
    assert [r["n_chars"] for r in got if r["page_id"] == 2] == [49_999_999]
    assert len({(r["page_id"], r["text"]) for r in got}) == 2 and len(got) == 3
    clash = html_text.extract(spark.createDataFrame([("t", PAGE)], "text string, html string"), ["text"])
    assert clash.columns == ["text", "text", "n_chars"] and clash.toDF("a", "b", "c").first()["a"] == "t"
