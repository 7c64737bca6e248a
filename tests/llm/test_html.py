import html
import itertools
import random
import re

from assayer.llm import html as pages
from assayer.llm import queries

SF = "/root/testdata/sf0.01"


def test_query_matches_the_article_of_every_page(spark):
    source = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = queries.op1_main_text(spark, SF).collect()
    assert len(rows) == len(source)
    for r in rows:
        article = re.search(r"<article>(.*?)(</article>|$)", source[r["page_id"]], re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)[^>]*>", article)]
        assert r["text"] == "\n".join(x for x in parts if x)
        assert r["n_chars"] == len(r["text"])


def test_boilerplate_goes():
    page = """<html><head><title>x</title></head><body class="has-sidebar"><header><h1>Site</h1></header><div id="cookie-banner">We use cookies.
    Accept all of them please now.</div><main><h1>Real</h1><p>One &amp; two<br>three.<p>Four <a href=x>link</a> five.
    <div class="ad">Buy this great thing now, it is very cheap.</div><section class="comments"><article><p>I liked this article very much.</p></article></section>
    <form><p>Name your email</p><input></form></main><aside><p>Side text that is long and nice to read for all.</p></aside><footer>bye</footer>"""
    assert pages.main_text(page) == "Real\nOne & two three.\nFour link five."


def test_a_page_without_structure_keeps_its_sentences():
    page = "<p>Just text with no structure, but a long sentence.</p><ul><li><a href=a>Home</a></li><li><a href=b>About</a></li></ul><p>Another paragraph follows here and ends.</p>"
    assert pages.main_text(page) == "Just text with no structure, but a long sentence.\nAnother paragraph follows here and ends."


def test_names_and_wrappers_do_not_settle_what_a_page_holds():
    text = "<p>Some text that goes on for a while, with many words in it, really.</p><p>And more of it here, as one would expect from a page, at some length.</p>"
    want = "Some text that goes on for a while, with many words in it, really.\nAnd more of it here, as one would expect from a page, at some length."
    aside = '<div class="sidebar-left"><p>Look at this one. It is good and cheap, and you will like it.</p></div>'
    comment = '<section class="comments"><article class="comment"><p>I like this very much, as long as it is, thank you for it.</p></article></section>'
    for page in (
        f'<form id="aspnetForm"><div>{text}</div></form><footer>bye</footer>',
        f'<article class="post category-social">{text}</article>{aside}',
        f'<article class="post comments-open">{text}</article>{comment}',
        f'<div class="layout sidebar-left"><nav><a href="/">Home</a></nav><div>{text}</div></div><footer>Copyright</footer>',
        f'<form action="/subscribe"><p>Give us your address and we will write to you.</p><label>E-mail</label></form><main>{text}</main>',
        f'<div id="content">{text}</div><form><p>Name and address, please, so that we may write to you every day.</p></form>{comment}',
    ):
        assert pages.main_text(page) == want, page


def test_the_cut_decides_where_a_block_alone_would_go_the_other_way():
    page = """<div><h4>Head</h4><p>Some text that goes on for a while, with many words in it, really.</p><p>Indeed so</p>
    <p>And more of it here, as one would expect from a page, at some length.</p></div>
    <ul><li><a href=a>Home</a></li><li>Longer words between the links here.</li><li><a href=b>About</a></li><li><a href=c>Us</a></li></ul>"""
    found = pages.blocks(page)
    flipped = [text for (text, score, _), content in zip(found, pages.label(found), strict=True) if (score > 0) != content]
    assert "Head" in flipped and "Indeed so" in flipped
    assert pages.main_text(page).split("\n")[:4] == [f[0] for f in found[:4]]


def test_cut_is_minimal():
    rng = random.Random(5)
    for _ in range(60):
        n = rng.randint(1, 8)
        scores = [rng.uniform(-3, 3) for _ in range(n)]
        edges = [(a, b, rng.uniform(0, 2)) for a, b in itertools.combinations(range(n), 2) if rng.random() < 0.5]

        def cost(side):
            return sum(max(0, s) if not x else max(0, -s) for s, x in zip(scores, side, strict=True)) + sum(w for a, b, w in edges if side[a] != side[b])

        best = min(cost(side) for side in itertools.product([True, False], repeat=n))
        assert abs(cost(pages.minimum_cut(scores, edges)) - best) < 1e-9


def test_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>A sentence that is long enough to be kept.</p>"), (3, "u", "<" * 3000), (4, "u", "<div>" * 20000 + "A sentence that is long enough to be kept."), (4, "u", '<p title="' * 3000)] * 2
    df = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, text string")
    got = pages.extract(df).collect()
    assert len(got) == 12
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert {r["text"] for r in got if r["page_id"] in (1, 2)} == {""}
    assert [r["text"] for r in got if r["page_id"] is None] == ["A sentence that is long enough to be kept."] * 2
    assert pages.extract(df.limit(0)).count() == 0
