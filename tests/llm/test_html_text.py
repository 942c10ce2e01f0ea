"""Main text: planted pages, the host's suffix array against a plain search, odd input."""

import random
import re
import time

import pytest

from quillon.llm import html_text as h


def test_article_without_furniture():
    page = """<!DOCTYPE html><html><head><title>no</title><style>p{}</style><script>var t="</p>";</script></head><body><header><h1>Site</h1></header>
    <nav><ul><li><a href="/x">menu</a></li></ul></nav><!-- ad 1 --><div class="ad">buy</div><div class="cookie-notice">cookies</div>
    <article><h1>Title &amp; more</h1><p><b>Bold</b>er  than<br>that &lt;3<p>next\n\n para<aside>side</aside><form>mail <input></form>
    <div class="share-buttons">share</div><p>a < b</p><section id="comments"><article>me too</article></section></article><footer>&copy; x</footer>"""
    assert h.read(page)[0] == "Title & more Bolder than that <3 next para a < b"


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<nav>menu<article>text</article>", "text"),
        ("<main>a<script>x", "a"),
        ("<div id=content>a <!-- b", "a"),
        ("<article>a<article>b</article>c</article>d", "a b c"),
        ("<ARTICLE>a<span>b</span></ARTICLE>", "ab"),
        ("<article></article>x", ""),
        ("<article>it's <a title='x>y'>z</a>", "it's z"),
        ("plain", None),
        ("", None),
    ],
)
def test_odd_pages(page, text):
    assert h.read(page)[0] == text


def test_repeated_tokens_equal_a_plain_search():
    rng = random.Random(4)
    shared = [[rng.choice("abc") for _ in range(rng.randrange(3, 12))] for _ in range(4)]
    streams = [[x for _ in range(3) for x in (rng.choice(shared) if rng.random() < 0.6 else [f"u{rng.random()}"])] for _ in range(30)] + [[], ["a"]]
    for long in (1, 3, 5, 8):
        where = {}
        for p, s in enumerate(streams):
            for i in range(len(s) - long + 1):
                where.setdefault(tuple(s[i : i + long]), set()).add(p)
        for s, flags in zip(streams, h.repeated_tokens(streams, long), strict=True):
            want = [False] * len(s)
            for i in range(len(s) - long + 1):
                if len(where[tuple(s[i : i + long])]) > 1:
                    want[i : i + long] = [True] * long
            assert list(flags) == want


def test_query_on_the_table(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = {r.page_id: r for r in h.extract(pages).collect()}
    assert len(rows) == pages.count()
    for p in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", p.html, re.S)[1]
        text = re.sub(r"<(?!/?b>)[^>]*>", " ", inner)
        want = " ".join(h.html.unescape(re.sub(r"</?b>", "", text)).split())
        assert rows[p.page_id].text == want and rows[p.page_id].n_chars == len(want) and rows[p.page_id].url == p.url


def test_pages_without_article_lose_what_the_host_repeats(spark):
    frame = "Home News Sport Weather Contact About Imprint Privacy Terms"
    data = [(i, f"http://h.example/{i}", f"<div>{frame}</div><p>page{i} has {i * i} " + "x" * i) for i in range(5)]
    data += [(9, None, None), (10, "http://h.example/r", "<article>kept</article>"), (10, "http://h.example/r", "<article>kept</article>"), (None, "odd", "<p>alone")]
    df = spark.createDataFrame([(*r, "t") for r in data], "page_id long, url string, html string, text string")
    rows = h.extract(df).collect()
    got = {r.page_id: r.text for r in rows}
    assert len(rows) == len(data)
    assert got[3] == "page3 has 9 xxx" and got[9] == "" and got[10] == "kept" and got[None] == "alone"
    assert h.extract(df.limit(0)).count() == 0


def test_large_host_is_one_host(spark):
    """A notice that two of a host's 1500 pages share is boilerplate wherever they lie."""
    data = [(i, f"http://big.example/{i}", f"<p>own{i} text {i * 7}</p><p>" + (" ".join(f"n{i % 30}w{k}" for k in range(10)) if i < 60 else "") + "</p>") for i in range(1500)]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    got = {r.page_id: r.text for r in h.extract(df).collect()}
    assert len(got) == 1500
    assert [i for i in range(1500) if got[i] != f"own{i} text {i * 7}"] == []


def test_host_equals_suffix_array(spark):
    """The dealt suffixes give what one suffix array gives; article pages are evidence; rows of one id that differ are different pages, equal rows are one."""
    rng = random.Random(8)
    parts = [" ".join(rng.choice("abc") for _ in range(rng.randrange(3, 16))) for _ in range(6)]
    streams = [" ".join(rng.choice(parts) if rng.random() < 0.6 else f"u{rng.random()}" for _ in range(4)) for _ in range(40)]
    menu = "one two three four five six seven eight nine"
    streams += [f"left {menu}", f"{menu} right"]
    data = [(i // 2, "http://h.example/", f"<p>{s}</p>") for i, s in enumerate(streams)]
    data += [(None, "http://h.example/", "<p>only here but in two equal rows so it stays whole</p>")] * 2
    data += [(50, "http://h.example/", "<div>the menu that stands beside an article and here</div><article>x</article>"), (51, "http://h.example/", "<p>the menu that stands beside an article and here</p>")]
    data += [(52, "http://other.example/", "<p>the menu that stands beside an article and here</p>")]
    rows = h.extract(spark.createDataFrame(data, "page_id long, url string, html string")).collect()
    plain = [s.split(" ") for s in streams]
    plain += ["only here but in two equal rows so it stays whole".split(), *["the menu that stands beside an article and here".split()] * 2]
    flags = h.repeated_tokens(plain)
    want = [(i // 2, " ".join(w for w, f in zip(s, flags[i], strict=True) if not f)) for i, s in enumerate(plain[: len(streams)])]
    want += [(None, "only here but in two equal rows so it stays whole")] * 2 + [(50, "x"), (51, ""), (52, "the menu that stands beside an article and here")]
    assert sorted(((r.page_id, r.text) for r in rows), key=repr) == sorted(want, key=repr)
    assert all(r.n_chars == len(r.text) for r in rows)


def test_named_parts_of_an_article(spark):
    """Titles and sections that are only named like furniture stay, what the host repeats under such names goes, short or long; reprints stay."""
    long_ = "read also what our readers liked best this week and the next"
    reprint = "<p>" + " ".join(f"r{k}" for k in range(30)) + "</p>"
    data = [
        (i, f"http://h.example/{i}", f'<div>Site menu</div><article><div class="post-header"><h1>Title {i}</h1></div><div class="banner">Our shop</div><p>own{i} text</p>{reprint}'
         f'<section id="related-work">Work{i} before ours</section><div class="related">{long_}</div><div class="comments">me{i}</div></article>')
        for i in range(6)
    ]
    got = {r.page_id: r.text for r in h.extract(spark.createDataFrame(data, "page_id long, url string, html string")).collect()}
    words = " ".join(f"r{k}" for k in range(30))
    assert got == {i: f"Title {i} own{i} text {words} Work{i} before ours" for i in range(6)}


def test_broken_tags_take_linear_time():
    for page in ('<a x="' * 200_000, "<a x='" * 200_000 + ">", "<!--" * 200_000, "<" * 500_000, '<a x=">' * 100_001, "<script>" * 100_000, "<div class=related>" * 60_000):
        began = time.time()
        h.read("<article>" + page)
        assert time.time() - began < 2


@pytest.mark.parametrize("n", [10, 110_000, 2_000_000])
def test_attributes_of_any_length(n):
    """A > inside quotes ends no tag, however long the value is."""
    long = "x" * n
    assert h.read(f'<p>start <a title="{long}>" href=\'{long}">\'>link</a>') == (None, [], "start link")
    assert h.read(f"<article>a<b title='{long}\">'>c</b></article>") == ("ac", [], "")


def test_unclosed_quotes_end_at_the_first_bracket():
    assert h.read('<p>a <i title="x>b</i> c > d') == (None, [], "a b c > d")
    assert h.read("<p>a <i title='x>b</i> <i title=\"y>z\">c</i>") == (None, [], "a b c")
