"""Main text of pages: blocks, alignment against the textbook table, and pages whose template only a pair shows."""

import random

import pytest

from loglake.llm import pages as p

PAGES = "page_id long, url string, html string, key string, lines int, host string"


def text_of(html):
    return p.main_text(p.lines(html))


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""),
        ("just   text &amp; more", "just text & more"),
        ("<article><h1>T &copy; x</h1><p>a <b>b</b>\n c<br>d</article>", "T © x\na b c d"),
        ("<nav>menu</nav><article><p>one<p>two<aside>side</aside><footer>end</footer></article><footer>f</footer>", "one\ntwo"),
        ("<header><h1>Site</h1></header><article><header><h1>Title</h1><p>by me</p></header><p>x</p></article>", "Title\nx"),
        ("<article><p><b>open.<br><p>next</p></article><div>out</div>", "open.\nnext"),
        ("<main><p>m</p><div class='share-box'>s</div><form>f</form></main><p>out</p>", "m"),
        ("<main><p>m</p><article><p>a</p></article></main>", "a"),
        ("<article><section id=comments><article><p>nice!</p></article></section><p>body</p></article>", "body"),
        ('<script>var t="</p><article>no</article>";</script><article>yes</article>', "yes"),
        ("<article>a<script>x < y </SCRIPT >b<style>p{}</style><!-- c <p>no -->d</article>", "abd"),
        ("<article><script>never closed", ""),
        ("<article>a<!-- never closed", "a"),
        ('<article><p title="a > b" class=\'x\'>q</p><p data-class="ad">r</p><p class=ad>s</p>', "q\nr"),
        ('<article><p title="never closed>q</p><p>r</p>', "q\nr"),
        ("<article>1 < 2 &lt; 3 &am &amp &#x41; &#65;</article>", "1 < 2 < 3 &am & A A"),
        ("<article>a&nbsp;b <table><tr><td>c</td><td>d</td></tr></table></article>", "a b\nc\nd"),
        ("<div role='navigation'>x</div><div class='cookie-notice'>y</div><p>z</p>", "z"),
        ("<ARTICLE><P>up</P></ARTICLE>", "up"),
        ("<b>" * 3000 + "deep" + "</b>" * 3000, "deep"),
    ],
)
def test_text_of_one_page(html, text):
    assert text_of(html) == text


def longest(a, b):
    size = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            size[i + 1][j + 1] = size[i][j] + 1 if x == y else max(size[i][j + 1], size[i + 1][j])
    return size[-1][-1]


@pytest.mark.parametrize("bits", [p.TABLE_BITS, 40, 1])
def test_alignment_is_a_longest_common_subsequence(bits):
    rng = random.Random(bits)
    for _ in range(600):
        a, b = ([rng.randint(0, 5) for _ in range(rng.randint(0, 14))] for _ in "ab")
        places = p.common(a, b, bits)
        rest = iter(b)
        assert all(a[i] in rest for i in places)
        assert places == sorted(set(places)) and len(places) == longest(a, b)


def page(n, url, body, extra=""):
    return (n, url, f"<html><body><div>Acme news</div><p>Call us today</p>{body}<p>All rights {extra}kept</p></body></html>", "k", 1, "h")


def texts(df):
    assert df.columns == ["page_id", "url", "text"]
    return {(r.page_id, r.url): r.text for r in df.collect()}


def test_shared_lines_of_unmarked_pages_go(spark, monkeypatch):
    monkeypatch.setattr(p, "GROUP_PAGES", 4)  # neighbours in other groups
    rows = [page(i, f"http://acme.org/news/{i:03d}", f"<p>story {i} is told here at some length</p><p>and ends {i * i}.</p>") for i in range(40)]
    copies = [(100 + i, f"http://acme.org/news/{i:03d}?print=1", rows[i][2], "k", 1, "h") for i in range(3)]
    alone = [page(200, "http://lonely.org/a", "<p>only one</p>"), page(201, None, "<p>no url</p>"), page(202, "nothing", "<p>no host</p>")]
    odd = [(203, "http://acme.org/zzz", None, None, None, None), (204, "http://acme.org/zzz", "", "", 0, ""), (None, "http://x.org", "<p>null id</p>", "", 0, "")]
    got = texts(p.extract(spark.createDataFrame(rows + copies + alone + odd + rows[:2], PAGES).repartition(7)))
    for i in range(40):
        assert got[i, f"http://acme.org/news/{i:03d}"] == f"story {i} is told here at some length\nand ends {i * i}."
    for i in range(3):  # a copy is no template
        assert got[100 + i, f"http://acme.org/news/{i:03d}?print=1"] == got[i, f"http://acme.org/news/{i:03d}"]
    assert got[200, "http://lonely.org/a"] == "Acme news\nCall us today\nonly one\nAll rights kept"
    assert got[201, None].endswith("no url\nAll rights kept") and got[202, "nothing"].endswith("no host\nAll rights kept")
    assert got[203, "http://acme.org/zzz"] == got[204, "http://acme.org/zzz"] == "" and got[None, "http://x.org"] == "null id"
    assert p.extract(spark.createDataFrame(rows[:2] * 3, PAGES)).count() == 6
    assert p.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_shared_passages_of_an_article_stay(spark):
    passage = "<p>a passage that very many pages repeat word by word</p>"
    rows = [(i, f"http://h.org/{i}", f"<nav>m {i}</nav><article><p>own {i}</p>{passage}</article><footer>f</footer>", "", 0, "") for i in range(12)]
    rows.append((50, "http://h.org/50", "<article>" + "<p>long</p>" * 20_000 + "</article>", "", 0, ""))
    got = texts(p.extract(spark.createDataFrame(rows, PAGES)))
    assert got[3, "http://h.org/3"] == "own 3\na passage that very many pages repeat word by word"
    assert got[50, "http://h.org/50"].count("long") == 20_000


def test_nearest_is_the_longest_common_path():
    def at(path, *keys):
        return {"path": path, "lines": list(keys), "sizes": [1] * len(keys), "host": "h"}

    page_ = at("/en/12", 1, 2, 3)
    near = [(-1, at("/de/99", 1)), (1, at("/en/13", 2)), (2, at("/en/2", 3))]
    assert p.shared_lines(page_, near) == [1]
    assert p.shared_lines(page_, [(-1, at("/en/11", 3)), (1, at("/en/13", 2))]) == [2]
    assert p.shared_lines(page_, [(1, at("/en/13", 1, 2, 3)), (-1, at("/de", 2))]) == [1]
    assert p.shared_lines(page_, []) == []
