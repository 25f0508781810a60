from __future__ import annotations

import html
import math
import random
import re

import pytest
from helpers import DATA
from pyspark.sql import functions as F

from quire.llm import html_extraction as h


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("plain", "plain"), ("<p>one<p>two", "one two"), ("<b>a</b>b <i>c</i>", "ab c"), ("a<br>b", "a b"), ("x &amp; &lt;y&gt; &#228;&nbsp;z &copy", "x & <y> ä z ©"), ("a < b", "a < b"), ("<p>cut<scr", "cut"), ("<p>cut <!-- open", "cut"),
        ("<script>var a='<p>';</script>t<style>p{}</style>", "t"), ("<script>never closed", ""), ("<nav>m</nav><header>h</header><p>t</p><aside>s</aside><footer>f</footer><form>q<input></form>", "t"),
        ('<div class="ad">a</div><div class="cookie-notice">c</div><div id="comments"><p>r</p></div><div role="navigation">n</div><p>t', "t"),
        ('<div class="with-sidebar"><article><header><h1>T</h1></header><p>x</p><section class="comments">c</section><footer>by</footer></article></div><p>out', "T x"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul>", "a b c"), ("<table><tr><td>1<td>2<tr><td>3</table>", "1 2 3"), ("<main><p>m</main><article><p>a</article>", "m a"), ("<article></article><p>fallback", "fallback"),
        ("<div>" * 30_000 + "deep" + "</div>" * 30_000, "deep"),
        ('<article><p>a</p><section id="discussion"><p>b</p></section><h2 id="related-work">R</h2><h2 id="search">S</h2><div class="commentary">c</div><div id="cookie-recipe">d</div><a class="share" href="x">e</a></article>', "a b R S c d e"),
        ('<article><p>a</p><div class="ad-box">x</div><div class="adverts">x</div><div id="comments">x</div><ul class="comment-list"><li>x</ul><div class="cookie-notice">x</div></article>', "a"),
        ('<article><p>a</p></article><div id="comments"><ol class="comment-list"><li><article class="comment-body">x</article><li><article>y</article></ol></div><div class="related"><article>z</article></div>', "a"),
        ('<div class="header-wrap"><div class="search"><article><p>a</p></article></div></div><article><p>b</article>', "a b"), ("</div></p>x", "x"), ("<p a='>'>quoted</p>", "quoted"), ('<p title="a>b" x=y>q', "q"), ("<ARTICLE><P>Case</P></ARTICLE>", "Case"), ("<title>t</title><textarea>u</textarea>v", "v"), ("<div role=main><p>in</div><p>out", "in"), ("<p hidden>no<p style='display: none'>no<p class=hidden-gem>yes", "yes"), ("<div class=cookiebar>c</div><div id=comments-list>d</div><p>t", "t"), ("<a/b>x", "x"),
    ],
)
def test_main_text(page, want):
    assert h.main_text(page) == want


def test_query_gives_the_articles(spark):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    rows = h.op5_html_extraction(spark, DATA).collect()
    assert sorted(r["page_id"] for r in rows) == sorted(pages)
    for r in rows:
        article = re.search("<article>(.*)</article>", pages[r["page_id"]]["html"], re.S)[1]
        assert r["text"] == " ".join(html.unescape(re.sub("<[^>]*>", " ", article)).split())
        assert (r["n_chars"], r["url"]) == (len(r["text"]), pages[r["page_id"]]["url"])


def site(n, host="site.example"):
    r = random.Random(1)
    words = lambda k: " ".join(f"w{r.randrange(10**6)}" for _ in range(k))
    return [(i, f"http://{host}/{i}", f'<div class="lay"><div class="top">Same words everywhere</div><div class="body"><p>{words(12)}</p><p>{words(9)}</p></div><div class="low">All rights</div></div>') for i in range(n)]


def test_repeated_branches_of_a_site_go(spark):
    rows = spark.createDataFrame(site(8) + site(3, "few.example"), "page_id long, url string, html string")
    got = h.extract(rows).collect()
    for r in got:
        repeated = "Same words everywhere" in r["text"] or "All rights" in r["text"]
        assert repeated == ("few.example" in r["url"])
        assert r["text"].count("w") >= 21


def test_the_tree_decides_inside_articles(spark):
    r = random.Random(2)
    words = lambda k: " ".join(f"w{r.randrange(10**6)}" for _ in range(k))
    page = lambda: f'<article><p>{words(20)}</p><div class="box">Read this next</div><div class="box2">{words(5)}</div><section id="discussion">{words(4)}</section><div class="notice">Terms apply, {r.choice(["a", "b"])}</div><p>{words(9)}</p></article>'
    rows = [(i, f"http://big.example/{i}", page()) for i in range(10)] + [(100 + i, f"http://small.example/{i}", page()) for i in range(3)]
    pages = {i: html_ for i, _, html_ in rows}
    got = {x["page_id"]: x["text"] for x in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, text in got.items():
        assert (text != h.main_text(pages[i])) == (i < 100)
        assert ("Read this next" in text) == ("Terms apply" in text) == (i >= 100)
        assert text.count("w") == 38


def test_noise_of_unmarked_sites_goes_and_articles_stay(spark):
    r = random.Random(9)
    words = lambda k: [f"w{r.randrange(10**6)}" for _ in range(k)]
    menu, promo = [f"Menu{i}" for i in range(30)], ["Join ten thousand readers", "Get our app", "Rated five stars"]
    rows, own = [], {}
    for i in range(60):
        text = words(80)
        own[i] = set(text)
        some = " ".join(f"<span>{m}</span>" for m in menu)
        rows.append((i, f"http://h{i % 3}.example/{i}", f'<div class="z1"><div class="z2">{some}</div><div class="z3"><p>{" ".join(text[:50])}</p><p>{" ".join(text[50:])}</p></div><div class="z4"><p>{r.choice(promo)}</p></div><div class="z5">Imprint and terms</div></div>'))
    kept = noise = 0
    for x in h.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        found = x["text"].split()
        kept += len(own[x["page_id"]] & set(found))
        noise += sum(w not in own[x["page_id"]] for w in found)
    assert kept == 60 * 80 and noise < 0.1 * 60 * (30 + 4 + 3)


def test_importance_matches_plain_entropy(spark):
    pages = site(6)
    rows = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("host", h.host_of("url")).select("host", "html")
    got = {r["node"]: (r["pages"], r["importance"]) for r in h.style_importance(rows).collect()}
    counts = {}
    for _, _, page in pages:
        for node, kind, feature in h.style_features(page):
            counts.setdefault(node, {}).setdefault((kind, feature), []).append(1)
    for node, features in counts.items():
        shown = sum(len(v) for (k, _), v in features.items() if k == "layout")
        layout = -sum(len(v) / shown * math.log(len(v) / shown) for (k, _), v in features.items() if k == "layout")
        blocks = [math.log(len(v)) for (k, _), v in features.items() if k == "block"]
        norm = math.log(max(shown, 2))
        want = 0.9 * (1 - min(1, sum(blocks) / len(blocks) / norm)) + 0.1 * min(1, layout / norm)
        assert got[node][0] == 6 and got[node][1] == pytest.approx(want)


def test_copies_of_an_article_are_kept(spark):
    page = "<nav>m</nav><article><h1>T</h1><p>the same article</p></article>"
    rows = spark.createDataFrame([(i, "http://one.example/x", page) for i in range(20)], "page_id long, url string, html string")
    assert {r["text"] for r in h.extract(rows).collect()} == {"T the same article"}


def test_messy_pages(spark):
    rows = [(1, None, "<p>x"), (1, None, "<p>x"), (None, "http://a/", None), (2, "no scheme", ""), (3, "http://A.B/c", "<div>" + "long " * 50_000)]
    pages = spark.createDataFrame([(*r, "zz", [1], "t", 3) for r in rows], "page_id long, url string, html string, host string, low array<long>, text string, n_chars int")
    got = sorted(((r["page_id"] or 0, r["n_chars"]) for r in h.extract(pages).collect()))
    assert got == [(0, 0), (1, 1), (1, 1), (2, 0), (3, 249_999)]
    assert h.extract(pages.where("false")).count() == 0
    assert [r[0] for r in pages.select(h.host_of(F.col("url"))).collect()] == ["", "", "a", "", "a.b"]
