"""Main text of pages: what is labelled, and how text is put together."""

from __future__ import annotations

import time

import numpy as np
import pytest
from hand_pages import PAGES, labelled

from stowage.llm import pages

SCHEMA = "page_id long, url string, html string"
LONG = "The harbour was quiet that morning, and nobody spoke of the storm that had passed. "


@pytest.fixture(scope="module")
def net():
    return pages.kept()


def texts(spark, net, rows):
    df = spark.createDataFrame([(i, f"http://x/{i}", h) for i, h in enumerate(rows)], SCHEMA)
    out = {r.page_id: r for r in pages.main_text(df, net).collect()}
    assert len(out) == len(rows)
    assert all(r.n_chars == len(r.text) and r.url == f"http://x/{i}" for i, r in out.items())
    return [out[i].text for i in range(len(rows))]


def test_generated_pages_that_were_not_trained_on(net):
    rng, right, total = np.random.default_rng(999), 0, 0
    for _ in range(150):
        page, main = pages.sample_page(rng)
        own, left = pages.blocks(page), list(main)
        truth = []
        for b in own:
            truth.append(bool(left) and b.text == left[0])
            if truth[-1]:
                left.pop(0)
        got = net.label([own])[0]
        right += int((got == np.array(truth, bool)).sum())
        total += len(own)
    assert right / total > 0.97


def test_pages_labelled_by_hand(net):
    """Characters of main text in pages that nothing here was generated or trained from."""
    truth = got = both = 0
    for page, main in map(labelled, PAGES.values()):
        own = pages.blocks(page)
        chosen = [b.text for b, yes in zip(own, net.label([own])[0], strict=True) if yes]
        main = [pages.blocks(f"<p>{t}")[0].text for t in main]
        assert set(main) <= {b.text for b in own}
        truth, got = truth + sum(map(len, main)), got + sum(map(len, chosen))
        both += sum(len(t) for t in chosen if t in main)
    assert both / got > 0.95
    assert both / truth > 0.92


def test_articles_of_the_pages_table(spark, net):
    """Its pages have one article element each; the labeller does not know that."""
    rows = [(r.page_id, r.html) for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()]
    same = 0
    for _, page in rows:
        inside = page[page.find("<article>") : page.find("</article>")] if "<article>" in page else ""
        own = pages.blocks(page)
        same += [b.text for b, yes in zip(own, net.label([own])[0], strict=True) if yes] == [b.text for b in pages.blocks(inside)]
    assert same / len(rows) > 0.99


MEGABYTE = {
    "tags without end": "<a " * 350_000,
    "nested elements": "<div>" * 200_000,
    "unclosed inline elements": "<b class=x>" * 90_000,
    "open value": '<a x=">" ' * 115_000,
    "stray end tags": "<div>" * 1000 + "</i>" * 200_000,
    "items under many elements": "<ul>" + "<div>" * 5000 + "<li>" * 200_000,
    "one inline element above": "<i><div>" + "<b></i>" * 140_000,
    "bare signs": "<" * 1_000_000,
    "comments without end": "<!-- " * 200_000,
    "declarations": "<! " * 330_000,
    "raw text without end": "<script>" * 125_000,
}


@pytest.mark.parametrize("name", MEGABYTE)
def test_broken_pages_take_time_in_proportion(name):
    """A megabyte of anything takes seconds, and twice as much takes twice as long."""
    page = MEGABYTE[name]
    began = time.process_time()
    pages.blocks(page[: len(page) // 2])
    half = time.process_time() - began
    pages.blocks(page)
    whole = time.process_time() - began - half
    assert whole < 12
    assert whole < 4 * half + 0.5


def test_memory_of_a_page_with_very_many_blocks(net):
    """Blocks are turned into vectors a thousand at a time."""
    own = pages.blocks("<article>" + "<p>Some words, and a few more.</p>" * 20_000)
    assert len(own) == 20_000
    assert net.label([own])[0].mean() > 0.99


def test_values_may_hold_signs():
    assert [b.text for b in pages.blocks("<p title='a > b'>x<p data-x=\"</p>\">y <a title=it's>z's</a>")] == ["x", "y z's"]


def test_article_among_furniture(spark, net):
    page = f"""<!DOCTYPE html><html><head><title>News</title><style>p{{x:y}}</style><script>var a = "<p>no</p>";</script></head><body>
    <header class="site-header"><a href="/">Daily</a></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">World</a></ul></nav>
    <div class="cookie-notice"><p>We use cookies.</p><button>Accept</button></div>
    <article><h1>A &amp; B</h1><p>{LONG}</p><p>Second &eacute; <b>bold</b> <a href="/x">link</a>,&nbsp;end.<p>{LONG}Third</p></article>
    <aside class="sidebar"><h3>Popular</h3><ul><li><a href="/1">One</a></li></ul></aside>
    <div class="comments"><h3>Comments</h3><div class="comment"><p>{LONG}First!</p></div></div>
    <form action="/s"><label>Search</label><input name=q><select><option>a<option>b</select></form>
    <footer>© 2024 Daily. All rights reserved.</footer></body></html>"""
    own = LONG.strip()
    assert texts(spark, net, [page]) == [f"A & B\n\n{own}\n\nSecond é bold link, end.\n\n{own} Third"]


def test_edge_cases(spark, net):
    assert texts(spark, net, [None, "", "   \n", "<!-- only -->", "<script>x()</script>"]) == [""] * 5
    odd = [f"<article><p>{LONG}<p>1 < 2 & 3 > 2</article>", f"</div></p><article><p>{LONG}</p></p></article></article>", f"<article><p>{LONG}<!-- <p>no</p>", "<" * 1000, "<div " * 1000, "<article>" * 500 + f"<p>{LONG}"]
    got = texts(spark, net, odd)
    assert "1 < 2 & 3 > 2" in got[0]
    assert LONG.strip() in got[1]
    assert "no" not in got[2].split()


def test_very_long_page(spark, net):
    page = "<article>" + f"<p>{LONG}</p>" * 5000 + "</article>"
    assert texts(spark, net, [page])[0].count(LONG.strip()) == 5000


def test_blocks():
    cut = pages.blocks("<div>a<br>b <i>c</i>d<p>e<p>f<ul><li>g<li>h</ul>i</div>j")
    assert [b.text for b in cut] == ["a b cd", "e", "f", "g", "h", "i", "j"]
    assert pages.blocks("<p>&lt;b&gt; &#x41;&#66; &nope; x \n y</p>")[0].text == "<b> AB &nope; x y"


def test_extra_columns_and_no_rows(spark, net):
    df = spark.createDataFrame([(1, "u", f"<article><p>{LONG}</p></article>")], SCHEMA)
    assert pages.main_text(df.selectExpr("*", "1 as text", "2 as n_chars"), net).first().text == LONG.strip()
    assert pages.main_text(df.where("false"), net).count() == 0


def test_gradient_is_the_slope_of_the_loss():
    rng = np.random.default_rng(0)
    n = pages.PATH + pages.WORDS + pages.SIZES
    x, mask, y = rng.standard_normal((3, 5, n)).astype(np.float32), np.ones((3, 5), bool), rng.integers(0, 2, (3, 5)).astype(np.float32)
    mask[0, 3:] = False
    net = pages.Labeller()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}

    def loss():
        p = net.forward(x, mask)
        return -(np.log(np.where(y > 0, p, 1 - p)) * mask).sum() / mask.sum()

    g = net.gradient(x, mask, y)
    for name in ("wf", "rb", "cf", "o", "s"):
        flat = net.p[name].reshape(-1)
        at = int(np.abs(g[name].reshape(-1)).argmax())
        old = flat[at]
        flat[at] = old + 1e-3
        up = loss()
        flat[at] = old - 1e-3
        down = loss()
        flat[at] = old
        assert (up - down) / 2e-3 == pytest.approx(g[name].reshape(-1)[at], rel=0.05)
