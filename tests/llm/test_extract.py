"""Main text of pages: layouts by hand, the ratios, and odd markup."""

from __future__ import annotations

import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowcaster.llm import op11_extract as op11

from .fixture import CLASH, collected

LONG = "This is a sentence of the article, with some words; it goes on for a while, and ends here."
MORE = "Another paragraph follows: it has commas, colons, and a few more words than the others do."


def paragraphs(n=4):
    return [f"{LONG if i % 2 else MORE} Number {i}." for i in range(n)]


def page(before="", inside="", after="", wrap=("<article>", "</article>"), text=None):
    body = "".join(f"<p>{t}</p>" for t in (paragraphs() if text is None else text))
    return f"<!DOCTYPE html><html><head><title>Title, of the page.</title></head><body>{before}{wrap[0]}<h1>Title, of the page.</h1>{body}{inside}{wrap[1]}{after}</body></html>"


WANT = "\n".join(["Title, of the page.", *paragraphs()])

NOISE = [
    "<nav><ul><li><a href='/a'>One</a></li><li><a href='/b'>Two, or three.</a></li></ul></nav>",
    "<header><h2>The Site, a paper.</h2><p>Since 1900, every day, all the news there is, for everybody.</p></header>",
    f"<aside><h3>Sidebar</h3><p>{LONG} {LONG}</p></aside>",
    f'<div class="cookie-notice"><p>{LONG} We use cookies, as all do.</p></div>',
    f'<div class="ad">{LONG} {MORE} {LONG}</div>',
    f'<div id="sidebarLeft"><p>{LONG}</p></div>',
    f'<form action="/s"><label>Search, please:</label><input value="x"><p>{LONG}</p><textarea>{LONG}</textarea></form>',
    f'<script>var a = "<p>{LONG}</p>"; if (a < 1 && b > 2) {{}}</script><style>p {{ margin: 0 }} /* {LONG} */</style>',
    f"<!-- <p>{LONG}</p> --><noscript><p>{LONG}</p></noscript><template><p>{LONG}</p></template>",
    f'<section id="comments"><h2>3 comments</h2><article class="comment"><p>{LONG} {LONG}</p></article><div class="comment"><p>{MORE}</p></div></section>',
    f'<div role="complementary"><p>{LONG}</p></div><div hidden><p>{LONG}</p></div><div style="display: none"><p>{LONG}</p></div>',
    f"<footer><p>{LONG} &copy; 2020</p></footer>",
    f'<div class="related-posts"><h3>Read on</h3><p>{MORE}</p></div><div class="newsletter signup">{LONG}</div>',
]


@pytest.mark.parametrize("noise", NOISE)
@pytest.mark.parametrize("wrap", [("<article>", "</article>"), ("<main>", "</main>"), ('<div id="content">', "</div>"), ("<div>", "</div>")])
def test_noise_goes_and_the_article_stays(noise, wrap):
    assert op11.main_text(page(before=noise, wrap=wrap)) == WANT
    assert op11.main_text(page(after=noise, wrap=wrap)) == WANT
    assert op11.main_text(page(before=NOISE[0] + NOISE[3], after=noise + NOISE[-2], wrap=wrap)) == WANT
    if "header" not in noise:
        assert op11.main_text(page(inside=noise, wrap=wrap)) == WANT


@pytest.mark.parametrize("wrap", [("<div>", "</div>"), ("<div class='a b'><div>", "</div></div>")])
def test_unnamed_noise_goes_by_the_ratios(wrap):
    links = "<div><ul>" + "".join(f"<li><a href='/{i}'>Link number {i}</a></li>" for i in range(20)) + "</ul></div>"
    short = "<table><tr><td>Home</td><td>News</td></tr><tr><td>Sport</td><td>Films</td></tr></table>"
    assert op11.main_text(page(before=links + short, after=links, wrap=wrap)) == WANT


def test_short_blocks_of_an_article_stay():
    inside = "<h2>Part</h2><ul><li>Apples</li><li>Pears</li></ul><p>Ah.</p><blockquote>So it is</blockquote><table><tr><td>a</td><td>1</td></tr></table>"
    assert op11.main_text(page(inside=inside, before=NOISE[0])) == WANT + "\nPart\nApples\nPears\nAh.\nSo it is\na\n1"
    assert op11.main_text("<nav>Many, many words, in a menu; more than below.</nav><article><p>One</p></article>") == "One"
    assert op11.main_text("<article><p><a href='/x'>Only a link</a></p></article>") == "Only a link"


@pytest.mark.parametrize(
    "inside,want",
    [
        ("<p><b>Bold<br><p>next  one\n two&nbsp;&nbsp;three</p>", "Bold\nnext one two three"),
        ("<p>a<b>b</b>c <i>d</i><a href='x'> e</a></p>", "abc d e"),
        ("<p>&lt;p&gt; &amp;amp; &#65;&#x42;&eacute; &am &amp x &unknown; &#xD800;</p>", "<p> &amp; ABé &am & x &unknown; �"),
        ("<div>loose<p>in</p>after</div>", "loose\nin\nafter"),
        ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "a\nb\nc\nd"),
        ("<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"),
        ("<dl><dt>t<dd>d<dt>u</dl>", "t\nd\nu"),
        ('<p title="a > b" data-x=\'<p>\'>q</p>', "q"),
        ("<p>1 < 2 and 3 > 2 <3</p>", "1 < 2 and 3 > 2 <3"),
        ("<p>x<!-- > <p>no</p> -->y<!-->z</p>", "xyz"),
        ("<p>s<script>'</p><p>'</script>t</p></b></p></span>", "st"),
        ('<p class="x>one</p><p>two</p>', "one\ntwo"),
        ("<p>one</p><p>two <a hre", "one\ntwo"),
        ("<p>one</p><!-- <p>two</p>", "one"),
        ("<P>up</P><Script>no</sCRIPT ><p>down</p>", "up\ndown"),
        ("<p>no<button>Share</button>button</p>", "no button"),
        ("", ""),
    ],
)
def test_markup(inside, want):
    assert op11.main_text(f"<html><body><article>{inside}") == want


def test_text_without_markup():
    assert op11.main_text("just  words") == "just words"
    assert op11.main_text(None) == "" and op11.main_text("") == "" and op11.main_text("<p> </p>") == ""


def test_classes_that_lack_or_lay_out_what_they_name():
    for name in ("no-sidebar", "has-comments", "comments-open", "sidebar-layout", "without ads"):
        assert op11.main_text(page(wrap=(f'<div class="{name}">', "</div>"))) == WANT


def test_smoothing_and_ratios():
    assert op11.smoothed(np.array([4.0, 0.0, 8.0]), (0.25, 0.5, 0.25)).tolist() == [3.0, 3.0, 6.0]
    blocks = op11.Page("<body><p>ab, c</p><p>d<a>ef</a></p><div class='x2 y'>g</div><div class='x3 y'>h</div>").blocks
    assert [(b.text, b.linked) for b in blocks] == [("ab, c", 0), ("def", 2), ("g", 0), ("h", 0)]
    assert blocks[0].path == blocks[1].path != blocks[2].path == blocks[3].path


def test_any_markup_ends_quickly():
    r = random.Random(2)
    parts = ["<", ">", "</p>", "<p>", "<b", '"', "'", "<!--", "-->", "<script>", "</script>", "<td>", "<li>", "&", "x y", "</", "<article>", "=", "<a href=", "<div>", "</div>"]
    for _ in range(3000):
        op11.main_text("".join(r.choice(parts) for _ in range(r.randrange(60))))
    started = time.time()
    for part in ("<div>", "<b>", "<p><b>", "<x ", "<!--", "<li><ul>", "<div><p>a</div>", "</p>", "&amp;", "a. ", "<a b='>", '<a "'):
        op11.main_text(part * 40_000)
    assert time.time() - started < 60


def test_extract(spark):
    data = [(i, f"u{i}", page(before=NOISE[i % len(NOISE)])) for i in range(30)]
    data += [(30, None, None), (31, "u", ""), (None, "v", page()), (32, "w", page(text=["Long. " * 300_000])), data[3], data[3]]
    df = spark.createDataFrame(data, "page_id long, url string, html string").repartition(4)
    clash = df.withColumns({c: F.lit(c) for c in [*CLASH, "text", "n_chars"] if c != "url"})
    want = [(i, u, op11.main_text(h), len(op11.main_text(h))) for i, u, h in data]
    assert collected(op11.extract(clash)) == sorted(want, key=repr)
    assert want[0][2] == WANT and want[33][3] == 1_800_000 + len("Title, of the page.")
    assert op11.extract(df.limit(0)).collect() == []
