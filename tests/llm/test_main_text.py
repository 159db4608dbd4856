"""Main texts of pages: every page of the table, planted pages, and what is broken or missing."""

import html
import re
import time

import pytest

from lodestrand.llm import main_text, queries

PAGE = "<html><head><title>T</title><style>p{}</style></head><body>%s<div id='wrap'>%s</div>%s</body></html>"
BEFORE = """<header><h1>The Site</h1></header><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class="cookie-notice">We use cookies, as you know. Accept?</div>"""
AFTER = """<aside><p>Most read, this week.</p></aside><div class='sidebar'><p>Other news, here.</p></div><form><label>Mail</label><input name=x><p>Subscribe, please.</p></form>
<section id="comments"><h3>Comments</h3><div class=comment><p>What a good article, I think. Really, thank you.</p></div></section><footer><p>Copyright, all rights.</p></footer><script>var a = "<p>no</p>";</script>"""
BODY = "<p>First paragraph, with <b>bold</b> words &amp; a <a href='/x'>link</a>.</p>\n<p>Second\n  paragraph&nbsp;here, longer than the first one, by far. It goes on.</p><ul><li>item one<li>item two</ul><blockquote>Quoted, too.</blockquote><p>End.</p>"
TEXT = "First paragraph, with bold words & a link. Second paragraph here, longer than the first one, by far. It goes on. item one item two Quoted, too. End."


def in_article(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1]
    blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)[^>]*>", inner))
    return " ".join(b for b in blocks if b)


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.1"])
def test_every_page(spark, sf):
    pages = {r["page_id"]: r for r in spark.read.parquet(f"/root/testdata/{sf}/pages.parquet").collect()}
    found = queries.op13_main_text(spark, f"/root/testdata/{sf}").collect()
    assert len(found) == len(pages)
    for r in found:
        assert r["text"] == in_article(pages[r["page_id"]]["html"])
        assert (r["url"], r["n_chars"]) == (pages[r["page_id"]]["url"], len(r["text"]))


@pytest.mark.parametrize("open_tag", ["<article>", "<div class='post-content'>", "<main>", "<section>"])
def test_planted(open_tag):
    close = f"</{re.match(r'<([a-z]+)', open_tag)[1]}>"
    assert main_text.main_text(PAGE % (BEFORE, open_tag + "<h1>Head line</h1>" + BODY + close, AFTER)) == "Head line " + TEXT


def test_notices_inside_the_article():
    inner = f"<article><h2>Head</h2>{BODY}<div class='ad'>Buy this, now.</div><p>More text, as before.</p><div class='share'><a href='#'>Tell</a></div><div class='comments'><p>I agree, fully.</p></div></article>"
    assert main_text.main_text(PAGE % (BEFORE, inner, AFTER)) == f"Head {TEXT} More text, as before."


def test_without_containers():
    assert main_text.main_text(f"<h1>Head</h1>{BODY}") == f"Head {TEXT}"


@pytest.mark.parametrize(("page", "text"), [("", ""), ("plain &lt;text&gt;", "plain <text>"), ("<p>un<i>closed", "unclosed"), ("<nav>only menu</nav>", ""), ("<article><p>a<p>b<br>c</article>", "a b c"), ("a<!-- x -->b<script>never closed", "ab"), ("<p>1 < 2 &am &#x41;&nbsp;z</p>", "1 < 2 &am A z"), ("<article> \n </article>", "")])
def test_small(page, text):
    assert main_text.main_text(page) == text


@pytest.mark.parametrize("page", ["<" * 200_000, "<a " * 100_000, '<a "' * 100_000, "<!--" * 100_000, "<style" * 100_000, "<div>" * 100_000 + "x", "<p>" * 100_000, "</b>" * 100_000, "<p>" + "word " * 1_000_000])
def test_time_grows_with_the_page(page):
    began = time.perf_counter()
    main_text.main_text(page)
    assert time.perf_counter() - began < 10


def test_content_paths():
    chosen = main_text.content_paths([1, 1, 1, 2, 2, 2, 3, 3, 3], *main_text.np.array([[9, 8, 7, 400, 20, 300, 5, 5, 5], [0, 0, 0, 9, 1, 7, 0, 0, 0]], float))
    assert 2 in chosen and 3 not in chosen


def test_rows(spark):
    rows = [(1, "u", None, "t", 3), (None, None, "<p>x.</p>", "t", 3), (1, "u", None, "t", 3), (2, "v", "", None, None)]
    found = main_text.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int"))
    assert found.dtypes == [("page_id", "bigint"), ("url", "string"), ("text", "string"), ("n_chars", "bigint")]
    assert sorted(map(tuple, found.collect()), key=repr) == sorted([(1, "u", "", 0), (None, None, "x.", 2), (1, "u", "", 0), (2, "v", "", 0)], key=repr)
    assert main_text.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
