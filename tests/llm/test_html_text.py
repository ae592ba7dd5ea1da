import html
import re
import time

import pytest

from quantloom.llm import html_text

PAGE = """<html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="home">
<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>About us</a></li><li><a href=/c>Contact</a></li></ul></nav>
<div class="cookie-notice"><p>We use cookies to serve you. Accept them all, please.</p></div>
<article><h1>A &amp; B</h1><p>First   paragraph,
with <b>bold</b> text &lt;here&gt; and a <a href=/x>link</a>. It goes on for a while, so that it is prose.<p>Second one&nbsp;too, with a<br>break. More words follow here, as they do in articles.
<div class="ad"><p>Buy now! Cheap things, only today.</p></div><!-- <p>no</p> --><p>Third paragraph, the last of them. It ends the text as it should.</article>
<section class="comments"><h3>Comments</h3><p>I like it. Great read, thanks!</p></section>
<footer>&copy; us &middot; All rights reserved. Imprint.</footer></body></html>"""
TEXT = "A & B\n\nFirst paragraph, with bold text <here> and a link. It goes on for a while, so that it is prose.\n\nSecond one too, with a break. More words follow here, as they do in articles.\n\nThird paragraph, the last of them. It ends the text as it should."


def test_a_page_with_everything():
    assert html_text.extract([PAGE], html_text.trained()) == [TEXT]


def test_held_out_pages_of_the_rule():
    trees, wrong = html_text.trained(), 0
    for page in html_text.training_pages(60, seed=123):
        nodes = html_text.nodes_of(page)
        kept = html_text.decode(nodes, trees.log_odds(html_text.features(nodes)))
        wrong += [n for n in nodes if n.text and n.mark] != [n for n, ok in zip(nodes, kept) if ok and n.text]
    assert wrong <= 4


def test_real_pages(spark):
    rows = html_text.op7(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).collect()
    pages = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()}
    wrong = 0
    for r in rows:
        inside = re.search(r"<article>(.*?)</article>", pages[r.page_id], re.S)[1]
        blocks = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<(?!br)[^>]+>", "", b).replace("<br>", " "))).strip() for b in re.split(r"</?(?:p|h1)>", inside)]
        wrong += r.text != "\n\n".join(b for b in blocks if b)
        assert r.n_chars == len(r.text)
    assert len(rows) == len(pages) and wrong <= 0.01 * len(rows)


def test_decoding_is_hierarchical():
    import numpy as np

    nodes = html_text.nodes_of("<div><p>a</p><p>b</p></div><div><p>c</p></div>")
    rng = np.random.default_rng(0)
    for _ in range(50):
        kept = html_text.decode(nodes, rng.normal(size=len(nodes)) * 3)
        assert all(not ok or n.parent is None or kept[nodes.index(n.parent)] for n, ok in zip(nodes, kept))


BODY = "<p>A first paragraph of prose, long enough to be one. It has two sentences.</p>{}<p>A last paragraph of prose, with some words in it. It ends the text here.</p>"
FIRST, LAST = "A first paragraph of prose, long enough to be one. It has two sentences.", "A last paragraph of prose, with some words in it. It ends the text here."


@pytest.mark.parametrize("inside,text", [
    ("<p title=it's>One more paragraph comes here, said plainly. It stays.</p>", "One more paragraph comes here, said plainly. It stays."),
    ("<p data-x=5'>One more paragraph comes here, said plainly. It stays.</p>", "One more paragraph comes here, said plainly. It stays."),
    ('<p "a>One more paragraph comes here, said plainly. It stays.</p>', "One more paragraph comes here, said plainly. It stays."),
    ('<p title = "a > b" lang=en>One more paragraph comes here, said plainly. It stays.</p>', "One more paragraph comes here, said plainly. It stays."),
    ("<p>A formula <math><mi>x</mi> = <mn>2</mn></math> stands in the prose here, as it does.</p>", "A formula x = 2 stands in the prose here, as it does."),
    ("<p>A drawing <svg><g><svg><path d='M0'/></svg></g><title/></svg> stands in the prose here, as it does.</p>", "A drawing stands in the prose here, as it does."),
    ("<p>A template <template>no <template>no</template> no</template> stands in the prose here, as it does.</p>", "A template stands in the prose here, as it does."),
    ("<p>A button <button>that never ends stands in the prose here, as it does.</p>", "A button that never ends stands in the prose here, as it does."),
    ("<p>A choice <select><option>no<option>no</select> stands in the prose here, as it does.</p>", "A choice stands in the prose here, as it does."),
    ("<!--><p>One more paragraph comes here, said plainly. It stays.</p>", "One more paragraph comes here, said plainly. It stays."),
    ("<p>One more paragraph </3 comes here, > said plainly. It stays.</p>", "One more paragraph said plainly. It stays."),
])
def test_markup_out_of_the_ordinary_loses_no_text(inside, text):
    page = f"<html><body><article><h1>Title of this page</h1>{BODY.format(inside)}</article></body></html>"
    assert html_text.extract([page], html_text.trained()) == ["\n\n".join(["Title of this page", FIRST, text, LAST])]


def test_cells_left_open_and_ends_that_belong_elsewhere():
    shape = lambda n: (n.tag, "".join(t[0] if isinstance(t, tuple) else "" for t in n.text), [shape(c) for c in n.text if isinstance(c, html_text.Node)])
    got = shape(html_text.parse("<div><table><tr><td>a</div>b<td>c<tr><td><ul><li>d<li>e<ul><li>f</ul>g</table>h</div>"))
    assert got == ("html", "", [("div", "h", [("table", "", [("tr", "", [("td", "ab", []), ("td", "c", [])]), ("tr", "", [("td", "", [("ul", "", [("li", "d", []), ("li", "eg", [("ul", "", [("li", "f", [])])])])])])])])])


@pytest.mark.parametrize("piece", ["<div>", "<li><div>", "</div>", "<button>", "<template>", "<td>", "<p x=\"", "<a", "<!--", "<p title='", "=' ", "<x =", "<ul><li>", "<table>", "&amp"])
def test_a_megabyte_of_anything_is_read_in_linear_time(piece):
    page = piece * (1_000_000 // len(piece))
    began = time.process_time()
    html_text.extract([page], html_text.trained())
    assert time.process_time() - began < 20


def test_edges(spark):
    pages = [None, "", "   ", "plain text only", "<p>cut off <b", "<div><div><div>", "</p></div>", "<p>" + "long text. " * 20_000 + "</p>", "<!-- x", "<script>", "&#0;&bogus;"]
    rows = [(i, None, p, "t") for i, p in enumerate(pages + ["<p>same</p>"] * 2)]
    got = html_text.op7(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).orderBy("page_id").collect()
    assert len(got) == len(rows) and got[0].text == got[1].text == "" and all(r.text is not None for r in got)
    assert got[-1].text == got[-2].text
    assert html_text.op7(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
