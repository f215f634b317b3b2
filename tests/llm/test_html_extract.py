import random

import numpy as np

from assayforge.llm import html_extract as hx


def truth(page):
    nodes = hx.elements(hx.parse(page))
    keep = np.array([True] + [" data-keep" in n.attributes for n in nodes[1:]])
    return "\n".join(hx.blocks(nodes, keep))


def test_held_out_pages():
    rng = random.Random(1234)
    pages = [hx.example(rng) for _ in range(150)]
    same = sum(truth(p) == hx.main_text(p.replace(" data-keep", "")) for p in pages)
    assert same >= 0.9 * len(pages)


def test_article_of_a_page():
    page = (
        "<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t='</p>';</script></head><body><nav><ul><li><a href=/a>Menu</a></li></ul></nav>"
        '<div class="ad">Buy this now.</div><article><h1>A &amp; B</h1><p>First  para\ngraph with some words, and more.<br>next<p>Second one&#8212;longer text here.</article>'
        '<section class="comments"><p>Nice post, thanks.</p></section><aside class="sidebar"><p>Other things</p></aside><form><label>Name</label></form><footer>&copy; us</footer></body></html>'
    )
    assert hx.main_text(page) == "A & B\nFirst para graph with some words, and more. next\nSecond one—longer text here."


def test_unclosed_and_odd_markup():
    for page in ("", "   ", "plain text only", "<", "<p", "<!-- never closed", "<article><p>Some words in a cut page, that goes on.", "<script>x", "</p></div>", "<a href='x", "<b><i></b></i>", "<![CDATA[x", "&#0;&#xFFFFFFFF;&bogus;"):
        assert isinstance(hx.main_text(page), str)
    assert hx.main_text("<html><body><article><p>Some words in a cut page, that goes on.") == "Some words in a cut page, that goes on."


def test_quotes_and_pages_without_tags():
    body = "<article><p title=don't>First one, with some words.</p><p>Second one, that's longer.</p></article>"
    want = "First one, with some words.\nSecond one, that's longer."
    assert hx.main_text(body) == want
    assert hx.main_text(body.replace("title=don't", "title='a > b'")) == want
    assert hx.main_text(body.replace("title=don't", 'data-x = "a > b" class=it"s')) == want
    assert hx.main_text(body.replace("title=don't", 'title="never closed')) == want
    assert hx.main_text("plain  text &amp; no\ntags") == "plain text & no tags"
    assert hx.main_text("plain text<br>and a break") == "plain text and a break"


def test_decoding_is_closed_under_parents():
    rng, noise = random.Random(3), np.random.default_rng(3)
    for _ in range(20):
        nodes = hx.elements(hx.parse(hx.example(rng)))
        odds = noise.normal(size=len(nodes))
        keep = hx.decode(nodes, odds)
        assert all(keep[n.parent.number] for n in nodes[1:] if keep[n.number])


def test_table(spark):
    schema = "page_id long, url string, html string, text string, n_chars int"
    rows = [(1, "u", None, "x", 1), (2, None, "", "x", 1), (3, "u", "<article><p>" + "word " * 50000 + ".</p></article>", "x", 1), (3, "u", "<article><p>Some words, here.</p></article>", "x", 1), (None, "u", "<p>Just one paragraph, of some words.</p>", "x", 1)]
    got = hx.extract(spark.createDataFrame(rows, schema)).collect()
    size = {(r["page_id"], r["url"]): r["n_chars"] for r in got}
    assert len(got) == 5 and size[1, "u"] == 0 and size[2, None] == 0
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert max(size.values()) <= 250_001 and max(r["n_chars"] for r in got) == len(("word " * 50000 + ".").strip())
    assert hx.extract(spark.createDataFrame([], schema)).count() == 0
