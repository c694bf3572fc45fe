import html as html_lib
import itertools
import math
import re
import time

import pytest

from ordertide.llm import html_extract as H
from ordertide.llm import html_pages, op9


@pytest.fixture(scope="module")
def model():
    return H.train()


def article_of(page):
    """The supplied pages: what stands in <article>, block by block."""
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = (" ".join(html_lib.unescape(re.sub(r"</?b>|<br>", " ", p)).split()) for p in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(p for p in parts if p)


def test_messages_give_the_exact_marginals(model):
    small = "<nav><a>x y</a></nav><div class=post><p>One two three.<p>Four <b>five</div><footer>&copy; z</footer>"
    nodes = H.flat(H.parse(small))
    at = {id(n): k for k, n in enumerate(nodes)}
    assert len(nodes) < 14
    weight = [0.0] * len(nodes)
    total = 0.0
    for labels in itertools.product((0, 1), repeat=len(nodes)):
        score = 0.0
        for k, n in enumerate(nodes):
            score += labels[k] * (model.bias + sum(model.weights.get(f, 0.0) for f in H.all_features(n)))
            if n.parent is not None:
                score += model.pairs[n.kind][2 * labels[at[id(n.parent)]] + labels[k]]
        total += math.exp(score)
        for k, y in enumerate(labels):
            weight[k] += y * math.exp(score)
    for k, odds in enumerate(H.marginals(nodes, model)):
        assert 1 / (1 + math.exp(-odds)) == pytest.approx(weight[k] / total, rel=1e-6)


def test_held_out_accuracy(model):
    right = n = 0
    for page in html_pages.pages(200, seed=77):
        nodes, label = H.labelled_nodes(page)
        for node, odds in zip(nodes, H.marginals(nodes, model)):
            if node.parts is not None:
                n += 1
                right += (odds > 0) == (label[id(node)] == 1)
    assert n > 3000 and right / n > 0.99


def test_supplied_pages(model, spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    wrong = [r.page_id for r in rows if H.extract(r.html, model) != article_of(r.html)]
    assert not wrong


def text_of(html):
    return [" ".join("".join(n.parts).split()) for n in H.flat(H.parse(html)) if n.parts is not None]


@pytest.mark.parametrize(
    "html,want",
    [
        ("", []),
        ("just text &amp; more", ["just text & more"]),
        ("<p>a<p>b</p>c<div>d", ["a", "b", "c", "d"]),
        ("<p>a <b>b<br>c</b> d</p>", ["a b c d"]),
        ("<script>var a='<p>x</p>'</script>y<style>p{}</style><!-- <p>z --><p>w", ["y", "w"]),
        ('<p title="a > b">c</p><img alt="<p>">', ["c"]),
        ("<ul><li>a<ul><li>b</ul><li>c</ul>", ["a", "b", "c"]),
        ("<table><tr><td>a<td>b<tr><th>c</table>", ["a", "b", "c"]),
        ("a < b and <3 &lt;p&gt; &#x41;&nbsp;&copy", ["a < b and <3 <p> A ©"]),
        ("<p>x<script>never closed", ["x"]),
        ("<p>x<!-- never closed <p>y", ["x"]),
        ("<p>x <a href='unclosed>y</a><p>z", ["x y", "z"]),
        ("<select><option>a</select><button>b</button>c", ["c"]),
        ("<h2>a</h3><p>b", ["a", "b"]),
    ],
)
def test_parser(html, want):
    assert text_of(html) == want


@pytest.mark.parametrize(
    "html,want",
    [
        ("<head><title>x</title><body><article>a<p>b</article>", ["a", "b"]),
        ("<!DOCTYPE html><html><head><meta charset=utf-8><title>x</title><style>p{}</style><script>s</script><div>a</div>", ["a"]),
        ("<html><head><title>x</title>a <b>b</b><p>c", ["a b", "c"]),
        ("<head><title>x</title><link rel=y></head><body><p>a</head>b", ["ab"]),
        ("<p>a<head>b<p>c", ["ab", "c"]),
    ],
)
def test_head_left_open(html, want):
    assert text_of(html) == want


@pytest.mark.parametrize("name", sorted(H.RAW))
def test_letters_that_grow_in_lower_case(name):
    dots = "\u0130" * 50
    assert text_of(f"<p>{dots}</p><{name}>a</{name.upper()} >b<p>c</p>d") == [dots, "b", "c", "d"]


def test_copyright_late_in_a_piece():
    page = "<div>" + "<a href=x>Some link</a> " * 60 + "Example Ltd, 1 Long Road. Copyright Example Ltd</div>"
    assert "text copyright" in H.flat(H.parse(page))[-1].features


def test_long_page(model):
    page = "<article>" + "<p>Some words that go on for a while, and on.</p>" * 20_000 + "<div>" * 5000 + "x"
    assert H.extract(page, model).count("\n") >= 19_999


DEEP = {
    "named blocks": lambda n: "<div class=content>" * n + "x",
    "end tags of nothing": lambda n: "<div>" * n + "</section></b></h2><p>x" * n,
    "open inline elements": lambda n: "<i>" * n + "<div>x</div></b>" * n,
    "inline ends behind a block": lambda n: "<b>" * n + "<div>" + "<i>x</b>" * n,
    "items": lambda n: "<ul>" + "<div>" * n + "<li>x" * n,
}


@pytest.mark.parametrize("name", DEEP)
def test_deep_pages(model, name):
    """Four times the nesting takes about four times as long, not sixteen."""

    def taken(n):
        page, began = DEEP[name](n), time.perf_counter()
        H.extract(page, model)
        return time.perf_counter() - began

    few = min(taken(2000) for _ in range(2))
    assert min(taken(8000) for _ in range(2)) < 9 * max(few, 0.01)


@pytest.mark.parametrize(
    "html,want",
    [
        ("<div>a</section>b</div>c", ["ab", "c"]),
        ("<b>a<div>b</b>c</div>d", ["a", "bc", "d"]),
        ("<ul><li>a<div>b<li>c</ul>d", ["a", "b", "c", "d"]),
        ("<h1>a</h2>b", ["a", "b"]),
        ("<div><i>a<div>b</div></i>c</div></i>d", ["a", "b", "c", "d"]),
        ("<table><tr><td>a<td><div>b<table><tr><td>c</table>d<tr><td>e</table>", ["a", "b", "c", "d", "e"]),
    ],
)
def test_odd_ends(html, want):
    assert text_of(html) == want


def test_frames(spark, model):
    rows = [(1, "u", None, "old"), (2, None, "", "old"), (3, "v", "<nav><a href=x>Home</a></nav>", "old")] + [(9, "w", "<article><h1>Title here</h1><p>First sentence is here, and it goes on.</p></article>", "old")] * 2
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    out = H.extract_pages(df, model)
    assert out.columns == ["page_id", "url", "text"]
    got = sorted((r.page_id, r.text) for r in out.collect())
    assert got == [(1, ""), (2, ""), (3, "")] + [(9, "Title here\nFirst sentence is here, and it goes on.")] * 2
    assert H.extract_pages(df.limit(0), model).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    want = {(r.page_id, r.url, article_of(r.html), len(article_of(r.html))) for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    assert {tuple(r) for r in op9.query(spark, sf).collect()} == want
