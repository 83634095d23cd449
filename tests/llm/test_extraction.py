import itertools
import time

import numpy as np
import pytest

from sievemark.llm import common, extraction

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def model():
    return extraction.trained()


def test_marginals_match_enumeration():
    rng = np.random.default_rng(0)
    model = extraction.Model()
    model.weights[:] = rng.normal(size=extraction.FEATURES)
    model.ties[:] = rng.normal(size=model.ties.shape)
    pages = [extraction.Page(s) for s in ("<div><p>a<p>b</div><ul><li>c<li>d</ul>", "<p>x", "<table><tr><td>y<td>z</table>")]
    forest = extraction.Forest(pages)
    got, pair, z = model.marginals(forest)
    n = len(forest.parent)
    field = np.bincount(forest.rows, model.weights[forest.columns], n)
    total, single = 0.0, np.zeros(n)
    for y in itertools.product((0, 1), repeat=n):
        y = np.array(y)
        inner = forest.parent >= 0
        w = np.exp(field @ y + model.ties[forest.kinds[inner], y[forest.parent[inner]], y[inner]].sum())
        total += w
        single += w * y
    assert np.allclose(got, single / total) and np.isclose(z, np.log(total))
    assert np.allclose(pair[forest.parent >= 0].sum(1)[:, 1], got[forest.parent >= 0])


def test_held_out_layouts(model):
    pages = [extraction.Page(p) for p in extraction.labelled_pages(200, seed=99)]
    forest = extraction.Forest(pages)
    keep = model.marginals(forest)[0] >= extraction.KEEP
    right = [keep[s + i] == p.label[i] for p, s in zip(pages, forest.starts, strict=True) for i, _, _ in p.blocks]
    assert np.mean(right) > 0.99


def test_markup(model):
    page = (
        "<html><head><title>t</title><style>p{}</style><script>var a='<p>no</p>'</script></head><body><nav><ul><li>"
        "<a href=/>Home</a><li><a href=/b>B</a></ul></nav><article><h1>A &amp; B</h1><p><b>One\n two<br>three<br><p>Fo"
        "ur <a href='/x>y'>li</a>nk &eacute;</p><!-- <p>no</p> --></article><div class='ad'>Buy</div>"
        "<section id=comments><p>Nice one</p></section><footer>&copy; me</footer></body></html>"
    )
    assert model.texts([page]) == ["A & B\n\nOne two three\n\nFour link é"]
    assert model.texts(["", "<", "<p", "<!--", "<script>x"])[0] == ""


def test_nothing_swallows_the_rest(model):
    """No element but script, style, textarea and title takes the text behind it along."""
    rest = "<p>The second paragraph of this article is just as long as the first one.</p>"
    for odd in (
        "<svg class=icon />", "<svg><path d='M0'/><g><use href='#a'/></g></svg>", "<svg><title>Icon</title>", "<iframe src=/x>", "<iframe src=/x />",
        "<datalist id=d><option value=a><option value=b></datalist>", "<select><option value=a><option value=b></select>",
        "<template><template></template><i></i></template>", "<noscript>", "<option value=a>",
    ):
        page = f"<body><article><p>The first paragraph of this article has a number of words.</p>{odd}{rest}</article></body>"
        assert "The second paragraph of this article is just as long as the first one." in model.texts([page])[0], odd
    inside = lambda source: [text for _, text, _ in extraction.Page(source).blocks]
    assert inside("<p>a <svg/>b <svg><path/></svg>c</p><p>d") == ["a b c", "d"]
    assert inside("<noscript><p>read me</p></noscript>") == ["read me"]
    assert inside("<p>pick <select><optgroup><option>x<option>y<optgroup><option>z</select> now</p>") == ["pick", "x y z", "now"]
    nested = extraction.Page("<div><template>a<template>b</template>c</template>d</div>")
    assert [(nested.tag[i], text) for i, text, _ in nested.blocks] == [("template", "a"), ("template", "b"), ("template", "c"), ("div", "d")]


def test_bare_pages(model):
    say = "A sentence of some length that stands on a page of its own. "
    assert model.texts([f"<p>{say}</p>", say, f"<body>{say}</body>", f"<html><body><p>{say}</p><p>{say}</p></body></html>"]) == [
        say.strip(), say.strip(), say.strip(), f"{say.strip()}\n\n{say.strip()}"
    ]


@pytest.mark.parametrize("menu", ["<nav><ul><li><a href=/>Home</a><li><a href=/b>About us</a></ul></nav>", "<div class=menu><a href=/>Home</a> <a href=/b>About us</a></div>"])
def test_articles_without_a_telling_container(model, menu):
    """Layouts written by hand, of another make than the generated ones."""
    say = "The committee met on Tuesday to discuss the new rules for the harbour, and no one left early."
    more = "A second vote is planned for the spring; until then the old fees stay as they are for every boat."
    foot = "<footer>&copy; 2020 Harbour News</footer>"
    for body, want in (
        (f"<h1>Harbour fees</h1><p>{say}</p><p>{more}</p>", ["Harbour fees", say, more]),
        (f"{say} {more} {say}", [f"{say} {more} {say}"]),
        (f"<div><h1>Harbour fees</h1><p>{say}</p><p>{more}</p></div>", ["Harbour fees", say, more]),
        (f"<div>{say}<br><br>{more}</div>", [f"{say} {more}"]),
        (f"<div><div><p>{say}</p><p>{more}</p></div></div>", [say, more]),
        (f"<article><p>{say}</p><p><a href=/x>{more}</a></p><button>Share</button><noscript>Please enable JavaScript.</noscript><p>{say}</p></article>", [say, more, say]),
    ):
        assert model.texts([f"<html><head><title>t</title></head><body>{menu}{body}{foot}</body></html>"]) == ["\n\n".join(want)], body
    table = f"<body><table><tr><td><ul><li><a href=/>Home</a><li><a href=/b>About us</a></ul></td><td><h1>Harbour fees</h1><p>{say}</p><p>{more}</p></td></tr></table></body>"
    assert model.texts([table]) == [f"Harbour fees\n\n{say}\n\n{more}"]


@pytest.mark.parametrize(
    "broken", ["<a ", '<p title="', "<!", "<a<", "</title", """<a "'>""", "<a '\">", """<p title='"'>"""]
)
def test_broken_markup_is_read_in_linear_time(broken):
    source = broken * (1_000_000 // len(broken))
    for end in ("", '">"', ">", "'\""):
        began = time.perf_counter()
        extraction.Page(source + end)
        assert time.perf_counter() - began < 3


def test_tags_end_where_they_should():
    inside = lambda source: [text for _, text, _ in extraction.Page(source).blocks]
    assert inside("<p title='a>b'>x</p>") == ["x"]
    assert inside('<p title="a>b</p><p>it ends') == ["b", "it ends"]  # the quote is never closed
    assert inside("a < b <3 <!-- no > --> c<") == ["a < b <3 c<"]
    assert inside("x <b y") == ["x <b y"] and inside("x<!-- y") == ["x"] and inside("<!doctype html>x<?pi?>y") == ["xy"]


@pytest.mark.parametrize("tag", ["div", "b", "a", "li", "table", "p"])
def test_deep_nesting_is_read_in_linear_time(model, tag):
    n = 50_000
    source = f"<{tag}>" * n + "inner words" + f"</{tag}>" * n + "<p>after"
    began = time.perf_counter()
    page = extraction.Page(source)
    assert time.perf_counter() - began < 2
    assert [t for _, t, _ in page.blocks] in (["inner words", "after"], ["inner wordsafter"])
    extraction.Model().marginals(extraction.Forest([page]))
    assert time.perf_counter() - began < 4


def test_pages(spark, model):
    pages = common.table(spark, SF, "pages")
    got = {r.page_id: r for r in extraction.query(spark, SF).collect()}
    for r in pages.collect():
        inner = extraction.Page(r.html[r.html.index("<article>") : r.html.index("</article>")])
        assert got[r.page_id].text == "\n\n".join(t for _, t, _ in inner.blocks)
        assert got[r.page_id].n_chars == len(got[r.page_id].text) and got[r.page_id].url == r.url
    rows = [(1, None, None, 1), (1, None, None, 1), (None, "u", "", 2), (3, "u", "<article><p>" + "long é " * 60_000, 3)]
    odd = spark.createDataFrame(rows, "page_id long, url string, html string, text int")
    out = extraction.extract(odd, model).collect()
    assert sorted(r.n_chars for r in out) == [0, 0, 0, 419_999]
    assert extraction.extract(odd.limit(0), model).count() == 0
