"""Market signals, canonical documents and the rewrite plug-in on fixtures."""

from pyspark.sql import functions as F

from sievemark.functions import documents as D
from sievemark.functions import numbers as N
from sievemark.operators import signals as G
from sievemark.operators import workflow as W


def test_switch_shapes(spark):
    cases = {
        "https://shop.cz/sk": ("path", "sk"), "https://www.shop.cz/de-AT/": ("path", "de-at"), "https://shop.cz/?lang=en": ("query", "en"),
        "https://shop.cz/list?lang=en": None, "https://en.shop.cz": ("subdomain", "en"), "https://news.shop.cz": None, "https://shop.sk/": ("domain", None),
        "https://shop.sk/page": None, "https://other.sk/": None, "https://shop.cz/": None, "https://shop.cz/sk/list": None, "https://shop.cz/?q=en": None, "": None,
    }
    df = spark.createDataFrame([(u, "https://shop.cz/") for u in cases] + [(None, "https://shop.cz/")], "link string, site string")
    got = {r.link: (r.s.kind, r.s.language) if r.s else None for r in df.select("link", G.switch(F.col("link"), F.col("site")).alias("s")).collect()}
    assert got == cases | {None: None}


def test_platform_switches(spark):
    table = [("one", "cdn.one.com", "currency", "/action/currency", "code"), ("one", "cdn.one.com", "language", "/action/lang/", "l"), ("two", "two.net", "language", "/action/lang", "l")]
    rows = [
        (1, "https://a.cz", ["https://a.cz/action/currency?code=eur", "https://www.a.cz/Action/Lang?L=sk", "https://b.cz/action/lang?l=de", "https://a.cz/action/currency?code=euro"], ["https://x.cdn.one.com/a.js", "https://two.net/b.js"]),
        (2, "https://a.cz", ["https://a.cz/action/lang?l=de", "https://a.cz/action/lang/?l=de"], ["https://two.net/b.js"]),
        (3, "https://a.cz", ["https://a.cz/action/lang?l=de"], ["https://nottwo.net/b.js"]),
        (4, "https://a.cz", None, None),
    ]
    df = spark.createDataFrame(rows, "id int, site string, links array<string>, scripts array<string>")
    got = {(r.id, r.platform, r.kind, r.value) for r in G.platform_switches(df, table, "id", "site", "links", "scripts").collect()}
    assert got == {(1, "one", "currency", "EUR"), (1, "one", "language", "sk"), (2, "two", "language", "de")}


def test_market_signals(spark):
    html = '<html lang="cs-CZ"><head><link rel="alternate" hreflang="sk" href="/s"><link hreflang="x-default" href="/"></head><a class="x" href="/en">EN</a><a href="tel:+420 777">t</a><meta itemprop="priceCurrency" content="czk"></html>'
    df = spark.createDataFrame([(1, "https://shop.cz/a", html), (2, "https://shop.sk/", None), (3, None, "")], "page_id int, url string, html string")
    got = {(r.page_id, r.kind, r.value) for r in G.market_signals(df).collect()}
    assert got == {(1, "lang", "cs-cz"), (1, "hreflang", "sk"), (1, "currency", "CZK"), (1, "phone", "420"), (1, "tld", "cz"), (1, "switch", "path en"), (2, "tld", "sk")}


def test_documents():
    assert D.sorted_json('{"b": [ {"d":1, "c":"é"}], "a": null}') == '{"a":null,"b":[{"c":"é","d":1}]}'
    assert D.sorted_json("no json") is None and D.sorted_json(None) is None
    assert D.codes_only('{"free text": ["a-1", {"n": 3.5}]}') is True
    assert D.codes_only('{"a": [{"b": "two words"}]}') is False and D.codes_only('["' + "a" * 101 + '"]') is False
    assert D.codes_only(None) is None and D.codes_only("{") is None


def test_trial_end(spark):
    day = F.lit("2024-01-31").cast("date")
    r = spark.range(1).select(N.trial_end(day).alias("m"), N.trial_end(day, 30).alias("d")).first()
    assert (str(r.m), str(r.d)) == ("2024-02-29", "2024-03-01")


def test_rewriter(spark):
    df = spark.createDataFrame([(1, " One.. "), (2, None)], "id int, text string")
    assert [r.rewritten for r in W.rewritten(df, "text").orderBy("id").collect()] == ["One.", None]
    assert [r.rewritten for r in W.rewritten(df, "text", lambda s: s.str.upper()).orderBy("id").collect()] == [" ONE.. ", None]


def test_reach_and_holding(spark):
    q = spark.createDataFrame([("a", "q1", 1, 10), ("a", "q2", 1, None), ("b", "q3", 2, None)], "by string, q string, f int, own int")
    places = spark.createDataFrame([(1, 10), (1, 11), (1, 11)], "f int, page int")
    assert {tuple(r) for r in W.reach(q, places, "by", "q", "f", "own", "page").select("by", "questions", "findings", "pages").collect()} == {("a", 2, 1, 2), ("b", 1, 1, 0)}
    sets = spark.createDataFrame([("p", [1, 1, 2]), ("r", None)], "proposal string, ids array<int>")
    assert W.holding(sets, "ids", places.distinct(), "f").count() == 2
