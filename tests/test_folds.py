"""Folds, sources, sinks and streams against plain Python."""

import datetime as dt
import gzip

import pytest
from pyspark.sql import functions as F

from sievemark.functions import numbers as N
from sievemark.functions import text as T
from sievemark.operators import pricing, rules, segments, templates, versions, work_queue, workflow
from sievemark.sources import pages, tables
from sievemark.streaming import rates


def test_chunks(spark):
    rows = [(k, i, "x" * n) for k, sizes in {1: [300, 200, 99, 1, 700, 5], 2: [600], 3: [1] * 400}.items() for i, n in enumerate(sizes)]
    df = spark.createDataFrame([*rows, (4, 0, None)], "k long, i int, t string")
    got = {}
    for r in segments.chunks(df, "k", "i", "t").orderBy("k", "chunk").collect():
        got.setdefault(r.k, []).append(r.text)
    want = {}
    for k, _, t in rows:
        done = want.setdefault(k, [])
        if done and len(done[-1]) + 1 + len(t) <= 600:
            done[-1] += "\n" + t
        else:
            done.append(t)
    assert got == want


def test_token_bucket_and_adaptive_rate(spark):
    at = [0.0, 1.0, 1.5, 2.0, 9.0, 9.1, 9.2, 30.0]
    df = spark.createDataFrame([(1, t) for t in at], "k int, t double")
    got = df.groupBy("k").agg(work_queue.token_bucket(F.col("t"), F.lit(1.0), 2.0, 0.5).alias("s")).first().s
    tokens, last, granted = 2.0, None, 0
    for t in at:
        tokens = min(2.0, tokens + (t - last if last is not None else 0) * 0.5)
        last = t
        if tokens >= 1:
            tokens, granted = tokens - 1, granted + 1
    assert (got.granted, got.denied) == (granted, len(at) - granted) and abs(got.tokens - tokens) < 1e-9
    answers = [(200, 0.1), (200, 3.0), (429, 0.1), (500, 0.1), *[(200, 0.1)] * 30]
    df = spark.createDataFrame([(1, i, s, d) for i, (s, d) in enumerate(answers)], "k int, i int, s int, d double")
    got = df.groupBy("k").agg(work_queue.adaptive_rate(F.col("i"), F.col("s"), F.col("d")).alias("r")).first().r
    rate = 1.0
    for s, d in answers:
        rate = min(5.0, max(0.2, rate * 0.5 if s in (429, 503) else rate * 0.7 if s >= 400 or d > 2 else rate + 0.25))
    assert abs(got - rate) < 1e-9


def test_rule_documents():
    good = {"questions": {"q": ["a"]}, "rules": [{"id": "r", "module": "m", "all": [["q", 0.5]], "jurisdictions": {"CZ": None}}]}
    assert rules.compiled(good).rules[0].all == (("q", 0.5),)
    assert rules.compiled("questions: {q: [a]}\nrules: []\n").questions == {"q": ("a",)}
    for bad in ({"x": 1}, {"questions": {}, "rules": [{"id": "r", "module": "m", "all": [["q", 1]]}]},
                {**good, "rules": good["rules"] * 2}, {**good, "rules": [{**good["rules"][0], "severity": "odd"}]}):
        with pytest.raises((ValueError, TypeError)):
            rules.compiled(bad)


def test_missing_answers_are_not_zero(spark):
    rs = rules.compiled({"questions": {"a": ["x"], "b": ["y"]}, "rules": [{"id": "r", "module": "m", "all": [["a", 0.5]], "none": [["b", 0.5]]}]})
    df = spark.createDataFrame([(1, "a", 0.9), (2, "a", 0.9), (2, "b", 0.1), (3, "a", 0.9), (3, "b", 0.9), (4, "a", 0.7), (4, "b", None)], "k long, question string, p double")
    got = {r.k: (r.outcome, r.score, r.band) for r in rules.outcomes(df, "k", rs).collect()}
    assert got == {1: ("not_evaluated", None, None), 2: ("match", 0.9, "high"), 3: ("no_match", 0.1, None), 4: ("not_evaluated", None, None)}


def test_text_functions(spark):
    df = spark.createDataFrame([(" a­​  B\n",)], "t string")
    r = df.select(T.clean(F.col("t")).alias("c"), T.strip_marks(F.lit("Žluťoučký ñ")).alias("m"), T.quote(F.lit("„Ab  c“")).alias("q"),
                  T.calling_code(F.lit("+420 777")).alias("p"), T.language(F.lit("en_GB")).alias("l"), T.fingerprint(F.lit("abc")).alias("f")).first()
    assert (r.c, r.m, r.q, r.p, r.l) == ("a B", "Zlutoucky n", "ab c", "420", "en")
    import hashlib

    assert r.f == int.from_bytes(hashlib.sha256(b"abc").digest()[:8], "big", signed=True)


def test_periods_and_tiers(spark):
    r = spark.range(1).select(N.next_period(F.lit("2024-01-31").cast("date"), 1, F.lit("2024-02-10").cast("date")).alias("a"), N.money(F.lit("-2.345").cast("decimal(10,3)")).alias("m")).first()
    assert r.a == dt.date(2024, 2, 29) and str(r.m) == "-2.35"
    tiers = spark.createDataFrame([("a", 0, 10), ("b", 12, 20), ("c", 20, None), ("d", 30, None)], "code string, low long, high long")
    assert sorted(map(tuple, pricing.tier_faults(tiers).collect())) == [("a", "gap"), ("b", "overlap"), ("c", "overlap")]


def test_versions_and_cursor(spark):
    df = spark.createDataFrame([(1, 1, "a"), (1, 2, "a"), (1, 3, None), (1, 4, "b"), (2, 1, None)], "k long, at int, v string")
    got = sorted(map(tuple, versions.scd2(df, ["k"], "v", "at").collect()), key=str)
    assert got == [(1, "a", 1, 3, False), (1, "b", 4, None, True), (1, None, 3, 4, False), (2, None, 1, None, True)]
    assert versions.decode_cursor(versions.encode_cursor({"a": 1, "b": "x"})) == {"a": 1, "b": "x"}
    with pytest.raises(ValueError):
        versions.page_after(df, None, ["k"], 0)


def test_robots_and_sitemap(spark, tmp_path):
    body = "User-agent: bot\nUser-agent: other\nDisallow: /a\nAllow: /a/b # c\n\nUser-agent: *\nDisallow: /\n"
    df = spark.createDataFrame([("s", body)], "site string, body string")
    urls = spark.createDataFrame([("s", "/a/x"), ("s", "/a/b/c"), ("s", "/z"), ("t", "/a")], "site string, path string")
    got = {(r.site, r.path): r.allow for r in pages.allowed(urls, pages.robots(df, agent="bot"), "site", "path").collect()}
    assert got == {("s", "/a/x"): False, ("s", "/a/b/c"): True, ("s", "/z"): True, ("t", "/a"): True}
    assert not any(r.allow for r in pages.allowed(urls.filter("site = 's'"), pages.robots(df, agent="third"), "site", "path").collect())
    xml = '<urlset xmlns:xhtml="x"><url><loc>http://s/1</loc><lastmod>2024-05-06T01:02:03Z</lastmod><xhtml:link hreflang="de" href="http://s/d"/></url><url><loc>http://s/2</loc></url></urlset>'
    (tmp_path / "map.xml.gz").write_bytes(gzip.compress(xml.encode()))
    rows = sorted(pages.sitemap(spark, str(tmp_path / "map.xml.gz")).collect())
    assert rows[0].lastmod == dt.date(2024, 5, 6) and rows[0].alternates[0].language == "de" and rows[1].alternates == []


def test_html(spark):
    html = ('<html><body><nav><a href="/x">X</a></nav><main><h2>T &amp; U</h2><p>one<br>two</main><script type="application/ld+json">'
            '{"@type":"Product","name":"N","offers":{"priceCurrency":"EUR"}}</script><script type="application/ld+json">{bad</script></body></html>')  # fmt: skip
    df = spark.createDataFrame([(1, html), (2, None), (3, "")], "page_id long, html string")
    parsed = pages.parsed(df)
    assert [tuple(r)[2:] for r in pages.blocks(parsed).orderBy("id", "ord").collect()] == [("navigation", 0, "X"), ("main", 2, "T & U"), ("main", 0, "one two")]
    assert [tuple(r) for r in pages.products(parsed).collect()] == [(1, "N", None, "EUR")]


def test_nested_products(spark):
    graph = '{"@graph":[{"@type":["Thing","https://schema.org/Product"],"name":"A","offers":[{"priceCurrency":" czk"}],"isRelatedTo":{"@type":"Product","name":5}}]}'
    deep = "[" * 20 + '{"@type":"Product"}' + "]" * 20
    df = spark.createDataFrame([(1, [graph, "{bad", deep]), (2, []), (3, None)], "id long, json_ld array<string>")
    assert sorted(map(tuple, pages.products(df).collect()), key=str) == [(1, "A", None, "CZK"), (1, None, None, None)]


def test_robots_facts_and_index(spark, tmp_path):
    body = "User-agent: a\nSitemap: http://s/1\nUser-agent: b\nCrawl-delay: 2\nCrawl-delay: x\nDisallow:\n\nUser-agent: *\nCrawl-delay: 9\nDisallow: /\nSitemap: http://s/2"
    df = spark.createDataFrame([("s", body), ("t", "")], "site string, body string")
    got = {r.site: (r.sitemaps, r.delay) for r in pages.robots_facts(df, agent="A").collect()}
    assert got == {"s": (["http://s/1", "http://s/2"], 2.0), "t": ([], None)}
    assert {r.site: r.delay for r in pages.robots_facts(df, agent="c").collect()} == {"s": 9.0, "t": None}
    assert pages.robots(df, agent="b").count() == 0 and [r.path for r in pages.robots(df, agent="c").collect()] == ["/"]
    (tmp_path / "i.xml").write_text("<sitemapindex><sitemap><loc>http://s/m</loc><lastmod>2024-01-02</lastmod></sitemap></sitemapindex>")
    assert [tuple(r) for r in pages.sitemap_index(spark, str(tmp_path / "i.xml")).collect()] == [("http://s/m", dt.date(2024, 1, 2))]


def test_changes_are_placed_apart():
    change = lambda old, new: {"old": old, "new": new}
    text = "best soap ever, best\n soap of all"
    assert workflow.place(text, [change("best soap", "soap"), change("best soap", "it")]) == ("soap ever, it of all", [])
    assert workflow.place(text, [change("soap ever", "x"), change("best  soap", "y"), change("ever,", "z"), change(" ", "w"), change(None, "v")]) == ("best x, y of all", [2, 3, 4])
    assert workflow.place("", [change("a", "b")]) == ("", [0])


def test_sentence_rules():
    cases = {
        "Dr. Novak came. He left.": ["Dr. Novak came.", "He left."], "Pears, plums etc. The rest": ["Pears, plums etc.", "The rest"],
        "Soap Inc. of Brno": ["Soap Inc. of Brno"], "On 27. 9. 2026. Then": ["On 27. 9. 2026.", "Then"], "3. Payment is due. 4. End": ["3. Payment is due.", "4. End"],
        "In 2010. It began": ["In 2010.", "It began"], "Wait... no! Yes": ["Wait... no!", "Yes"], "": [],
    }
    assert {t: T.sentence_list(t) for t in cases} == cases


def test_clusters_follow_order(spark):
    rows = [("s", i, t) for i, t in enumerate([["a", "b", "c", "d"], ["a", "b", "c"], ["x"], ["a", "b"], ["x"], ["a", "b", "c", "d"]])]
    df = spark.createDataFrame(rows, "site string, id long, tokens array<string>")
    got = {r.id: r.leader for r in templates.clusters(df, "site", "id", "tokens").collect()}
    assert got == {0: 0, 1: 0, 2: 2, 3: 3, 4: 2, 5: 0}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(i, ["a", "b"], 0.12345, dt.datetime(2024, 1 + i, 1)) for i in range(3)], "pageId long, urls array<string>, unknownShare double, at timestamp")
    tables.findings_csv(df, str(tmp_path / "f"))
    assert spark.read.option("header", True).csv(str(tmp_path / "f")).first().urls == "a|b"
    tables.pages_jsonl(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).first().unknown_share == 0.123
    assert tables.export_csv(df.drop("urls"), str(tmp_path / "e"), ["pageId"], 2) and not tables.export_csv(df.drop("urls"), str(tmp_path / "e"), ["pageId"], 3)
    tables.append_months(df, str(tmp_path / "m"), "at", "2024-01-01", "2025-01-01")
    assert spark.read.parquet(str(tmp_path / "m")).select("month").distinct().count() == 3
    with pytest.raises(ValueError):
        tables.append_months(df, str(tmp_path / "m"), "at", "2024-01-01", "2024-02-01")
    with pytest.raises(ValueError):
        tables.tenant(df, "pageId", None)


def test_streams(spark, tmp_path):
    rows = [("k", i, t, 1.0, p) for i, (t, p) in enumerate([(0.0, 0), (0.1, 0), (0.2, 2), (10.0, 2), (10.1, 0)])]
    schema = "key string, id long, at double, cost double, priority int"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    q = rates.token_bucket(stream, 3.0, 0.1, 0.4).writeStream.format("memory").queryName("grants").outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    got = {r.id: r.granted for r in spark.table("grants").collect()}
    assert got == {0: True, 1: True, 2: False, 3: False, 4: True}
    events = [(i, dt.datetime(2024, 1, 1, i % 5), i % 3, "view", 1.0) for i in range(30)]
    schema = "event_id long, ts timestamp, user_id long, event_type string, value double"
    spark.createDataFrame(events, schema).write.parquet(str(tmp_path / "ev"))
    stream = rates.read_events(spark, str(tmp_path / "ev"), schema, after=9)
    rates.upsert_batches(stream, ["user_id"], str(tmp_path / "up"), str(tmp_path / "ck")).awaitTermination()
    latest = {r.user_id: r.event_id for r in spark.read.parquet(str(tmp_path / "up")).collect()}
    assert latest == {0: 24, 1: 19, 2: 29}
    for make, n in ((rates.usage, 5), (rates.sessions, 15)):
        q = make(rates.read_events(spark, str(tmp_path / "ev"), schema)).writeStream.format("memory").queryName(make.__name__).outputMode("complete").start()
        q.processAllAvailable()
        q.stop()
        assert spark.table(make.__name__).count() == n


def test_repeated_only_where_jurisdictions_are_covered(spark):
    rows = [
        (1, "R", ["a", "b"], "vegan soap", "primary", ["CZ", "SK"]), (2, "R", ["b", "c"], "vegan soap for all", "secondary", ["CZ"]),
        (3, "R", ["a"], "vegan soap for all", "secondary", ["CZ", "DE"]), (4, "R", ["c"], "vegan soap for all", "secondary", ["CZ"]),
        (5, "R", ["a"], "vegan soap", "primary", ["DE"]), (6, "R", ["a"], "vegan soap for all", "secondary", []),
    ]
    found = spark.createDataFrame(rows, "id long, rule_id string, url array<string>, text string, source string, jur array<string>")
    out = rules.without_repeated(found, "id", jurisdictions="jur")
    assert out.columns == found.columns and sorted(r.id for r in out.collect()) == [1, 3, 4, 5]
    one = found.withColumn("url", F.col("url")[0])
    assert sorted(r.id for r in rules.without_repeated(one, "id").collect()) == [1, 2, 4, 5]
