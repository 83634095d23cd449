"""Phrases in texts and repeated findings against plain loops."""

import random

from pyspark.sql import functions as F

from sievemark.operators import phrases, rules

lower = lambda c: F.lower(F.trim(c))


def test_occurrences_at_any_block_size(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abé𝄞") for _ in range(n))
    texts = [(i % 40, word(rng.randint(0, 60))) for i in range(60)] + [(50, None), (51, "")]
    listed = [word(rng.randint(1, 4)) for _ in range(50)] + ["", None, "ab", "ab"]
    df = spark.createDataFrame(texts, "id long, body string").withColumn("phrase", F.lit(1))
    words = spark.createDataFrame([(w,) for w in listed], "phrase string")
    want = sorted((i, w) for i, t in texts for w in set(listed) if w and t and w in t)
    for size in (1 << 20, 40):
        out = phrases.occurrences(df, ["id"], "body", words, "phrase", size)
        assert out.columns == ["id", "phrase"] and sorted(map(tuple, out.collect())) == want
    assert phrases.occurrences(df, ["id"], "body", words.limit(0), "phrase").count() == 0
    assert phrases.occurrences(df.limit(0), ["id"], "body", words, "phrase").count() == 0


def test_quotes(spark):
    pages = spark.createDataFrame([("s", 1, "Alpha beta"), ("s", 2, "beta gamma"), ("t", 3, "gamma"), ("s", 4, None)], "site string, page long, text string")
    quotes = [(1, "s", 2, " BETA "), (2, "s", 9, "beta"), (3, "s", 1, "gamma"), (4, "t", 3, "alpha"), (5, "s", 1, ""), (6, "s", None, "alpha"), (7, "s", 1, None)]
    df = spark.createDataFrame(quotes, "id long, site string, page long, quote string")
    got = {r.id: (r.page, r.moved) for r in phrases.verified_quotes(df, pages, lower).collect()}
    assert got == {1: (2, False), 2: (1, True), 3: (2, True), 6: (1, True)}


def test_urls_leave_findings(spark):
    pages = spark.createDataFrame([("a", "our SOAP is certified"), ("b", "our soap"), ("c", None)], "url string, text string")
    found = [(1, "L", "page", ["b", "a", "x", "c"], "soap"), (2, "L", "segment", ["a", "b"], "certified soap"), (3, "M", "page", ["a"], "x"), (4, None, "page", ["a"], "x"), (5, "L", "page", ["a"], None), (6, "L", "page", ["x", "b"], "Certified")]
    df = spark.createDataFrame(found, "id long, list string, scope string, urls array<string>, text string")
    listed = spark.createDataFrame([("L", "Certified"), ("M", "nothing")], "list string, phrase string")
    got = {r.id: (r.urls, r.excluded) for r in phrases.without_listed(df, "id", pages, listed, lower).collect()}
    assert got == {1: (["b", "x", "c"], False), 2: ([], True), 3: (["a"], False), 4: (["a"], False), 5: ([], True), 6: (["b"], False)}


def test_contained_is_a_plain_search(spark):
    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ab") for _ in range(n))
    outer = {(rng.choice("RS"), word(rng.choice([0, 1, 3, 5, 9, 20, 70, 90]))) for _ in range(120)}
    inner = {(g, t[i : i + n]) for g, t in sorted(outer) for i in [rng.randint(0, 3)] for n in [rng.randint(0, 80)]} | {("R", word(2)), ("S", "")}
    make = lambda rows: spark.createDataFrame(sorted(rows), "g string, text string")
    for most in (0, 2, 7):
        out = rules.contained(make(outer), make(inner), "g", most)
        keys = spark.createDataFrame(sorted({(t,) for _, t in outer | inner}), "text string").select("text", rules.digest(F.col("text")).alias("d"))
        name = {r.d: r.text for r in keys.collect()}
        got = sorted((r.g, name[r.outer], name[r.inner]) for r in out.collect())
        assert got == sorted((g, a, b) for g, a in outer for h, b in inner if g == h and b and b in a and len(a) - len(b) <= most)


def test_contained_shuffles_what_is_contained(spark):
    """Long and short texts that share heads but not whole texts: few rows go on to the join, none is lost."""
    outer = [("R", f"the same head of many texts {'x' * 30}{i} with a tail of its own {i}") for i in range(300)] + [(None, "aé𝄞b")]
    inner = [("R", f"the same head of many texts {'x' * 30}{i}") for i in range(0, 300, 50)] + [("R", f"the same head {i}") for i in range(300)] + [("R", "é𝄞"), (None, "é𝄞")]
    make = lambda rows: spark.createDataFrame(rows, "g string, text string").repartition(2).localCheckpoint()
    before = shuffled(spark)
    found = rules.contained(make(outer), make(inner), "g", 40).collect()
    # i = 0 also begins the texts of no other number; 50 begins no other number below 300, 100 to 250 neither
    assert len(found) == 6
    assert shuffled(spark) - before < 3_000


def shuffled(spark):
    """Rows that all stages so far have written to shuffles."""
    jvm = spark._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), None)
    return sum(s.shuffleWriteRecords() for s in jvm.scala.jdk.javaapi.CollectionConverters.asJava(stages))
