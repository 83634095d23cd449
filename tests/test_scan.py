import datetime as dt

from pyspark.sql import functions as F

from sievemark import scan
from sievemark.functions import text as T

RULES = """
questions: {claims: [tion], shouts: ["!!"]}
rules:
  - {id: R1, module: m, all: [[claims, 0.7]], none: [[shouts, 0.5]], jurisdictions: {CZ: null, SK: 2999-01-01}}
"""
SF = "/root/testdata/sf0.001"


def test_texts_and_pages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    report = scan.analyze_texts(docs, RULES, "doc_id", "text", "source", dt.date(2025, 1, 1))
    found = report.findings.collect()
    assert found and all("tion" in r.text.lower() and r.status == "effective" and r.jurisdictions == "CZ,SK" for r in found)
    assert report.segments.count() == report.outcomes.select("hash").distinct().count()
    seen = []

    def scorer(segments, rules):
        seen.append(segments.columns)
        return segments.select("hash", F.explode(F.array(*map(F.lit, rules.questions))).alias("question"), F.lit(0.9).alias("p"))

    none = scan.scan(spark.read.parquet(f"{SF}/pages.parquet"), RULES, dt.date(2025, 1, 1), scorer)
    assert none.findings.count() == 0 and seen == [["hash", "text"]] and none.segments.count() > 100


def test_sql_functions(spark):
    scan.register_functions(spark)
    r = spark.sql("select strictness_rank(1, 2, 3, 1) a, strictness_rank(null, 1, 1, 1) b, fingerprint('abc') f").first()
    assert (r.a, r.b) == (109, 127)
    assert r.f == spark.range(1).select(T.fingerprint(F.lit("abc")).alias("f")).first().f


def test_sentence_rules():
    text = "Dr. Novak came on 3. May. It cost approx. 5 EUR... and more. \"Really?\" He said no! OK"
    assert T.sentence_list(text) == ["Dr. Novak came on 3. May.", "It cost approx. 5 EUR... and more.", '"Really?"', "He said no!", "OK"]
    assert T.sentence_list(None) == [] and T.sentence_list(" \n ") == []
    assert max(map(len, T.sentence_list("word " * 900))) <= 1000
    assert "".join(T.sentence_list("x" * 2500)) == "x" * 2500
