import hashlib

import duckdb
import pandas as pd

from sievemark.llm import line_dedup, queries


def fixture():
    docs = []
    for i in range(60):
        body = [f"own sentence {i} a", "", f"own sentence {i} b and more of it"]
        body.insert(i % 3, " All rights reserved here.\t" if i % 2 else "x")
        body += ["on nine sites only"] * (i < 9) + ["on exactly ten sites"] * (i < 10) + ["short"] * 3
        docs.append((i, "\n".join(body), f"s{i % 30}"))
    docs += [(100 + i, "a whole copied document\nof two lines, all over the web", f"s{i}") for i in range(12)]
    return docs + [(200, None, "s1"), (201, "", None), (202, "on nine sites only\nother own line", None), (203, "\n\n", "s1")]


def test_same_as_sql(spark):
    docs = fixture()
    schema = "doc_id long, text string, source string"
    df = spark.createDataFrame(docs, schema)
    path_free = line_dedup.dedup(df.withColumn("site", df.source).withColumn("id", df.text))
    got = {r.id: r for r in path_free.collect()}
    documents = pd.DataFrame(docs, columns=["doc_id", "text", "source"])  # noqa: F841
    for r in duckdb.sql(queries.ORACLES["op4_line_dedup"]).df().itertuples():
        assert (got[r.doc_id].n_lines, got[r.doc_id].n_removed) == (r.n_lines, r.n_removed) and not got[r.doc_id].copy
        assert hashlib.sha256(got[r.doc_id].text.encode()).hexdigest() == r.clean_sha256
    assert "All rights" not in got[1].text and "on exactly ten" not in got[3].text and "on nine" in got[3].text
    assert got[100].text == got[200].text == "" and got[203].text == "\n\n" and "short" not in got[5].text
    again = line_dedup.dedup(df.union(df.limit(5)))
    assert again.count() == len(docs) + 5
    assert line_dedup.dedup(df.limit(0)).count() == 0


def test_only_proven_copies_stay_whole(spark):
    wide = "one passage that stands on a dozen of sites"
    docs = [(i, f"{wide}\nown {i}", f"s{i}") for i in range(12)] + [(20 + i, wide, f"s{i}") for i in range(2)]
    docs += [(20, wide, "s0"), (30, f"{wide}\n{wide}", "s3")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string")
    got = {r.id: r for r in line_dedup.dedup(df, max_share=0.5).collect()}
    assert all((got[i].text, got[i].n_removed, got[i].copy) == (f"own {i}", 1, False) for i in range(12))
    assert all((got[i].text, got[i].n_removed, got[i].copy) == (wide, 0, True) for i in (20, 21))
    assert (got[30].text, got[30].n_removed, got[30].copy) == ("", 2, False)
    repeated = spark.createDataFrame(docs[:12] + docs[12:13] * 2, "doc_id long, text string, source string")
    assert [(r.text, r.copy) for r in line_dedup.dedup(repeated, max_share=0.5).filter("id = 20").collect()] == [("", False)] * 2


def test_spread_near_and_far_from_the_threshold(spark):
    rows = [(h, h, f"site{s}") for h, n in enumerate([1, 7, 8, 9, 10, 11, 12, 13, 40, 3000]) for s in range(n)]
    lines = spark.createDataFrame(rows * 2, "h1 long, h2 long, site string")
    assert sorted(r.h1 for r in line_dedup.boilerplate(lines, 10).collect()) == [4, 5, 6, 7, 8, 9]


def test_rows_with_a_null_id_lose_their_boilerplate(spark):
    docs = [(i if i else None, f"one line for all sites\nown {i}", f"s{i}") for i in range(12)]
    df = spark.createDataFrame(docs + [docs[0]], "doc_id long, text string, source string")
    for share in (None, 0.9):
        got = line_dedup.dedup(df, max_share=share).collect()
        assert sorted(r.text for r in got) == sorted(["own 0", *(f"own {i}" for i in range(12))]) and {r.n_removed for r in got} == {1}
