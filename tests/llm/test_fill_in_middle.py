import hashlib
import random
import re

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievemark.llm import fill_in_middle as fim
from sievemark.llm import queries

TEXTS = [
    None, "", "a", "1", "é", "abc", "  ", "Hello, wörld! It's 3 pm.\n\nnéxt", "x<P", "<S", "a<P>b", "<M>", "<<S>>", "<p> <s> <m>", "<P <S <M", "P>S>M>",
    "\U0001f600a\U0001f600", "a\nb\nc", "tail\n", "\nhead", "日本語 text 日本", "A" * 5000, "é" * 3000, "<" * 400, ("word " * 30_000),
]


def rows():
    rng = random.Random(4)
    more = ["".join(rng.choice(["a", "Zq", " ", "é", "<", ">", "P", "S", "M", "\n", "9", "<P"]) for _ in range(rng.randint(0, 60))) for _ in range(400)]
    return list(enumerate(TEXTS + more)) + [(5, TEXTS[5]), (None, "a null id draws too")]


def brute(doc, text):
    text = text or ""
    units = re.findall("[A-Za-z]+|[^A-Za-z]", text)
    name = hashlib.sha256(f"1:{'null' if doc is None else doc}".encode()).hexdigest()
    h = [int(name[8 * i : 8 * i + 8], 16) for i in range(4)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    if not text or any(x in text for x in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return doc, len(units), "plain", None, None, text
    if h[3] % 100 < 20:
        return doc, len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return doc, len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def test_against_brute_force(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string").withColumn("form", F.lit("x")).withColumn("id", F.lit(1))
    out = fim.transform(df.repartition(3))
    got = out.select("*", fim.restored(F.col("output"), F.col("form")).alias("back")).collect()
    assert sorted((tuple(r)[:6] for r in got), key=str) == sorted((brute(*r) for r in rows()), key=str)
    texts = {d: t or "" for d, t in rows()}
    assert all(r.back == texts[r.doc_id] for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.transform(df.limit(0)).count() == 0
    assert {r.form for r in fim.transform(df, rate=0).collect()} == {"plain"}
    assert {r.form for r in fim.transform(df, rate=100, spm_rate=100).collect()} == {"plain", "spm"}


def test_query_is_its_sql(spark, tmp_path):
    held = [r for r in rows() if r[0] is not None]
    documents = pd.DataFrame(held, columns=["doc_id", "text"])  # noqa: F841
    spark.createDataFrame(held, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op12_fill_in_middle"](spark, str(tmp_path))
    want = duckdb.sql(queries.ORACLES["op12_fill_in_middle"])
    assert got.columns == want.columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want.fetchall(), key=str)


def test_every_boundary():
    texts = [t or "" for _, t in rows() if len(t or "") < 100]
    found = fim.units(texts, fim.automaton())
    for i, text in enumerate(texts):
        ends = [0, *(m.end() for m in re.finditer("[A-Za-z]+|[^A-Za-z]", text))]
        assert found.places(np.full(len(ends), i), np.arange(len(ends))).tolist() == ends
        assert found.marked[i] == any(x in text for x in fim.SENTINELS)
    assert fim.units([], fim.automaton()).count.tolist() == []


@pytest.mark.parametrize("patterns", [["aba", "ba", "b"], ["ab", "bab", "abb", "c"], ["aaa", "a"]])
def test_automaton(patterns):
    scan = fim.Automaton([(tuple(map(ord, p)), 1 << i) for i, p in enumerate(patterns)], 128)
    text = "abababbcaaaabcbab"
    got = scan.outputs(np.frombuffer(text.encode(), np.uint8)).tolist()
    want = [sum(1 << i for i, p in enumerate(patterns) if text[: k + 1].endswith(p)) for k in range(len(text))]
    assert got == want
