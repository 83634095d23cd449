import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sievemark.llm import common, periodic_runs, queries


def brute(w, least=6, times=4):
    """Every run by comparing all places of all distances."""
    n, out = len(w), []
    for q in range(1, n):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            size = j + q - i
            if j > i and size >= max(least, times * q):
                part = w[i : i + size]
                if not any(part[d:] == part[: size - d] for d in range(1, q)):
                    out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda x: (x[0], x[2]))


@given(st.integers(1, 4).flatmap(lambda a: st.lists(st.integers(0, a), max_size=50)))
@settings(max_examples=300, deadline=None)
def test_all_runs_of_two_periods(w):
    got = [tuple(x) for x in periodic_runs.runs(np.array([*w, 99]), 2, 2).tolist()]
    assert sorted(got, key=lambda x: (x[0], x[2])) == brute(w, 2, 2)


def fibonacci(n):
    a, b = [0], [0, 1]
    while len(b) < n:
        a, b = b, b + a
    return b[:n]


@pytest.mark.parametrize("w", [fibonacci(300), [0] * 200, [*range(40)] * 6, [0, 1, 0, 2] * 30 + [0, 1, 0, 3] * 9, [*range(30), 0, 1]])
def test_structured_texts(w):
    got = [tuple(x) for x in periodic_runs.runs(np.array([*w, 99]), 2, 2).tolist()]
    assert sorted(got, key=lambda x: (x[0], x[2])) == brute(w, 2, 2)


def test_blocks_are_longest_earlier_factors():
    rng = random.Random(5)
    for _ in range(200):
        w = [rng.randrange(3) for _ in range(rng.randint(1, 40))] + [99]
        starts = periodic_runs.Index(np.array(w)).blocks().tolist()
        at, want = 0, []
        while at < len(w):
            want.append(at)
            size = 0
            while any(w[at : at + size + 1] == w[k : k + size + 1] for k in range(at)) and at + size < len(w):
                size += 1
            at += max(size, 1)
        assert starts == want


def test_texts_of_a_batch_are_apart():
    rng = random.Random(1)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(0, 6)):
            w, a = [], rng.choice([1, 2, 3, 8, 30])
            for _ in range(rng.randint(0, 8)):
                w += [rng.randrange(a) for _ in range(rng.randint(1, 6))] * rng.choice([1, 1, 2, 4, 5, 9])
            texts.append([b"%d" % x for x in w])
        assert periodic_runs.found(texts) == [brute(w) for w in texts]
    assert periodic_runs.found([[b"a", b"b", b"c"]] * 8) == [[]] * 8  # one run only across their borders


def digest(x):
    return hashlib.sha256(x.encode()).hexdigest()


def contract(doc, text):
    """The query's row, step by step from its contract."""
    words = re.findall("[^\\x20\\x09-\\x0D]+", text or "")
    n, h = len(words), zlib.crc32(str(doc).encode()) if doc is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = brute(words)
    best = max(found, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    return (
        doc, n, len(found), *(best or (None,) * 3), best and 1000 * best[1] // best[2],
        digest("".join(f"{a},{b},{c}\n" for a, b, c in found)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)), len(gone),
    )


def test_query_against_brute_force(spark, tmp_path):
    texts = [None, "", " \n", "x", "a " * 5, "a " * 6, "a b " * 4, "a b " * 3 + "a", "é ü\x0b" * 9, "one two three four\n" * 8 + "five", "w\x1cw " * 12]
    rng = random.Random(2)
    for _ in range(120):
        w = []
        for _ in range(rng.randint(1, 6)):
            w += [f"w{rng.randrange(5)}é" for _ in range(rng.randint(1, 7))] * rng.choice([1, 1, 4, 6])
        texts.append(" ".join(w))
    rows = [(i, t) for i, t in enumerate(texts)] + [(4, texts[4]), (None, "z " * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("x")).withColumn("id", F.lit(1))
    df.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted(map(tuple, queries.QUERIES["op13_periodic_runs"](spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((contract(*r) for r in rows), key=str)
    assert periodic_runs.find_runs(df.limit(0)).count() == 0
    plain = {r.doc_id: r for r in periodic_runs.find_runs(df).collect()}
    assert [tuple(x) for x in plain[9].runs] == [(0, 32, 4)] and plain[9].n_dropped == 28


def test_query_on_a_sample_table(spark):
    docs = common.table(spark, "/root/testdata/sf0.001", "documents").filter("length(text) < 6000").select("doc_id", "text").collect()
    got = {r.doc_id: tuple(r) for r in queries.QUERIES["op13_periodic_runs"](spark, "/root/testdata/sf0.001").collect()}
    assert all(got[r.doc_id] == contract(r.doc_id, r.text) for r in docs)


def test_long_text():
    unit = [b"%d" % x for x in range(50_000)]
    assert periodic_runs.found([unit * 4, [b"a"] * 100_000]) == [[(0, 200_000, 50_000)], [(0, 100_000, 1)]]
