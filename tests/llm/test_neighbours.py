import numpy as np

from sievemark.llm import common, neighbours


def brute(ids, x, k=20):
    out = {}
    for q in [i for i in ids if i % 20 == 0]:
        s = (x * x[ids.index(q)]).sum(1)
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:k]
        out[q] = [ids[j] for j in order]
    return out


def test_recall_and_exact_scores(spark):
    rows = common.table(spark, "/root/testdata/sf0.1", "embeddings").collect()
    ids, x = [r.vec_id for r in rows], np.array([r.embedding for r in rows], np.float64)
    want, got = brute(ids, x), {}
    place = {v: i for i, v in enumerate(ids)}
    for r in neighbours.query(spark, "/root/testdata/sf0.1").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
        assert np.isclose(r.score, x[place[r.query_id]] @ x[place[r.vec_id]], rtol=0, atol=1e-12)
    assert set(got) == set(want)
    recall = np.mean([len(set(want[q]) & {v for _, v, _ in got[q]}) / len(want[q]) for q in want])
    assert recall >= 0.97
    for q, found in got.items():
        assert [r for r, _, _ in sorted(found)] == list(range(1, 21))
        assert [(-s, v) for _, v, s in sorted(found)] == sorted((-s, v) for _, v, s in found)


def test_odd_vectors_and_ties(spark):
    rng = np.random.default_rng(0)
    rows = [(i, rng.normal(size=6).tolist()) for i in range(40)] + [(100 + i, [1.0] * 6) for i in range(60)]
    bad = [(200, None), (220, [0.0] * 6), (240, [1.0, None] * 3), (260, [float("nan")] * 6), (280, [float("inf")] * 6), (None, [1.0] * 6), (320, [])]
    df = spark.createDataFrame([(i, v, 1.0) for i, v in rows + bad], "vec_id long, embedding array<double>, score double")
    got = {}
    for r in neighbours.search(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    ids, x = [i for i, _ in rows], np.array([v for _, v in rows])
    assert got == brute(ids, x)
    assert neighbours.search(df.limit(0)).count() == 0
    assert neighbours.search(df.filter("vec_id = 20")).count() == 0
    shorter = spark.createDataFrame([(i, [1.0 + i, 2.0], 1.0) for i in range(300, 325)] + [(400, [3.0], 1.0)], df.schema)
    both = {}
    for r in neighbours.search(df.union(shorter)).orderBy("query_id", "rank").collect():
        both.setdefault(r.query_id, []).append(r.vec_id)
    assert {q: v for q, v in both.items() if q not in (300, 320)} == got  # each length by itself
    assert both[300] == list(range(324, 304, -1)) and 400 not in both
    twice = neighbours.search(df.union(df))
    assert twice.filter("query_id = vec_id").count() == 0
    assert neighbours.search(df.filter("vec_id <= 20")).groupBy("query_id").count().filter("count != 20").count() == 0


def test_doubles_and_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 200)
    monkeypatch.setattr(neighbours, "QUERIES", 16)
    rng = np.random.default_rng(3)
    x = rng.normal(size=(1500, 8)) * np.exp(rng.normal(size=(1500, 1)))
    x[700:900] = 1 + np.arange(200)[:, None] * 1e-12  # apart in double precision only
    x[1200:1300] *= 1e39  # too large for single precision
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    want, got = brute(list(range(1500)), x), {}
    for r in neighbours.search(df.repartition(8), rerank=200).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert np.isclose(r.score, x[r.query_id] @ x[r.vec_id], rtol=1e-12)
    assert np.mean([len(set(want[q]) & set(got[q])) / 20 for q in want]) >= 0.97
