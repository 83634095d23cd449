import zlib

import numpy as np

from sievemark.llm import common, quality

SF = "/root/testdata/sf0.01"


def test_trees_learn_and_flatten():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 5))
    y = ((x[:, 0] > 0) ^ (x[:, 1] > 0.5)).astype(float)
    trees = quality.grown(x[:2000], y[:2000])
    assert ((trees.scores(x[2000:]) >= 0.5) == y[2000:]).mean() > 0.95
    row, by_hand = x[2500], trees.base
    for node in trees.roots:
        while trees.left[node] >= 0:
            node = trees.left[node] + (row[trees.feature[node]] > trees.threshold[node])
        by_hand += trees.value[node]
    assert np.isclose(trees.scores(row[None])[0], 1 / (1 + np.exp(-by_hand)))
    assert quality.grown(x[:0], y[:0]).scores(x[:3]).tolist() == [0.5] * 3
    assert quality.grown(x[:9], np.ones(9)).scores(x[:2]).tolist() == [1.0] * 2


def test_held_out_accuracy_and_contract(spark):
    rows = {r.doc_id: r for r in quality.query(spark, SF).collect()}
    labels = common.table(spark, SF, "labels").collect()
    held = [r for r in labels if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    assert all(rows[r.doc_id].held_out for r in held)
    assert np.mean([rows[r.doc_id].predicted == r.quality for r in held]) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())


def test_nulls_empty_and_repeated(spark):
    schema = "doc_id long, text string, y int, score string"
    df = spark.createDataFrame([(1, None, 1, "a"), (2, "", 1, "a"), (2, "", 1, "a"), (None, "x " * 9, 1, "b"), (4, "é" * 200_000, 1, None)], schema)
    labels = spark.createDataFrame([(1, None, None), (None, 1, 1), (4, 1, 0)], "doc_id long, quality int, toxic int")
    trees = quality.trained(df, labels)
    got = quality.score_documents(df, trees).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert quality.score_documents(df.limit(0), trees).count() == 0
