import zlib

import numpy as np

from sievemark.llm import common, toxicity

SF = "/root/testdata/sf0.1"


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    docs = [rng.integers(1, 30, (n, 4)) for n in (1, 5, 9, 2)] * 3
    y = np.array([0, 1, 1, 0] * 3, np.float64)
    net = toxicity.Network()
    net.fit(docs, y)
    for p in net.parameters():
        p += rng.normal(0, 0.3, p.shape).astype(p.dtype)
    net.vectors[0] = 0
    net.offset = net._offset[0]

    def loss():
        net.offset = net._offset[0]
        s = np.clip(net.sequence_scores(docs), 1e-9, 1 - 1e-9)
        return -(y * np.log(s) + (1 - y) * np.log(1 - s)).mean()

    grads = net.gradients(docs, y.astype(np.float32))
    for p, g in zip(net.parameters(), grads, strict=True):
        for _ in range(6):
            at = tuple(rng.integers(n) for n in p.shape)
            if p is net.vectors and at[0] == 0:
                continue
            old = p[at]
            p[at] = old + 1e-2
            up = loss()
            p[at] = old - 1e-2
            down = loss()
            p[at] = old
            assert abs((up - down) / 2e-2 - g[at]) < 0.02


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in toxicity.query(spark, SF).collect()}
    held = [r for r in common.table(spark, SF, "labels").collect() if zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert all(rows[r.doc_id].held_out for r in held)
    truth = np.array([r.toxic for r in held])
    got = np.array([rows[r.doc_id].predicted for r in held])
    print("precision", truth[got == 1].mean(), "recall", got[truth == 1].mean(), "n", truth.sum())
    assert (got == truth).mean() > 0.97 and got[truth == 1].mean() > 0.85 and truth[got == 1].mean() > 0.9


def test_scores_depend_on_the_text_alone(spark):
    """To the last bit, whatever stands beside a text."""
    docs = common.table(spark, "/root/testdata/sf0.001", "documents")
    net = toxicity.trained(docs, common.table(spark, "/root/testdata/sf0.001", "labels"))
    bodies = [(r.text or "").encode() for r in docs.collect()] + [b"", b"hello", b"one two"]
    alone = np.array([net.scores([b])[0] for b in bodies])
    assert (net.scores(bodies) == alone).all() and (net.scores(bodies[::-1])[::-1] == alone).all()
    order = np.random.default_rng(0).permutation(len(bodies))
    for some in np.array_split(order, 9):
        assert (net.scores([bodies[i] for i in some]) == alone[some]).all()


def test_batches_agree_and_odd_rows(spark):
    schema = "doc_id long, text string, lang string, score int"
    rows = [(1, None, "en", 1), (2, "", None, 1), (2, "", None, 1), (3, "you idiot fool", "en", 1), (4, "kind words here", "en", 1), (5, "idiot " * 50_000, "xx", 1), (6, "fine day", "en", 0), (7, "idiot fine", "en", 0), (8, "an idiot day", "en", 0), (9, "words day", "en", 0)]
    df = spark.createDataFrame(rows, schema)
    labels = spark.createDataFrame([(i, int("idiot" in (t or ""))) for i, t, _, _ in rows], "doc_id long, toxic int")
    net = toxicity.trained(df, labels)
    got = {r.id: r.score for r in toxicity.score_documents(df, net).collect()}
    for i, t, _, _ in rows:
        assert got[i] == net.scores([(t or "").encode()])[0]
    assert toxicity.score_documents(df.limit(0), net).count() == 0
    assert toxicity.trained(df, labels.limit(0)).scores([b"x"]).tolist() == [0.0]
