import hashlib
import random
import re

import numpy as np

from sievemark.llm import decontamination as dec


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(doc, items):
    own, hit, found = words(doc), set(), []
    for item, text in items:
        w = words(text)
        wins = [w[i : i + 10] for i in range(len(w) - 9)] or ([w] if w else [])
        at = [(i, len(x)) for x in wins for i in range(len(own) - len(x) + 1) if own[i : i + len(x)] == x]
        hit |= {j for i, n in at for j in range(i, i + n)}
        found += [str(item)] * (bool(at) and str(item) not in found)
    digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
    return len(own), len(hit), len(found), digest, bool(hit)


def fixture():
    rng = random.Random(3)
    vocabulary = ["a", "b", "Ab", "cé", "d9", "e", "zz"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "_"]) for _ in range(n))
    items = [(i, text(rng.choice([3, 5, 12, 30]))) for i in range(30)] + [(90, None), (91, "..."), (92, "a b ab"), (2, "x")]
    docs = []
    for i in range(120):
        parts = [text(rng.randrange(40))]
        for _ in range(rng.randrange(3)):
            w = (rng.choice(items)[1] or "").split()
            parts += [" ".join(w[rng.randrange(len(w) or 1) :]), text(rng.randrange(9)) + "unseen "]
        docs.append((i, " ".join(parts)))
    docs += [(500, None), (501, ""), (0, docs[0][1]), (502, " ".join(t or "" for _, t in items) * 3)]
    return docs, items


def test_report_matches_brute_force(spark, monkeypatch):
    docs, items = fixture()
    want = sorted((i, *brute(t, items)) for i, t in docs)
    d = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, items int")
    b = spark.createDataFrame(items, "item_id long, text string")
    assert sorted(map(tuple, dec.report(d, b).collect())) == want
    assert sorted(map(tuple, dec.report(d, b, block_bytes=200).collect())) == want  # several passes
    assert dec.report(d.limit(0), b).count() == 0
    assert {r.n_hit for r in dec.report(d, b.limit(0)).collect()} == {0}


def test_removed_leaves_no_window(spark):
    docs, items = fixture()
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    for r in dec.removed(d, b).collect():
        assert not brute(r.text, items)[4]
    clean = {i: t or "" for i, t in docs if not brute(t, items)[4]}
    assert {r.id: r.text for r in dec.removed(d, b).collect() if not r.contaminated} == clean


def test_index_counts_and_locates():
    rng = np.random.default_rng(0)
    text = rng.integers(1, 5, 3000)
    text[500:1500] = text[1500:2500]  # long repeats
    index = dec.FMIndex(text, 5)
    phrases = np.array([[0, 0, 1], [2, 3, 4], [1, 1, 1], [4, 4, 2], [0, 2, 2]])
    low, high = index.search(phrases)
    for p, lo, hi in zip(phrases, low, high, strict=True):
        p = p[p > 0]
        want = [i for i in range(len(text) - len(p) + 1) if (text[i : i + len(p)] == p).all()]
        assert sorted(index.locate(np.arange(lo, hi)).tolist()) == want


def test_shards_end_anywhere(spark, monkeypatch):
    """Small shards that end within Arrow batches, with carried columns."""
    import types

    import pyarrow as pa

    from sievemark.llm import common

    docs, items = fixture()
    monkeypatch.setattr(dec, "SHARD_DOCS", 7)
    fields = common.arrow_schema(spark, dec.FOUND + ", row string")
    rows = [(i, t or "", f"tag {i}") for i, t in docs]
    batches = [pa.RecordBatch.from_pydict(dict(zip(("id", "text", "tag"), zip(*rows[a : a + 10], strict=True), strict=True))) for a in range(0, len(rows), 10)]
    held = types.SimpleNamespace(value=dec.Phrases([(str(i), t or "") for i, t in items]))
    out = pa.Table.from_batches(list(dec._pass(held, fields, True, True)(iter(batches)))).to_pylist()
    assert [(r["id"], r["text"], r["row"]) for r in out] == rows
    for r, (_, t) in zip(out, docs, strict=True):
        assert (r["n_words"], sum(s["end"] - s["start"] for s in r["spans"])) == brute(t, items)[:2]


def cut(words, items):
    """Words that stay, by cutting all hit words until there are none."""
    windows = {tuple(w[i : i + 10]) for _, t in items if (w := t.split()) for i in range(max(1, len(w) - 9))}
    while True:
        hit = {i + k for w in windows for i in range(len(words) - len(w) + 1) if tuple(words[i : i + len(w)]) == w for k in range(len(w))}
        if not hit:
            return words
        words = [w for i, w in enumerate(words) if i not in hit]


def test_every_other_word_stays(spark):
    """Also where a cut brings words together that are hit, again and again."""
    rng = np.random.default_rng(4)
    passage = " ".join(f"p{i}" for i in range(12))
    items = [(1, passage), (2, "x y"), (3, "a b c"), (4, None)]
    docs = [f"clean start x {passage} y clean end", f"a x {passage} y b {passage} c rest", passage, "x y", "nothing here", ""]
    docs += [" ".join(rng.choice(["x", "y", "a", "b", "c", passage, "other"], 60)) for _ in range(40)]
    columns = "doc_id long, text string, items string, spans int, n_words long, id int, contaminated string, row string"
    d = spark.createDataFrame([(i, t, "i", 1, 2, 3, "c", "r") for i, t in enumerate(docs)], columns)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = {r.id: r for r in dec.removed(d, b, carry=tuple(d.columns[2:])).collect()}
    for i, t in enumerate(docs):
        assert got[i].text.split() == cut(t.split(), [x for x in items if x[1]]), i
        assert tuple(got[i].row) == ("i", 1, 2, 3, "c", "r")
    assert got[0].text.split() == ["clean", "start", "clean", "end"] and got[1].text.split() == ["rest"]
