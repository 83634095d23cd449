import random
import re

import numpy as np

from sievemark.llm import ngram_join


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute(docs):
    sets = {i: shingles(t) for i, t in docs}
    label = {i: i for i in sets}
    ids = sorted(sets)
    edges = [(a, b) for k, a in enumerate(ids) for b in ids[k + 1 :] if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0]
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(label[a], label[b])
            changed |= label[a] != m or label[b] != m
            label[a] = label[b] = m
    return sorted((i, len(sets[i]), label[i]) for i, _ in docs)


def fixture(n=250):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    passage = " ".join(rng.choices(words, k=40))
    docs = []
    while len(docs) < n:
        text = rng.choices(words, k=rng.choice([1, 3, 5, 6, 12, 40, 90]))
        if rng.random() < 0.3:
            text += passage.split()
        docs.append(" ".join(text))
        for _ in range(rng.choice([0, 0, 1, 3, 12])):
            copy = list(text)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            text = copy if rng.random() < 0.3 else text  # chains: links that only lead on from copy to copy
            docs.append(rng.choice([" ", "\n", "\x0b "]).join(copy).title())
    rng.shuffle(docs)
    return [*enumerate(docs), (9000, None), (9001, ""), (9002, " \n"), (9003, "É a"), (9004, "é a"), (9005, "x y z"), (9006, "X y Z")]


def test_matches_brute_force(spark):
    docs = fixture()
    df = spark.createDataFrame([(i, t, "x") for i, t in docs], "doc_id long, text string, component_id string")
    got = sorted(map(tuple, ngram_join.join(df).collect()))
    assert got == brute(docs)
    assert len({c for *_, c in got}) < len(got) - 50
    assert sorted(map(tuple, ngram_join.join(df.union(df.limit(40))).collect())) == sorted(got + got[:0] + [x for x in got if x[0] in {r.doc_id for r in df.limit(40).collect()}])
    assert ngram_join.join(df.limit(0)).count() == 0


def test_order_changes_nothing(spark, monkeypatch):
    """Frequent shingles by a join instead of a broadcast, full bits, further leaders at once, many splits."""
    monkeypatch.setattr(ngram_join, "HOT_LEAST", 1)
    monkeypatch.setattr(ngram_join, "HOT_BROADCAST", 0)
    monkeypatch.setattr(ngram_join, "REPEAT_BITS", 10)
    monkeypatch.setattr(ngram_join, "AGAIN", 0)
    docs = fixture(120)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    assert sorted(map(tuple, ngram_join.join(df).collect())) == brute(docs)


def test_signature_bounds_intersection():
    rng = np.random.default_rng(1)
    for _ in range(300):
        a, b = (np.unique(rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in "ab")
        true = len(set(a.tolist()) & set(b.tolist()))
        assert ngram_join.intersection(a, b) == true
        assert ngram_join.most_shared(ngram_join.signature(a), len(a), ngram_join.signature(b), len(b)) >= true


def test_a_passage_of_unlike_texts(spark):
    """Shingles that 90 unlike texts share, one in each of many partitions, come last and give no pairs."""
    rng = random.Random(8)
    passage = " ".join(f"p{i}" for i in range(30))
    docs = [(i, f"{passage} " + " ".join(f"own{i}x{rng.randrange(10**6)}" for _ in range(20))) for i in range(90)]
    docs += [(100 + i, t) for i, t in docs[:3]]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(30)
    source = ngram_join.common.id_and_text(df, "doc_id", "text")
    counts, _ = ngram_join.frequent(source, 5)
    packed = np.concatenate([np.frombuffer(r.hot, np.uint64) for r in counts.collect()])
    assert len(packed) == 26 and len(set((packed & np.uint64(0xFFFF)).tolist())) == 1
    assert {r.at for r in ngram_join.tiles(ngram_join.sets(source, 5, 80).withColumnRenamed("id", "rep"), 80).collect()} <= set(range(20))
    assert sorted(map(tuple, ngram_join.join(df).collect())) == brute(docs)


def test_ids_with_several_texts(spark):
    docs = [(1, "a b c d e f g"), (1, "q r s t u v w"), (2, "a b c d e f g"), (3, "q r s t u v w"), (None, "a b c d e f g")]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = ngram_join.join(df).collect()
    assert len(got) == 5 and {r.component_id for r in got if r.doc_id == 1} == {1} and all(r.n_shingles == 3 for r in got)


def test_further_links_join_components(spark):
    """Labels of earlier links and further links give the components of all of them."""
    rng = np.random.default_rng(4)
    first, more = ([(int(a), int(b)) for a, b in rng.integers(0, 60, (n, 2)) if a != b] for n in (35, 15))
    up = {x: x for pair in first + more for x in pair}
    for _ in up:
        for a, b in first + more:
            up[a] = up[b] = min(up[a], up[b])
    table = lambda pairs: spark.createDataFrame(pairs, "a long, b long")
    label = ngram_join.relabelled(ngram_join.components(table(first)), table(more))
    assert sorted(map(tuple, label.collect())) == sorted(up.items())
