"""Sentences de-duplicated: plain Python, and what goes through shuffles."""

from sievemark.operators import segments


def test_dedupe_is_a_plain_fold_and_its_keys_are_short(spark):
    rows = [(d, p, f"s{d % 3 if p else 0}", f"{'Ab' if d % 2 else 'aB'} {(d * 7 + p) % 900}.") for d in range(500) for p in range(8)]
    df = spark.createDataFrame(rows, "doc long, pos int, site string, sentence string").repartition(2).localCheckpoint()
    before = written(spark)
    got = segments.dedupe(df, "doc", "site").collect()
    want = {}
    for d, p, site, text in rows:  # in the order of documents and places
        w = want.setdefault(text.lower(), [text, 0, set(), []])
        w[1] += 1
        w[2].add(d)
        w[3] += [site] * (site not in w[3])
    assert sorted((r.text, r.occurrences, r.documents, r.sites) for r in got) == sorted((t, n, len(d), s) for t, n, d, s in want.values())
    assert all(r.hash.startswith("sha256:") and len(r.hash) == 71 for r in got)
    per_row = (written(spark) - before) / len(rows)
    assert per_row < MOST_BYTES, per_row


#: Shuffled bytes a sentence: 104 as it is, 164 with digests as text in every shuffle.
MOST_BYTES = 130


def written(spark):
    """Bytes that all stages so far have written to shuffles."""
    jvm = spark._jvm
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), None)
    return sum(s.shuffleWriteBytes() for s in jvm.scala.jdk.javaapi.CollectionConverters.asJava(stages))
