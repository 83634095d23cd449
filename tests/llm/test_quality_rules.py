import duckdb
import pandas as pd
from pyspark.sql import functions as F

from sievemark.llm import quality_rules as rules

LONG = " ".join(f"w{i % 977}x{i * i % 1009}" for i in range(30_000))
TEXTS = [
    None, "", " \n\t ", "one", "a b c d e a b c d e a b c", "a " * 40, "x y z w v\n" * 9, "Ünï çöde wörds hére änd thêre, ünd so weiter immer fort",
    "THE QUICK BROWN FOX JUMPED OVER ALL THOSE LAZY DOGS AGAIN", "a\x0bb\x0cc\x1cd e f g h i j k l", "- a b\n* c d\n• e f\n- g h i j k l m n o p",
    "word | word # other $ thing % here & now < then > later * so", "so it goes...\nand on…\nand then some more words here", "1 2 3 4 5 6 7 8 9 10 11 12", LONG, LONG + " " + LONG[:400],
]


def rows():
    return [(i, t, f"s{i % 2}") for i, t in enumerate(TEXTS)] + [(4, TEXTS[4], "s0"), (None, "a null id has its row too", None)]


def brute(text):
    words = (text or "").translate(str.maketrans("\t\n\x0b\x0c\r", "     ")).split(" ")
    words = [w for w in words if w]
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    times = pd.Series(grams, dtype=object).value_counts().to_dict()
    hit = {i + k for i, g in enumerate(grams) if times[g] > 1 for k in range(5)}
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    return len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit)


def test_measurements(spark):
    df = spark.createDataFrame(rows(), "doc_id long, text string, words string")
    df = df.withColumn("failed", F.lit("x")).withColumn("sorted", F.lit(1))
    got = rules.verdicts(rules.ledger(df)).collect()
    assert len(got) == len(TEXTS) + 2
    for r in got:
        want = brute(TEXTS[r.doc_id] if r.doc_id is not None else "a null id has its row too")
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        base = r.n_words < 10 or 100 * r.n_repeat_words > 20 * r.n_words
        assert r.base_failed == base and not (base and r.kept)
    kept = {r.doc_id for r in got if r.kept}
    assert {7, 8, 14} <= kept and not kept & {11, 13}  # all upper case alone is one soft failure
    assert rules.ledger(df.limit(0)).count() == 0


def test_same_as_sql(spark):
    held = [r for r in rows()[:-2] if r[1] != LONG]
    documents = pd.DataFrame(held, columns=["doc_id", "text", "source"])  # noqa: F841
    want = {r[0]: r for r in duckdb.sql(rules.ORACLE).fetchall()}
    df = spark.createDataFrame(held, "doc_id long, text string, source string")
    names = ["doc_id", *rules.MEASURES, "failed", "base_failed", "kept"]
    got = rules.verdicts(rules.ledger(df)).select(*names).collect()
    assert len(got) == len(want) and all(tuple(r) == want[r.doc_id] for r in got)


def test_policies_over_a_stored_ledger(spark, tmp_path):
    """Ablations from bit patterns equal those from every row, for every policy."""
    bits = [(i * 37 + i // 3) % 1024 for i in range(500)] + [0] * 40
    at = str(tmp_path / "ledger")
    spark.createDataFrame([(i, b, i % 7) for i, b in enumerate(bits)], "doc_id long, failed long, site int").write.parquet(at)
    ledger = spark.read.parquet(at)

    def keeps(p, b, without=0):
        hard, soft = p.hard & ~without, p.soft & ~without
        return b & hard == 0 and (b & soft).bit_count() <= p.allowed

    got = {(r.policy, r.rule): (r.fails, r.goes, r.alone) for r in rules.ablations(ledger).collect()}
    want = {}
    for p in rules.POLICIES:
        for name, bit in rules.BIT.items():
            if (p.hard | p.soft) & bit:
                gone = [b for b in bits if not keeps(p, b)]
                want[p.version, name] = (sum(b & bit > 0 for b in bits), len(gone), sum(keeps(p, b, bit) for b in gone))
    assert got == want
    for p in rules.POLICIES:
        kept = {r.doc_id for r in rules.verdicts(ledger, p).filter("kept").collect()}
        assert kept == {i for i, b in enumerate(bits) if keeps(p, b)}
    for r in rules.spread(ledger, "site").collect():
        own = [b for i, b in enumerate(bits) if i % 7 == r.site]
        any_, all_ = 0, -1
        for b in own:
            any_, all_ = any_ | b, all_ & b
        assert (r.n, r.any_failed, r.all_failed) == (len(own), any_, all_)
    assert rules.ablations(ledger.limit(0)).count() == 0


def test_no_python_and_no_shuffle(spark):
    plan = rules.ledger(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Exchange", "Python", "Arrow", "Pandas"))
