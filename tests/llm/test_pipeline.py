import hashlib
import re
from collections import Counter

import corpus_pipeline
import duckdb
from test_decontamination import brute as brute_hits
from test_decontamination import cut
from test_ngram_join import brute as brute_groups
from tokenizers import Tokenizer

from sievemark.llm import bpe, common, line_dedup, quality

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_against_brute_force(spark):
    docs = common.table(spark, SF, "documents")
    outs, at = [], docs
    for name, stage in corpus_pipeline.STAGES:
        at = common.written(stage(spark, at, SF), f"test-{name}")
        outs.append(at)
    assert all(sorted(o.columns) == sorted(COLUMNS) for o in outs[:-1])
    rows = [{r.doc_id: r for r in o.collect()} for o in (docs, *outs)]
    good = {r.id for r in quality.score_documents(docs, quality.trained(docs, common.table(spark, SF, "labels"))).collect() if r.score >= 0.3}
    assert set(rows[1]) == good and all(rows[1][i] == rows[0][i] for i in good)
    documents = outs[0].toPandas()  # noqa: F841
    copies = {t for t, n in Counter(r.text for r in rows[1].values()).items() if n > 1}
    for r in duckdb.sql(line_dedup.ORACLE).df().itertuples():
        if rows[2][r.doc_id].text != rows[1][r.doc_id].text or rows[1][r.doc_id].text not in copies:
            assert hashlib.sha256(rows[2][r.doc_id].text.encode()).hexdigest() == r.clean_sha256
    groups = brute_groups([(i, r.text) for i, r in rows[2].items()])
    assert set(rows[3]) == {i for i, _, c in groups if i == c}
    items = [(r.item_id, r.text) for r in common.table(spark, SF, "benchmark").collect()]
    for i, r in rows[3].items():
        if not brute_hits(r.text, items)[4]:
            assert rows[4][i] == r
            continue
        words = lambda t: re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        left = cut(words(r.text), [(k, " ".join(words(t or ""))) for k, t in items])
        assert (words(rows[4][i].text) == left and rows[4][i].n_chars == len(rows[4][i].text)) if i in rows[4] else not left
    library = Tokenizer.from_file(bpe.vocabulary_path())
    assert {i: r.n_tokens for i, r in rows[5].items()} == {i: len(library.encode(r.text).ids) for i, r in rows[4].items()}


def test_odd_documents(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    more = "items string, spans string, n_words string, id string, contaminated string, row string, component_id string, class string"
    odd = [(1, None, None, None, None), (2, "", "en", "a", 0), (3, "a b c d e f", "en", "a", 11), (3, "a b c d e f", "en", "a", 11), (None, "x y", "en", None, 3)]
    for docs in (spark.createDataFrame(odd, schema), spark.createDataFrame([], schema), spark.createDataFrame([(*r, *"abcdefgh") for r in odd], f"{schema}, {more}")):
        at = docs
        for _, stage in corpus_pipeline.STAGES[1:]:
            at = common.written(stage(spark, at, SF), "odd")
        assert at.count() == (4 if docs.count() else 0)
