"""A training corpus from raw documents, in stages that are each written as Parquet and read again.

1. quality: documents that the quality classifier rejects go.
2. lines: cross-site boilerplate lines go from the texts of the others; mostly copied documents stay whole, for stage 3.
3. near: of documents that link by shared word shingles, directly or through others, the one of smallest id stays.
4. benchmark: words inside occurrences of benchmark windows are cut out, also where a cut makes one; documents of which
   nothing is left go.
5. tokens: every text is encoded and decoded; the result has counts and digests.

Stages 1 to 4 return the columns of documents; n_chars follows the text. Defined results: a null text counts as empty;
an empty document goes or stays by its quality score and links with nothing; repeated rows of one id are one
document after stage 3 (the least of them as JSON where they differ); empty tables give empty results. Texts are processed whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievemark.llm import bpe, common, decontamination, line_dedup, ngram_join, quality

#: A document with a copy under another id stays whole if boilerplate lines hold more than this share of it.
MAX_SHARE = 0.5
#: Up to so many ids (at most 32 bytes each in memory) go to every task; beyond that documents are shuffled by id.
BROADCAST_IDS = 2_000_000


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    trees = quality.trained(common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "labels"))
    return quality.keep_good(docs, trees)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _with_text(line_dedup.dedup(docs, carry=True, max_share=MAX_SHARE), docs)


def _with_text(out: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of docs from out.row, with out.text and its length in place of the old ones."""
    new = {"text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return out.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    joined = common.written(ngram_join.join(docs), "joined")
    linked = joined.filter("doc_id != component_id").select("doc_id")
    gone = linked.distinct()
    if linked.count() <= BROADCAST_IDS:
        gone = F.broadcast(gone)
    repeated = joined.groupBy("doc_id").count().filter("count > 1 and doc_id is not null").select("doc_id")
    kept = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    if repeated.isEmpty():
        return kept
    whole = F.struct(*[F.col(c) for c in docs.columns])
    once = kept.join(repeated, "doc_id", "left_semi").groupBy("doc_id").agg(F.min_by(whole, F.to_json(whole)).alias("row"))
    once = once.select(*[F.col("row")[c].alias(c) for c in docs.columns])
    return kept.join(repeated, "doc_id", "left_anti").select(*docs.columns).union(once)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rest = tuple(c for c in docs.columns if c not in ("doc_id", "text", "n_chars"))
    out = decontamination.removed(docs, common.table(spark, sf_dir, "benchmark"), carry=rest)
    left = out.filter(~F.col("contaminated") | F.col("text").rlike("\\S"))
    new = {"doc_id": F.col("id"), "text": F.col("text"), "n_chars": F.char_length("text").cast("long")}
    return left.select(*[new[c].alias(c) if c in new else F.col("row")[c].alias(c) for c in docs.columns])


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(docs)


STAGES = [
    ("quality", quality_stage),
    ("lines", line_stage),
    ("near", near_stage),
    ("benchmark", benchmark_stage),
    ("tokens", token_stage),
]

#: SQL can express neither the trained classifier nor the byte-pair merges; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
