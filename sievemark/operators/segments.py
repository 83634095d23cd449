"""Sentences, their context, de-duplication and boilerplate."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T


def sentences(df: DataFrame, key: str, body: str, *keep: str) -> DataFrame:
    """(key, keep..., pos, sentence), a row for each sentence in order; a null text has none."""
    return df.select(key, *keep, F.posexplode(T.sentences(F.col(body))).alias("pos", "sentence"))


def with_context(df: DataFrame, key: str, before: int = 2, after: int = 2) -> DataFrame:
    """The sentences around each one, joined by spaces. Short fragments stay in the frame; filter afterwards."""
    order = Window.partitionBy(key).orderBy("pos")
    around = lambda a, b: F.concat_ws(" ", F.collect_list("sentence").over(order.rowsBetween(a, b)))
    return df.withColumn("before", around(-before, -1)).withColumn("after", around(1, after))


def dedupe(df: DataFrame, key: str, site: str) -> DataFrame:
    """One row per normalized sentence: hash, the first text, occurrences, documents, and sites as first seen.

    Rows are first cut down to one for each sentence, document and site, and those to one for each sentence and site, so a
    frequent sentence gathers its sites only. Digests are binary until the end, so that they sort by their first bytes.
    """
    hashed = df.select(key, "pos", F.col(site).alias("site"), "sentence", F.unhex(F.sha2(F.concat_ws("\x1f", T.normalized(F.col("sentence"))), 256)).alias("digest"))
    at = F.struct(key, "pos")
    first = hashed.groupBy("digest", "site").agg(F.min(F.struct(at.alias("at"), F.col("sentence").alias("text"))).alias("first"), F.count("*").alias("n"))
    documents = hashed.groupBy("digest").agg(F.count_distinct(F.col(key)).alias("documents"))
    sites = F.transform(F.array_sort(F.collect_list(F.struct("first.at", "site"))), lambda r: r["site"])
    whole = first.groupBy("digest").agg(F.min("first")["text"].alias("text"), F.sum("n").alias("occurrences"), sites.alias("sites"))
    name = F.concat(F.lit("sha256:"), F.lower(F.hex("digest"))).alias("hash")
    return whole.join(documents, "digest").select(name, "text", "occurrences", "documents", "sites")


def boilerplate(df: DataFrame, key: str, site: str, least: int = 3, share: float = 0.3) -> DataFrame:
    """Per site and normalized sentence: documents that hold it, and whether they are many and more than `share`."""
    norm = df.select(site, key, T.normalized(F.col("sentence")).alias("norm"))
    totals = norm.groupBy(site).agg(F.count_distinct(key).alias("total"))
    counts = norm.groupBy(site, "norm").agg(F.count_distinct(key).alias("pages"))
    flag = (F.col("pages") >= least) & (F.col("pages") > share * F.col("total"))
    return counts.join(totals, site).withColumn("boilerplate", flag)


def chunks(df: DataFrame, key: str, order: str, body: str, most: int = 600) -> DataFrame:
    """(key, chunk, text): consecutive blocks joined by line breaks up to `most` characters; a block is never split.

    The blocks of one key (a page) are folded in order; they come together in one row, as a page's text does.
    """
    blocks = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(body).alias("t")))), lambda b: b["t"])
    fold = lambda done, t: F.when(
        (F.size(done) > 0) & (F.length(F.coalesce(F.try_element_at(done, F.lit(-1)), F.lit(""))) + 1 + F.length(t) <= most),
        F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(F.concat(F.try_element_at(done, F.lit(-1)), F.lit("\n"), t))),
    ).otherwise(F.concat(done, F.array(t)))
    whole = df.filter(F.col(body).isNotNull()).groupBy(key).agg(blocks.alias("blocks"))
    folded = F.aggregate("blocks", F.array().cast("array<string>"), fold)
    return whole.select(key, F.posexplode(folded).alias("chunk", "text"))
