"""Many phrases in many texts: an automaton for each block of phrases, and what lists and quotes make of the hits.

Phrases are dealt to blocks of bounded bytes; each block is one automaton that goes to every task and one pass over the
texts, so neither side of a match is ever joined with all of the other. Defined results: a null or empty phrase stands
nowhere, a null text holds nothing; repeated texts give repeated hits, each phrase once a text; empty tables give none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StringType, StructType

from ..functions.batches import bounded

#: UTF-8 bytes of the phrases of one block (an automaton takes some 50 times as much).
BLOCK_BYTES = 2 << 20


def occurrences(texts: DataFrame, keys: list[str], text: str, phrases: DataFrame, phrase: str, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(keys, phrase): each phrase that stands in a text, once for each row of texts."""
    listed = phrases.select(F.col(phrase).alias("phrase")).filter("phrase != ''").distinct()
    size = listed.agg(F.sum(F.octet_length("phrase"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    schema = StructType([texts.schema[k] for k in keys]).add("phrase", StringType())
    source = texts.filter(F.col(text).isNotNull()).select(*keys, F.col(text).cast("string").alias("body"))
    bounded(texts.sparkSession)
    out = None
    for block in range(blocks):
        own = listed.filter(F.pmod(F.xxhash64("phrase"), F.lit(blocks)) == block)
        found = source.mapInArrow(_search(texts.sparkSession, [r[0] for r in own.collect()], schema), schema)  # a block is bounded
        out = found if out is None else out.union(found)
    return out


def _search(spark, words: list[str], schema: StructType) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    held, fields = spark.sparkContext.broadcast(words), to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import ahocorasick

        automaton = ahocorasick.Automaton()
        for i, word in enumerate(held.value):
            automaton.add_word(word, i)
        automaton.make_automaton()
        for batch in batches if held.value else ():
            rows, hits = [], []
            for row, body in enumerate(batch.column(batch.num_columns - 1)):
                own = sorted({i for _, i in automaton.iter(body.as_py())})
                rows += [row] * len(own)
                hits += own
            taken = batch.take(pa.array(rows, pa.int64())).columns[:-1]
            columns = [c.cast(f.type) for c, f in zip(taken, fields, strict=False)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array([held.value[i] for i in hits], pa.string()).cast(fields[-1].type)], schema=fields)

    return run


def verified_quotes(quotes: DataFrame, pages: DataFrame, normal: Callable[[Column], Column]) -> DataFrame:
    """(id, page, moved): quotes (id, site, page, quote) that stand on their page, or else on the site's first page that
    holds them. Of a phrase's pages on a site only the first one and the quote's own meet the quote."""
    wanted = quotes.select("id", "site", "page", normal(F.col("quote")).alias("phrase"))
    bodies = pages.select("site", F.col("page").alias("found"), normal(F.col("text")).alias("body"))
    hits = occurrences(bodies, ["site", "found"], "body", wanted, "phrase").distinct()
    first = hits.groupBy("site", "phrase").agg(F.min("found").alias("first"))
    own = hits.select("site", "phrase", F.col("found").alias("page"), F.lit(True).alias("here"))
    both = wanted.join(first, ["site", "phrase"]).join(own, ["site", "phrase", "page"], "left")
    here = F.coalesce("here", F.lit(False))
    each = both.select("id", F.struct((~here).alias("moved"), F.when(here, F.col("page")).otherwise(F.col("first")).alias("page")).alias("b"))
    return each.groupBy("id").agg(F.min("b").alias("b")).select("id", "b.page", "b.moved")


def without_listed(found: DataFrame, key: str, pages: DataFrame, phrases: DataFrame, normal: Callable[[Column], Column]) -> DataFrame:
    """found with the URLs left after a check of phrase lists, and whether the list excludes the finding (none is left).

    found: key (unique), list, scope ('page' or 'segment'), urls, text; pages: url, text; phrases: list, phrase. With scope
    `page` those URLs go whose page holds a phrase of the list (the finding's own text stands in for an unknown page);
    with `segment` all of them go if the text does. Without a list nothing goes.
    """
    listed = phrases.select("list", normal(F.col("phrase")).alias("phrase")).distinct()
    by_page = occurrences(pages.select("url", normal(F.col("text")).alias("body")), ["url"], "body", listed, "phrase")
    by_page = by_page.join(listed, "phrase").select("url", "list", F.lit(True).alias("page_hit")).distinct()
    by_text = occurrences(found.select(key, normal(F.col("text")).alias("body")), [key], "body", listed, "phrase")
    by_text = by_text.join(listed, "phrase").select(key, "list", F.lit(True).alias("text_hit")).distinct()
    known = pages.filter("text is not null").select("url", F.lit(True).alias("known")).distinct()
    each = found.select(key, "list", "scope", F.posexplode("urls").alias("at", "url")).join(by_text, [key, "list"], "left")
    each = each.join(known, "url", "left").join(by_page, ["url", "list"], "left")
    hit = F.when((F.col("scope") == "page") & F.col("known"), F.col("page_hit")).otherwise(F.col("text_hit"))
    left = each.filter(~F.coalesce(hit, F.lit(False))).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("at", "url"))).alias("left"))
    out = found.join(left, key, "left").withColumn("urls", F.coalesce(F.transform("left", lambda x: x["url"]), F.array().cast("array<string>")))
    return out.drop("left").withColumn("excluded", F.size("urls") == 0)
