"""Python steps get batches of bounded bytes, whatever the rows of a partition."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from sievemark.functions import batches, documents
from sievemark.functions import text as T
from sievemark.operators import paragraphs, phrases, templates, workflow
from sievemark.sources import elements, pages

BOUND = "spark.sql.execution.arrow.maxBytesPerBatch"


def test_a_batch_is_bounded_in_bytes(spark):
    @batches.bounded_udf("long")
    def rows(x: pd.Series) -> pd.Series:
        return pd.Series([len(x)] * len(x))

    df = spark.range(0, 3000, 1, 1).select(F.repeat(F.lit("x"), 10_000).alias("t"))
    spark.conf.unset(BOUND)
    assert df.select(rows("t").alias("n")).agg(F.max("n")).first()[0] <= batches.BATCH_BYTES // 10_000 + 1


STEPS = {
    "parsed": lambda df: pages.parsed(df),
    "products": lambda df: pages.products(df.select("id", F.array("html").alias("json_ld"))),
    "judged": lambda df: elements.judged(df),
    "subtrees": lambda df: elements.subtrees(df),
    "paragraphs": lambda df: paragraphs.paragraphs(df.select("id", F.array(F.struct(F.lit("main").alias("region"), F.lit(0).alias("heading_level"), F.col("html").alias("text"))).alias("blocks"))),
    "clusters": lambda df: templates.clusters(df.select("url", "id", F.array("html").alias("tokens")), "url", "id", "tokens"),
    "occurrences": lambda df: phrases.occurrences(df, ["id"], "html", df.select("url"), "url"),
    "placed": lambda df: df.select(workflow.placed(F.col("html"), F.array(F.struct(F.lit("a").alias("old"), F.lit("b").alias("new"))))),
    "rewritten": lambda df: workflow.rewritten(df, "html"),
    "strip_marks": lambda df: df.select(T.strip_marks("html")),
    "split_sentences": lambda df: df.select(T.split_sentences("html")),
    "canonical": lambda df: df.select(documents.canonical("html"), documents.without_text("html")),
}


@pytest.mark.parametrize("name", STEPS)
def test_every_step_is_bounded(spark, name):
    df = spark.createDataFrame([(1, 1, "u", "<p>a b</p>")], "page_id long, id long, url string, html string")
    spark.conf.unset(BOUND)
    STEPS[name](df).count()
    assert int(spark.conf.get(BOUND)) == batches.BATCH_BYTES


def test_clusters_over_batches(spark):
    """Sites of more shapes than a batch holds: leaders last over batches and end with the site."""
    rows = [(None if i % 7 == 6 else f"s{i % 3}", i, [f"{'t' * 30_000}{k}" for k in range(1 + i % 5)] + [str(i % 31)]) for i in range(400)]
    df = spark.createDataFrame(rows, "site string, at long, tokens array<string>")
    got = sorted(map(tuple, templates.clusters(df, "site", "at", "tokens").collect()))
    want, leaders = [], {}
    for site, at, tokens in rows:
        if site is not None:
            own = set(tokens)
            hit = next((a for a, t in leaders.setdefault(site, []) if len(own & t) >= 0.75 * len(own | t)), None)
            if hit is None:
                leaders[site].append((at, own))
            want.append((site, at, at if hit is None else hit))
    assert got == sorted(want)
