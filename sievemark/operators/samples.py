"""Sample plans: the mandatory pages of a site's versions, then pages of its versions in turn by a seeded order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sample_plan(pages: DataFrame, budget: int, seed: int) -> DataFrame:
    """(site, place, url, version, kind) of at most `budget` pages of each site, in order of place from 1.

    pages: site, version, turn (the version's place), url, mandatory, ord (place among the mandatory pages). A URL is
    planned once: as mandatory if any version says so, for the version of least turn that has it. The others come one of
    each version at a time, by the hash of seed and URL, so the plan is the same however rows are dealt. Both ranks are
    limited to the budget, which Spark applies before it shuffles: of a hot site or version no more than `budget` rows a
    task travel. A null URL is no page; repeated rows count once; an empty table gives an empty plan.
    """
    order = F.struct((~F.col("mandatory")).alias("m"), "turn", "ord", "version")
    once = pages.filter("url is not null").groupBy("site", "url").agg(F.min(order).alias("o"))
    once = once.select("site", "url", F.col("o.m").alias("product"), "o.turn", "o.version", "o.ord")
    drawn = F.md5(F.concat(F.lit(f"{seed}:"), "url"))
    key = F.when(F.col("product"), drawn).otherwise(F.lpad(F.coalesce(F.col("ord").cast("string"), F.lit("")), 20, "0"))
    lanes = Window.partitionBy("site", "product", "turn", "version").orderBy("key", "url")
    some = once.withColumn("key", key).withColumn("round", F.row_number().over(lanes)).filter(F.col("round") <= budget)
    # mandatory pages go version by version, the others round by round
    round = F.when(F.col("product"), F.col("round")).otherwise(0)
    whole = Window.partitionBy("site").orderBy("product", round, "turn", "version", "key", "url")
    placed = some.withColumn("place", F.row_number().over(whole)).filter(F.col("place") <= budget)
    kind = F.when(F.col("product"), "product").otherwise("mandatory")
    return placed.select("site", F.col("place").cast("long").alias("place"), "url", "version", kind.alias("kind"))
