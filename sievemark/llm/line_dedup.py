"""Cross-site line removal by distinct-site spread, in DataFrame functions only.

HyperLogLog sketches of the sites of every line are merged by aggregation. A line whose estimate is far from the
threshold is decided by it; lines near it get an exact distinct count. A line found on at least `min_sites` sites is
boilerplate and goes from every document, whatever share of it such lines hold. Only where `max_share` is given, a
document in which they hold more than that share of the characters stays whole if its whole text stands in a document of
another id: it is proven a copy, and near-duplicate removal takes it (`copy` marks such documents).

A line is what stands between line breaks, without spaces, tabs and carriage returns around it; lines under `min_chars`
characters (empty ones, by default) are never boilerplate. Defined results: a null text is empty, and an empty one has one empty line;
a null site counts as none; rows with a null id are cleaned like others; repeated rows get equal results; only the named columns are read; an empty
table gives an empty result. Texts are taken whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

MIN_SITES, MIN_CHARS = 10, 1
#: log2 of a sketch's registers (standard error 1.6 %), and how far from the threshold an estimate decides alone.
REGISTERS, MARGIN = 12, 0.2
EDGES = " \t\r"


def trimmed(line: Column) -> Column:
    return F.trim(line, F.lit(EDGES))


def boilerplate(lines: DataFrame, min_sites: int, margin: float = MARGIN) -> DataFrame:
    """(h1, h2) of the lines (h1, h2, site) that stand on at least min_sites sites."""
    spread = lines.groupBy("h1", "h2").agg(F.hll_sketch_agg("site", REGISTERS).alias("sketch"))
    spread = spread.select("h1", "h2", F.hll_sketch_estimate("sketch").alias("sites"))
    wide = common.written(spread.filter(F.col("sites") >= min_sites * (1 - margin)), "wide")
    near = wide.filter(F.col("sites") <= min_sites * (1 + margin)).select("h1", "h2")
    exact = lines.join(near, ["h1", "h2"], "left_semi").filter("site is not null").groupBy("h1", "h2", "site").agg(F.lit(1).alias("one"))
    exact = exact.groupBy("h1", "h2").agg(F.count("*").alias("sites")).filter(F.col("sites") >= min_sites)
    return wide.filter(F.col("sites") > min_sites * (1 + margin)).select("h1", "h2").union(exact.select("h1", "h2"))


def dedup(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    site_col: str = "source",
    min_sites: int = MIN_SITES,
    min_chars: int = MIN_CHARS,
    max_share: float | None = None,
    carry: bool = False,
) -> DataFrame:
    """id, text without boilerplate lines, n_lines, n_removed and copy (whether it was left whole as a copy).

    With carry, a column `row` holds the whole row of df besides.
    """
    more = [F.struct(*[df[c] for c in df.columns]).alias("row")] if carry else []
    docs = df.select(
        *more,
        df[id_col].alias("id"),
        F.coalesce(df[text_col], F.lit("")).alias("text"),
        df[site_col].cast("string").alias("site"),
    )
    exploded = docs.select(
        "id", "site", F.xxhash64("text").alias("key"), F.explode(F.split("text", "\n")).alias("raw")
    ).select("id", "site", "key", trimmed(F.col("raw")).alias("line"))
    lines = exploded.filter(F.length("line") >= min_chars).select(
        "id", "site", "key",
        F.xxhash64("line").alias("h1"), F.xxhash64(F.lit(1), "line").alias("h2"),
    )
    found = boilerplate(lines, min_sites)
    own = lines.select("id", "key", "h1", "h2").join(found, ["h1", "h2"])
    own = common.written(own.groupBy("id", "key").agg(F.collect_set(F.struct("h1", "h2")).alias("removed")), "own")
    # the copies of a text with found lines have those lines too, so all of them are in own
    if max_share is None:
        own = own.withColumn("twice", F.lit(False))
    else:
        twice = own.groupBy("key").agg(F.min("id").alias("low"), F.max("id").alias("high")).filter("low != high")
        own = own.join(twice.select("key", F.lit(True).alias("twice")), "key", "left")
    own = own.withColumnsRenamed({"id": "own_id", "key": "own_key"})
    docs = docs.withColumn("key", F.xxhash64("text"))
    joined = docs.join(own, F.col("id").eqNullSafe(F.col("own_id")) & (F.col("key") == F.col("own_key")), "left")
    parts = F.split("text", "\n")
    is_removed = lambda x: F.coalesce(
        (F.length(trimmed(x)) >= min_chars) & F.array_contains("removed", F.struct(F.xxhash64(trimmed(x)).alias("h1"), F.xxhash64(F.lit(1), trimmed(x)).alias("h2"))), F.lit(False)
    )
    chars = lambda lines: F.aggregate(lines, F.lit(0), lambda n, x: n + F.length(trimmed(x)))
    kept = F.when(F.col("removed").isNull(), parts).otherwise(F.filter(parts, lambda x: ~is_removed(x)))
    copy = F.col("twice") & (chars(parts) - chars(kept) > (max_share or 0) * chars(parts))
    more = ["row"] if carry else []
    out = joined.select(*more, "id", "text", parts.alias("all"), kept.alias("kept"), F.coalesce(copy, F.lit(False)).alias("copy"))
    return out.select(
        *more,
        "id",
        F.when(F.col("copy") | (F.size("kept") == F.size("all")), F.col("text"))
        .otherwise(F.array_join("kept", "\n"))
        .alias("text"),
        F.size("all").cast("long").alias("n_lines"),
        F.when(F.col("copy"), 0).otherwise(F.size("all") - F.size("kept")).cast("long").alias("n_removed"),
        "copy",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup(common.table(spark, sf_dir, "documents"))
    return out.select(
        F.col("id").alias("doc_id"), "n_lines", "n_removed", F.sha2("text", 256).alias("clean_sha256")
    )


ORACLE = f"""
with docs as (select doc_id, coalesce(text, '') as text, source from documents),
lines as (select doc_id, source, i, string_split(text, chr(10))[i] as raw
  from docs, unnest(range(1, len(string_split(text, chr(10))) + 1)) as u(i)),
keyed as (select *, trim(raw, ' ' || chr(9) || chr(13)) as line from lines),
wide as (select line from keyed where length(line) >= {MIN_CHARS} group by line
  having count(distinct source) >= {MIN_SITES}),
marked as (select keyed.*, wide.line is not null as gone from keyed left join wide on keyed.line = wide.line),
sums as (select doc_id, count(*) as n_lines, count(*) filter (gone) as n_gone,
  string_agg(raw, chr(10) order by i) filter (not gone) as rest from marked group by doc_id)
select doc_id, n_lines, n_gone as n_removed, sha256(coalesce(rest, '')) as clean_sha256 from sums
"""
