"""Findings of runs merged into stored tables by identity, and their occurrences inserted once.

A finding is identified by shop, rule and scope, and in scope segment by the text's hash too. Its id is a digest of these,
so a run that is repeated, or resumed after half of its tables were written, writes the same rows again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

IDENTITY = ("shop", "rule", "scope", "segment")
#: Folders of a stored table by the shop's hash; a run rewrites those of its shops only.
BUCKETS = 64


def identified(found: DataFrame) -> DataFrame:
    """found with segment (null in scope site) and finding_id."""
    segment = F.when(F.col("scope") == "segment", F.col("segment").cast("string"))
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\x00")) for c in IDENTITY]
    return found.withColumn("segment", segment).withColumn("finding_id", F.md5(F.concat_ws("\x1f", *parts)))


def run_findings(found: DataFrame, run: int) -> DataFrame:
    """One row for each identity of a run's findings (shop, rule, scope, segment, severity, score, page): the strictest.

    Strictest: least severity, then highest score, then least page; `occurrences` counts the distinct pages.
    """
    first = F.struct("severity", (-F.col("score")).alias("s"), "page")
    out = identified(found).groupBy("finding_id", *IDENTITY).agg(F.min(first).alias("x"), F.min("page").alias("page"), F.count_distinct("page").alias("occurrences"))
    return out.select(
        "finding_id", *IDENTITY, F.col("x.severity").alias("severity"), (-F.col("x.s")).alias("score"), "page", "occurrences",
        F.lit("open").alias("status"), F.lit(run).cast("long").alias("first_run"), F.lit(run).cast("long").alias("last_run"),
    )


def merged(old: DataFrame, new: DataFrame) -> DataFrame:
    """Stored and new findings: status and first run of the stored row stay, the page too if the new one has none; all
    else is the new one's. A finding that the run doesn't have stays as it is. Repeated keys on a side count once."""
    both = old.withColumn("_at", F.lit(0)).unionByName(new.withColumn("_at", F.lit(1)))
    keep = {"status": F.min_by, "first_run": F.min_by}
    latest = lambda c: keep.get(c, F.max_by)(F.col(c), F.col("_at")).alias(c)
    page = F.max_by("page", F.when(F.col("page").isNotNull(), F.col("_at"))).alias("page")
    out = both.groupBy("finding_id").agg(*[page if c == "page" else latest(c) for c in old.columns if c != "finding_id"])
    return out.select(*old.columns)


def occurrences(found: DataFrame, run: int) -> DataFrame:
    """(finding_id, shop, page, run): the pages that hold a finding."""
    return identified(found).filter("page is not null").select("finding_id", "shop", "page", F.lit(run).cast("long").alias("run")).distinct()


def inserted(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Old rows, and new ones whose keys none of them has (insert or ignore; get or insert of ids): of equal keys the old
    row stays, and among several the one of least `order`. Null keys are equal."""
    columns = old.columns
    row = F.struct(*[F.col(c) for c in columns])
    both = old.withColumn("_at", F.lit(0)).unionByName(new.withColumn("_at", F.lit(1)))
    return both.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min_by(row, F.struct("_at", order)).alias("r")).select("r.*")


def _stored(spark: SparkSession, path: str, like: DataFrame) -> DataFrame:
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    if not folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(folder):
        return like.limit(0)
    return spark.read.schema(like.schema).parquet(path)


def store(spark: SparkSession, folder: str, found: DataFrame, run: int) -> None:
    """Merge a run's findings into `folder`/findings and `folder`/occurrences.

    Only the buckets of the run's shops are read and replaced, each by a rename once its files are whole (dynamic
    partition overwrite), so a run that fails half-way can be started again.
    """
    bucket = F.pmod(F.xxhash64("shop"), F.lit(BUCKETS)).cast("int")
    touched = [r.bucket for r in found.select(bucket.alias("bucket")).distinct().collect()]  # at most BUCKETS
    for name, new, merge in (
        ("occurrences", occurrences(found, run), lambda a, b: inserted(a, b, ["finding_id", "page"], "run")),
        ("findings", run_findings(found, run), merged),
    ):
        path, new = f"{folder}/{name}", new.withColumn("bucket", bucket)
        old = _stored(spark, path, new).filter(F.col("bucket").isin(touched))
        out = merge(old, new).repartition(max(1, len(touched)), "bucket")
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
