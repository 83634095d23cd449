"""Ranks over all rows or large groups without a task that holds them: ranges in order, and offsets of ranges."""

from __future__ import annotations

import tempfile

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: monotonically_increasing_id() counts the rows of a partition in its low bits.
ROW_BITS = (1 << 33) - 1


def held(df: DataFrame) -> DataFrame:
    """The rows of df in the folder that all executors share, so that they are the same however often they are read."""
    spark = df.sparkSession
    context = spark.sparkContext
    if folder := spark.conf.get("spark.checkpoint.dir", None):
        context.setCheckpointDir(folder)
    elif context.getCheckpointDir() is None:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="sievemark-"))
    return df.checkpoint()


def ranked(df: DataFrame, by: list[str], order: list[str | Column], name: str) -> DataFrame:
    """df with the running number from 1 of each row within its group (all rows, if `by` is empty) in the given order.

    Rows are dealt to ranges of (by, order), sorted there and numbered; a range starts where those before it end. What is
    added up is one row for each range and group in it, so a group of any size spreads over many tasks. Equal rows share
    out consecutive numbers, rows equal in `order` in no set way; null groups are a group; an empty table stays empty.
    """
    columns = df.columns
    dealt = df.repartitionByRange(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *by, *order)
    row = F.monotonically_increasing_id()
    dealt = held(dealt.sortWithinPartitions(*by, *order).withColumns({"_range": F.shiftright(row, 33), "_row": row.bitwiseAND(F.lit(ROW_BITS))}))
    group = F.struct(*by) if by else F.lit(0)
    dealt = dealt.withColumn("_group", group)
    sizes = dealt.groupBy("_group", "_range").agg(F.count("*").alias("n"), F.min("_row").alias("_first"))
    # a group's ranges, at most as many as there are partitions, stand in one array
    each = sizes.groupBy("_group").agg(F.array_sort(F.collect_list(F.struct("_range", "n", "_first"))).alias("ranges")).select("_group", "ranges", F.posexplode("ranges").alias("at", "r"))
    before = F.aggregate(F.slice("ranges", F.lit(1), F.col("at")), F.lit(0).cast("long"), lambda total, r: total + r["n"])
    starts = each.select("_group", F.col("r._range").alias("_range"), (before - F.col("r._first") + 1).alias("_shift"))
    return dealt.join(starts, ["_group", "_range"]).select(*columns, (F.col("_row") + F.col("_shift")).alias(name))
