"""Tiers, discounts and lists of prices. All tables of prices are checked to be small before they are broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MOST_ROWS = 10_000


def small(df: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """df marked for broadcast, after a check of its size."""
    if df.limit(most + 1).count() > most:
        raise ValueError(f"a table of prices holds at most {most} rows")
    return F.broadcast(df)


def tier(df: DataFrame, count: str, tiers: DataFrame) -> DataFrame:
    """Join the tier (code, low, high) whose bounds, both inclusive, hold count; a null high is open."""
    within = (F.col(count) >= F.col("low")) & (F.col("high").isNull() | (F.col(count) <= F.col("high")))
    return df.join(small(tiers), within, "left")


def as_of(df: DataFrame, key: str, steps: DataFrame, at: str, value: str) -> DataFrame:
    """Add `value` of the last step with at <= key (null: none). The steps, checked to be few, become one sorted array in each row."""
    small(steps)
    rows = F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), F.col(value).alias("v"))))
    table = F.broadcast(steps.agg(rows.alias("steps")))
    found = F.try_element_at(F.filter("steps", lambda s: s["at"] <= F.col(key)), F.lit(-1))
    return df.join(table).withColumn(value, found["v"]).drop("steps")


def tier_faults(tiers: DataFrame) -> DataFrame:
    """Gaps and overlaps between tiers in order of low."""
    w = Window.partitionBy(F.lit(1)).orderBy("low")  # a price list: bounded by small()
    n = small(tiers).withColumn("next", F.lead("low").over(w))
    fault = F.when(F.col("next") > F.col("high") + 1, "gap").when((F.col("next") <= F.col("high")) | F.col("high").isNull(), "overlap")
    return n.filter("next is not null").withColumn("fault", fault).filter("fault is not null").select("code", "fault")


def list_faults(tiers: DataFrame, key: str, code: str) -> DataFrame:
    """Gaps and overlaps (key, code, fault) between neighbouring tiers (low, high) of many price lists, one for each key.

    A tier without an upper bound must be the last of its list. Lists are short; their number doesn't matter.
    """
    w = Window.partitionBy(key).orderBy("low", code)
    n = tiers.withColumn("next", F.lead("low").over(w)).filter("next is not null")
    fault = F.when(F.col("next") > F.col("high") + 1, "gap").when((F.col("next") <= F.col("high")) | F.col("high").isNull(), "overlap")
    return n.withColumn("fault", fault).filter("fault is not null").select(key, code, "fault")


def first_of_keys(df: DataFrame, other: DataFrame, keys: list[str], value: str, row: str) -> DataFrame:
    """A left join on any of several keys, the earlier key first: a union of equi joins, never an OR."""
    found = None
    for i, key in enumerate(keys):
        part = df.join(other, df[key] == other[key]).select(df[row].alias(row), F.lit(i).alias("_i"), other[value].alias(value))
        found = part if found is None else found.union(part)
    best = found.groupBy(row).agg(F.min_by(value, F.struct("_i", value)).alias(value))
    return df.join(best, row, "left")
