"""Sinks and further sources: reports, answer caches, partitioned event tables, SQL databases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def tenant(df: DataFrame, column: str, value: object) -> DataFrame:
    """Rows of one tenant. Without a tenant this is an error, never an empty result."""
    if value is None or value == "":
        raise ValueError("a tenant is needed")
    return df.filter(F.col(column) == F.lit(value))


def cached_answers(wanted: DataFrame, cache: DataFrame, keys: list[str], scorer) -> DataFrame:
    """Answers from the cache where it has them, and scorer(the other rows) for the rest; columns keys and p."""
    hits = wanted.join(cache, keys).select(*keys, "p")
    fresh = scorer(wanted.join(cache, keys, "left_anti"))
    return hits.unionByName(fresh.select(*keys, "p"))


def joined(values: Column, separator: str = "|") -> Column:
    return F.array_join(values, separator)


def findings_csv(df: DataFrame, path: str) -> None:
    """Findings as CSV, one row each, arrays joined by |, a header in every file."""
    flat = df.select(*[joined(F.col(c).cast("array<string>")).alias(c) if t.startswith("array") else F.col(c) for c, t in df.dtypes])
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def export_csv(df: DataFrame, path: str, order: list[str], most: int = 50_000) -> bool:
    """A bounded export with ; and CRLF; returns whether rows were left out (the limit is the feature)."""
    some = df.orderBy(*order).limit(most + 1).cache()
    cut = some.count() > most
    some.limit(most).coalesce(1).write.mode("overwrite").option("header", True).option("sep", ";").option("lineSep", "\r\n").csv(path)
    some.unpersist()
    return cut


def pages_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with names in snake case and shares rounded to 3 places."""
    import re

    name = lambda c: re.sub(r"(?<!^)([A-Z])", r"_\1", c).lower()
    shares = [F.round(F.col(c), 3).alias(name(c)) if c.lower().endswith("share") else F.col(c).alias(name(c)) for c in df.columns]
    df.select(*shares).write.mode("overwrite").option("ignoreNullFields", False).json(path)


def pivoted(df: DataFrame, key: list[str], name: str, value: str, names: list[str], prefix: str = "") -> DataFrame:
    """A column for each of a known list of names."""
    wide = df.groupBy(*key).pivot(name, names).agg(F.first(value))
    return wide.select(*key, *[F.col(f"`{n}`").alias(f"{prefix}{n}") for n in names])


def append_months(df: DataFrame, path: str, at: str, first: str, last: str) -> None:
    """Append to a table with a folder a month. A row outside [first, last) is an error and nothing is written."""
    bad = df.filter(F.col(at).isNull() | (F.col(at) < F.lit(first).cast("timestamp")) | (F.col(at) >= F.lit(last).cast("timestamp")))
    if not bad.isEmpty():
        raise ValueError(f"{at} is outside the months from {first} to {last}")
    df.withColumn("month", F.date_format(at, "yyyy-MM")).write.mode("append").partitionBy("month").parquet(path)


def from_database(spark: SparkSession, url: str, name: str, key: str | None = None, bounds: tuple[int, int] = (0, 0), parts: int = 16, **options: str) -> DataFrame:
    """A table over JDBC, read in parallel by ranges of a numeric key where one is given."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=name, **options)
    if key:
        reader = reader.options(partitionColumn=key, lowerBound=bounds[0], upperBound=bounds[1], numPartitions=parts)
    return reader.load()


def site_scan(spark: SparkSession, path: str) -> DataFrame:
    """A report of findings as it was written: one JSON document in several lines."""
    return spark.read.option("multiLine", True).json(path)
