"""Queries of a job queue: claims, heads of keys, durations, estimates and fair rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def claim(ready: DataFrame, running: DataFrame, cap: int) -> DataFrame:
    """Ready jobs (tenant, priority, id) that fit under each tenant's cap, given running (tenant, n).

    At most `cap` jobs of a tenant can be claimed; Spark keeps that many of each task before the shuffle (a window group limit).
    """
    rn = F.row_number().over(Window.partitionBy("tenant").orderBy("priority", "id"))
    free = ready.join(running, "tenant", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return free.withColumn("rn", rn).filter(F.col("rn") <= cap).filter(F.col("n") + F.col("rn") <= cap)


def heads(jobs: DataFrame, key: str) -> DataFrame:
    """The first job (priority, id) of each concurrency key."""
    row = F.struct(*[jobs[c] for c in jobs.columns])
    return jobs.groupBy(key).agg(F.min_by(row, F.struct("priority", "id")).alias("r")).select("r.*")


def step_durations(events: DataFrame, run: str, kind: str, at: str) -> DataFrame:
    """Mean seconds of each step over all runs: a run without the step counts as 0."""
    steps = events.groupBy(run, kind).agg((F.unix_timestamp(F.max(at)) - F.unix_timestamp(F.min(at))).alias("s"))
    runs = events.agg(F.count_distinct(run).alias("runs"))
    return steps.groupBy(kind).agg(F.sum("s").alias("seconds")).join(F.broadcast(runs)).select(kind, "seconds", (F.col("seconds") / F.col("runs")).alias("mean"))


def token_bucket(at: Column, cost: Column, cap: float, refill: float) -> Column:
    """An aggregate over one key's requests: (tokens, last, granted, denied) after a fold in time order.

    Requests of one key are folded in order in one row; the streaming twin (streaming.rates) keeps only this state.
    """
    rows = F.array_sort(F.collect_list(F.struct(at.cast("double").alias("t"), cost.alias("c"))))
    zero = F.struct(F.lit(cap).alias("tokens"), F.lit(None).cast("double").alias("last"), F.lit(0).cast("long").alias("granted"), F.lit(0).cast("long").alias("denied"))

    def step(s: Column, r: Column) -> Column:
        have = F.least(F.lit(cap), s["tokens"] + F.coalesce(r["t"] - s["last"], F.lit(0.0)) * refill)
        ok = have >= r["c"]
        return F.struct(
            F.when(ok, have - r["c"]).otherwise(have).alias("tokens"), r["t"].alias("last"),
            (s["granted"] + ok.cast("long")).alias("granted"), (s["denied"] + (~ok).cast("long")).alias("denied"),
        )

    return F.aggregate(rows, zero, step)


def adaptive_rate(order: Column, status: Column, seconds: Column, start: float = 1.0, least: float = 0.2, most: float = 5.0) -> Column:
    """An aggregate: the request rate after a host's responses in order.

    Faster by 0.25 after a fast answer, times 0.7 after a slow or failed one, times 0.5 after 429 and 503; clamped.
    """
    rows = F.array_sort(F.collect_list(F.struct(order.alias("o"), status.alias("s"), seconds.alias("d"))))

    def step(rate: Column, r: Column) -> Column:
        new = F.when(r["s"].isin(429, 503), rate * 0.5).when((r["s"] >= 400) | (r["d"] > 2.0), rate * 0.7).otherwise(rate + 0.25)
        return F.greatest(F.lit(least), F.least(F.lit(most), new))

    return F.aggregate(rows, F.lit(start), step)
