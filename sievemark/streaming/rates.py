"""Structured Streaming: per-key rate state, replay of events, and windowed usage.

Sources are folders of append-only files, as any file, Kafka or table source can stand for them. State of a key is a few
numbers; every query takes a checkpoint folder and goes on from it after a lost executor or driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

GRANTS = "key string, id long, at double, granted boolean, tokens double, retry_after double"
STATE = "tokens double, last double"


def read_events(spark: SparkSession, path: str, schema: str, after: int | None = None, files_a_batch: int | None = None) -> DataFrame:
    """A stream over event files; `after` leaves out what a subscriber has seen already (by event_id)."""
    reader = spark.readStream.schema(schema)
    if files_a_batch:
        reader = reader.option("maxFilesPerTrigger", files_a_batch)
    rows = reader.parquet(path)
    return rows if after is None else rows.filter(F.col("event_id") > after)


def token_bucket(stream: DataFrame, cap: float, refill: float, reserve: float = 0.2) -> DataFrame:
    """Grant or deny each request (key, id, at, cost, priority) by its key's bucket.

    Requests of a batch are taken in order of time. Priorities over 1 can't use the last `reserve` of the bucket. Denied
    ones learn after how many seconds enough will be there.
    """

    def step(key, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        tokens, last = state.get if state.exists else (cap, None)
        rows = pd.concat(list(frames)).sort_values(["at", "id"])
        out = []
        for r in rows.itertuples():
            tokens = min(cap, tokens + (max(0.0, r.at - last) * refill if last is not None else 0.0))
            last = r.at if last is None else max(last, r.at)
            floor = reserve * cap if r.priority > 1 else 0.0
            ok = tokens - r.cost >= floor - 1e-9
            tokens -= r.cost if ok else 0.0
            out.append((key[0], r.id, r.at, ok, tokens, 0.0 if ok else (floor + r.cost - tokens) / refill))
        state.update((tokens, last))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in GRANTS.split(", ")])

    return stream.groupBy("key").applyInPandasWithState(step, GRANTS, STATE, "append", GroupStateTimeout.NoTimeout)


def usage(stream: DataFrame, late: str = "10 minutes", window: str = "1 hour") -> DataFrame:
    """Counts and sums by window and type, for rows at most `late` behind."""
    by = stream.withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type")
    return by.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(stream: DataFrame, late: str = "10 minutes", gap: str = "30 minutes") -> DataFrame:
    by = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id")
    return by.agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "user_id", "n")


def upsert_batches(stream: DataFrame, keys: list[str], path: str, checkpoint: str) -> StreamingQuery:
    """Write the latest row of each key of every batch under a folder named by the batch: a rerun batch replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        row = F.struct(*[batch[c] for c in batch.columns])
        last = batch.groupBy(*keys).agg(F.max_by(row, F.struct("ts", "event_id")).alias("r")).select("r.*")
        last.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
