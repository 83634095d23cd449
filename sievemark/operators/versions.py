"""Latest rows, slowly changing versions, upserts and state machines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The row of each key that comes last by `order`; aggregated before the shuffle, so hot keys are no problem."""
    row = F.struct(*[df[c] for c in df.columns])
    out = df.groupBy(*keys).agg(F.max_by(row, F.struct(*order)).alias("r"))
    return out.select("r.*")


def scd2(df: DataFrame, keys: list[str], value: str, *order: str) -> DataFrame:
    """One version for each change of value (null-safe): valid_from, valid_to (null: current)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    before = F.lag(value).over(w)
    changed = (F.row_number().over(w) == 1) | ~before.eqNullSafe(F.col(value))
    kept = df.withColumn("_changed", changed).filter("_changed")
    start = order[0]
    out = kept.withColumn("valid_to", F.lead(start).over(w))
    return out.select(*keys, value, F.col(start).alias("valid_from"), "valid_to", F.col("valid_to").isNull().alias("current"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], sums: list[str], finals: tuple[str, ...], state: str) -> DataFrame:
    """Old and new rows by key: the last state, but a final one never goes back; `sums` add up; the rest coalesces, new first."""
    both = old.withColumn("_at", F.lit(0)).unionByName(new.withColumn("_at", F.lit(1)))
    rest = [c for c in old.columns if c not in (*keys, *sums, state)]
    rank = F.struct(F.col(state).isin(list(finals)).cast("int"), "_at")
    return both.groupBy(*keys).agg(
        F.max_by(state, rank).alias(state),
        *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in sums],
        *[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("_at"))).alias(c) for c in rest],
    )


def price_phases(df: DataFrame, keys: list[str], price: str, *order: str) -> DataFrame:
    """A row where the price differs from the one before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("previous", F.lag(price).over(w)).filter(F.col("previous").isNull() | (F.col("previous") != F.col(price)))


def allowed(changes: DataFrame, transitions: DataFrame) -> DataFrame:
    """Changes (from_state, to_state) with `legal`: whether the fixed table of transitions holds them."""
    some = F.broadcast(transitions.select("from_state", "to_state").distinct().withColumn("_ok", F.lit(True)))
    return changes.join(some, ["from_state", "to_state"], "left").withColumn("legal", F.coalesce("_ok", F.lit(False))).drop("_ok")


def page_after(df: DataFrame, cursor: dict[str, object] | None, order: list[str], limit: int = 25) -> DataFrame:
    """Keyset paging: the rows after the cursor in ascending order; one row more than asked tells of a next page."""
    if not 1 <= limit <= 100:
        raise ValueError("limit is 1 to 100")
    if cursor is not None:
        after: Column = F.lit(False)
        same: Column = F.lit(True)
        for c in order:
            after |= same & (F.col(c) > F.lit(cursor[c]))
            same &= F.col(c) == F.lit(cursor[c])
        df = df.filter(after)
    return df.orderBy(*order).limit(limit + 1)


def encode_cursor(values: dict[str, object]) -> str:
    """An opaque cursor: base64url of canonical JSON."""
    import base64
    import json

    return base64.urlsafe_b64encode(json.dumps(values, sort_keys=True, default=str).encode()).decode().rstrip("=")


def decode_cursor(text: str) -> dict[str, object]:
    import base64
    import json

    return json.loads(base64.urlsafe_b64decode(text + "=" * (-len(text) % 4)))
