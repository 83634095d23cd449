"""Arrow batches of bounded bytes for Python steps."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, SparkSession
from pyspark.sql.functions import pandas_udf

#: Bytes of one Arrow batch that goes to a Python worker, whatever the rows of a partition.
BATCH_BYTES = 4 << 20


def bounded(spark: SparkSession | None = None) -> None:
    """Let the session's Python steps get batches of at most BATCH_BYTES (or one row), so that what a worker holds does
    not grow with the table; by rows alone a batch is 10,000 pages."""
    (spark or SparkSession.active()).conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def bounded_udf(kind) -> Callable[[Callable], Callable[..., Column]]:
    """A pandas UDF whose batches are bounded."""

    def add(f: Callable) -> Callable[..., Column]:
        udf = pandas_udf(kind)(f)

        @wraps(f)
        def column(*columns) -> Column:
            bounded()
            return udf(*columns)

        return column

    return add
