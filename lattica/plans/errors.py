"""What a failing read gives: an exception, no rows, or the error as a row."""

from __future__ import annotations

from collections.abc import Callable
from concurrent.futures import Future, ThreadPoolExecutor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

POLICIES = ("strict", "null", "capture")


def guarded(run: Callable[[], DataFrame], policy: str, empty: Callable[[], DataFrame]) -> DataFrame:
    """``run()`` under a policy. "capture" adds ``_error`` (null on success, else one row of nulls and the message)."""
    if policy not in POLICIES:
        raise ValueError(f"policy {policy}")
    try:
        out = run()
    except ValueError as e:
        if policy == "strict":
            raise
        none = empty()
        if policy == "null":
            return none
        row = none.sparkSession.range(1).select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in none.schema.fields], F.lit(str(e)).alias("_error"))
        return row
    return out.withColumn("_error", F.lit(None).cast("string")) if policy == "capture" else out


def eager(action: Callable[[], object], pool: ThreadPoolExecutor) -> Future:
    """Start an action at once in a pool of threads, as Spark's scheduler allows."""
    return pool.submit(action)
