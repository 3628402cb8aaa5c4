"""Size checks before broadcasting, and partition sizing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A dimension is broadcast only when the optimizer's size estimate is below this.
BROADCAST_LIMIT_BYTES = 64 * 1024 * 1024


def estimated_bytes(df: DataFrame) -> int | None:
    """The optimizer's size estimate of a plan (no job is run); None if unknown."""
    try:
        n = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    except Exception:
        return None
    return None if n >= 2**63 - 1 else n  # Long.MaxValue means "unknown"


def sized_broadcast(df: DataFrame, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """``broadcast(df)`` when its estimated size is known and under ``limit``;
    otherwise the plain DataFrame, so the planner picks a shuffle join (and AQE
    may still turn it into a broadcast at run time from real sizes)."""
    n = estimated_bytes(df)
    if n is not None and n <= limit:
        return F.broadcast(df)
    return df


def broadcast_if_bounded_by(df: DataFrame, bound: DataFrame | None, limit: int = BROADCAST_LIMIT_BYTES) -> DataFrame:
    """Broadcast ``df`` when it has at most one row per row of ``bound`` (a
    caller-proven fact, e.g. one row per site) and ``bound``'s estimated size
    is under ``limit``; otherwise fall back to ``sized_broadcast(df)``.

    Useful for small derived tables (aggregates, windows) whose own size
    estimate is the size of their input, far above their real size."""
    if bound is not None:
        n = estimated_bytes(bound)
        if n is not None and n <= limit:
            return F.broadcast(df)
    return sized_broadcast(df, limit)
