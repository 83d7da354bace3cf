"""Physical join strategies, on request, behind a check of the size that is to be broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame

HINTS = {"broadcast": "broadcast", "merge": "merge", "shuffle_hash": "shuffle_hash", "nested_loop": "shuffle_replicate_nl"}
#: Largest estimated size, in bytes, of a side that is broadcast on request; a larger one is merged instead.
BROADCAST_BYTES = 64 << 20


def estimated_bytes(df: DataFrame) -> int:
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def hinted(right: DataFrame, strategy: str | None) -> DataFrame:
    """The right side of a join with the hint for a strategy. Without a strategy the optimizer and adaptive execution choose."""
    if strategy is None:
        return right
    if strategy not in HINTS:
        raise ValueError(f"unknown join strategy {strategy!r}; there are {', '.join(HINTS)}")
    if strategy == "broadcast" and estimated_bytes(right) > BROADCAST_BYTES:
        strategy = "merge"
    return right.hint(HINTS[strategy])


def cartesian_products(df: DataFrame) -> int:
    """How many products without a condition the physical plan has."""
    plan = df._jdf.queryExecution().sparkPlan().toString()
    return plan.count("CartesianProduct") + sum("BroadcastNestedLoopJoin" in line and ", Cross" in line and line.rstrip().endswith("Cross") for line in plan.splitlines())
