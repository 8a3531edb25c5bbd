"""Size-checked broadcast.

A side is broadcast only after measuring it against a bound in rows and in
bytes of text (counted in every task; a limit would first send that many rows
of each task to a single one); beyond either the caller's join is left to the planner (sort-merge, with AQE's skew
split).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_MAX_ROWS = 2_000_000
BROADCAST_MAX_BYTES = 128 << 20   # of strings; other columns are of fixed width


def fits(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> bool:
    text = [F.octet_length(F.col(f"`{c}`")) for c, kind in df.dtypes if kind == "string"]
    size = sum((F.coalesce(F.sum(t), F.lit(0)) for t in text), F.lit(0).cast("bigint"))
    n = df.agg(F.count(F.lit(1)).alias("n"), size.alias("b")).first()
    return n["n"] <= max_rows and n["b"] <= max_bytes


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES) -> DataFrame:
    """``broadcast(df)`` when it is within both bounds, else ``df``."""
    return F.broadcast(df) if fits(df, max_rows, max_bytes) else df
