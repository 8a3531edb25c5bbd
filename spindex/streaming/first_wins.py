"""First page per URL inside the stream (ST2): keyed state that expires.

``ingest`` writes every parsed row and lets readers choose; here the stream
itself lets only the first row of a URL key through.  Spark keeps one small
state row per key in its state store (checkpointed with the query, so a restart
goes on where it stopped); a key's rows of one micro-batch are passed through
once, in Arrow batches, and only the earliest is held.

Without ``expire_after`` the state grows with the distinct URLs.  With it, a key
is forgotten once the watermark of the fetch time has passed its first page by
that long: a page that comes back later counts as new, which is what a
re-crawl wants, and the state is bounded by the keys of that time.  As in any
query with a watermark, pages fetched before it (the latest fetch time seen less
``lateness``) or without a fetch time have no place in it and are left out; give
``lateness`` the delay with which files may arrive, or no expiry.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.links import page_key

COLUMNS = ("url", "title", "description", "time", "ingest_seq")
SCHEMA = "url string, title string, description string, time timestamp, ingest_seq bigint"


def first_wins(parsed: DataFrame, expire_after: str | None = None, lateness: str = "0 seconds") -> DataFrame:
    """The first row of each URL key of a stream of parsed pages: of the first
    micro-batch that has the key, the row with the lowest ``ingest_seq``."""
    rows = parsed.select(*COLUMNS, page_key("url").alias("key"))
    if expire_after is not None:
        rows = rows.where(F.col("time").isNotNull()).withWatermark("time", lateness)
    keep_ms = int(pd.Timedelta(expire_after).total_seconds() * 1000) if expire_after is not None else None

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        first = None
        for batch in batches:
            best = batch.sort_values("ingest_seq", kind="stable", na_position="last").head(1)
            first = best if first is None else pd.concat([first, best]).sort_values(
                "ingest_seq", kind="stable", na_position="last").head(1)
        if state.exists or first is None:
            return
        state.update((True,))
        if keep_ms is not None:
            fetched = int(first["time"].iloc[0].timestamp() * 1000)
            state.setTimeoutTimestamp(max(fetched, state.getCurrentWatermarkMs()) + keep_ms)
        yield first[list(COLUMNS)]

    timeout = GroupStateTimeout.NoTimeout if keep_ms is None else GroupStateTimeout.EventTimeTimeout
    return rows.groupBy("key").applyInPandasWithState(step, SCHEMA, "seen boolean", "append", timeout)


def run(parsed: DataFrame, out: str, expire_after: str | None = None, lateness: str = "0 seconds") -> None:
    """Runs :func:`first_wins` over everything available now into ``out/first``;
    started again with the same folder it goes on with its state."""
    q = (first_wins(parsed, expire_after, lateness).writeStream.outputMode("append").format("parquet")
         .option("path", f"{out}/first").option("checkpointLocation", f"{out}/_checkpoint_first")
         .trigger(availableNow=True).start())
    q.awaitTermination()
