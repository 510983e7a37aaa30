"""Structured Streaming jobs, and the expressions that they share with batch replays.

Every function of a stream takes a streaming DataFrame and returns one; the caller starts it with a checkpoint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle


def first_seen(rows: DataFrame, keys: list[str], ts: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.min(ts).alias("first_seen"))


def deduplicated(stream: DataFrame, keys: list[str], ts: str, delay: str) -> DataFrame:
    """Each key once while its state lives: the state goes when the watermark has passed."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def windowed(rows: DataFrame, ts: str, size: str, slide: str | None, keys: list[str], delay: str | None = None) -> DataFrame:
    """Counts by event-time window; with a delay, late rows beyond it are dropped and windows close."""
    if delay is not None:
        rows = rows.withWatermark(ts, delay)
    w = F.window(ts, size, slide) if slide else F.window(ts, size)
    g = rows.groupBy(w, *keys).agg(F.count("*").alias("n"), F.sum("extracted").alias("extracted"))
    return g.select(F.col("window.start").alias("start"), *keys, "n", "extracted")


def next_status(status: Column, failed: Column, attempts: Column, retries: int) -> Column:
    """What becomes of a queue item: failures are queued again until the retries are used up."""
    return F.when(status == "completed", "completed").when(failed & (attempts >= retries), "failed").when(failed, "queued").otherwise(status)


def recovery(status: Column, heartbeat: Column, alive_since: Column, attempts: Column, requeues: int) -> Column:
    return F.when(status != "processing", "keep").when(heartbeat >= alive_since, "alive").when(attempts < requeues, "requeue").otherwise("fail")


def progress(items: DataFrame, keys: list[str]) -> DataFrame:
    """Counters of a job and its state; works on streams in update mode."""
    done, failed = F.count_if(F.col("status") == "completed"), F.count_if(F.col("last_error").isNotNull())
    g = items.groupBy(*keys).agg(F.count("*").alias("total"), done.alias("done"), failed.alias("failed"))
    state = (
        F.when(F.col("done") < F.col("total"), "running").when(F.col("failed") == F.col("total"), "failed").when(F.col("failed") > 0, "completed_with_failures").otherwise("completed")
    )
    return g.withColumn("state", state)


class ContentDelta(StatefulProcessor):
    """Keeps each key's last content hash and emits the rows whose hash differs from it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "hash string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timers) -> Iterator[pd.DataFrame]:  # noqa: N802
        every = pd.concat(list(rows)).sort_values("ts")
        before = self.last.get()[0] if self.last.exists() else None
        shifted = every["hash"].shift(1)
        shifted.iloc[0] = before
        self.last.update((every["hash"].iloc[-1],))
        yield every[every["hash"] != shifted]

    def close(self) -> None:
        pass


def content_delta(stream: DataFrame) -> DataFrame:
    """stream: key, ts, hash.  The rows whose content differs from the one before of their key."""
    rows = stream.select("key", "ts", "hash").groupBy("key")
    return rows.transformWithStateInPandas(ContentDelta(), "key string, ts timestamp, hash string", "Append", "None")


def upserting(stream: DataFrame, merge: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch goes to ``merge``, which must give the same result for the same batch number."""
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
