"""Continuous forms: windowed counts with late data, the newest row of a key, and rate limits as keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from issuelake.operators.allocate import limiter


def read_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1) -> DataFrame:
    """New Parquet files of a folder as they come."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", size: str = "1 hour", slide: str | None = None, late: str = "2 hours") -> DataFrame:
    """Counts and sums of each window and key; rows later than `late` are dropped by the watermark, and state with them."""
    w = F.window(time, size, slide) if slide else F.window(time, size)
    return events.withWatermark(time, late).groupBy(w.alias("w"), key).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n", "total")


def session_counts(events: DataFrame, time: str = "ts", key: str = "user_id", gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions of a key that end after a gap."""
    return events.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), key, "n")


def unique_fetches(issues: DataFrame, time: str = "fetched_at", keys: tuple[str, ...] = ("repo_full_name", "github_issue_number", "updated_at"), late: str = "30 days") -> DataFrame:
    """The first fetch of every state of an issue; the keys seen are kept as long as late rows are awaited."""
    return issues.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))


def limited(events: DataFrame, key: str = "user_id", gap: float = 4.6, per_window: int = 13, tokens: int = 1_000_000, window: float = 60.0, time: str = "ts", late: str = "2 hours", idle: float = 600.0) -> DataFrame:
    """key, event_id, wait: rate limits with the last start and the open window of each key as state. Rows are taken in time order within a batch; rows later than `late` are dropped, and so is the state of a key when the watermark is `idle` seconds past its last row."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(batches)).sort_values(["t", "event_id"])
        at, held = limiter(rows["t"].tolist(), [int(c) for c in rows["c"]], gap, per_window, tokens, window, state.get if state.exists else None, True)
        state.update(held)
        state.setTimeoutTimestamp(int(max(max(at) * 1000, state.getCurrentWatermarkMs()) + idle * 1000) + 1)
        yield pd.DataFrame({"key": [k[0]] * len(rows), "event_id": rows["event_id"].to_numpy(), "wait": [round(a - t, 3) for a, t in zip(at, rows["t"])]})

    source = events.withWatermark(time, late).select(F.col(key).cast("bigint").alias("key"), "event_id", time, F.col("t").cast("double"), F.col("c").cast("bigint"))
    return source.groupBy("key").applyInPandasWithState(step, "key bigint, event_id bigint, wait double", "last double, opened double, n int, spent bigint", "append", GroupStateTimeout.EventTimeTimeout)


__all__ = ["limited", "limiter", "read_stream", "session_counts", "unique_fetches", "windowed_counts"]
