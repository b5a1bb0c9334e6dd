"""Time-aware operators over unbounded tables of observations, with watermarks for late rows.

Each takes and returns a streaming (or batch) frame with an event-time column; the caller starts the query.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def read_events(spark, path: str, schema: str, max_files: int = 1) -> DataFrame:
    """A folder of Parquet files as a stream, a few files a trigger."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(path)


def windowed_counts(events: DataFrame, keys: list[str], ts: str, width: str = "1 hour", late: str = "2 hours", value: str | None = None) -> DataFrame:
    """Observations (and sums of a value) by time window and keys."""
    aggs = [F.count(F.lit(1)).alias("n")] + ([F.sum(value).alias(value)] if value else [])
    out = events.withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(*aggs)
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "n", *([value] if value else []))


def sessions(events: DataFrame, keys: list[str], ts: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Runs of observations of the same keys without a longer gap."""
    out = events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("s"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("s.start").alias("start"), F.col("s.end").alias("end"), *keys, "n")


def moves(events: DataFrame, user: str, place: str, ts: str, late: str = "2 hours") -> DataFrame:
    """``(user, from_id, to_id, at)``: each change of place of a user, in the order of time.

    The state of a user is the last place and time; rows of a trigger that are older than it are ignored as late, and
    users that are silent beyond the watermark are forgotten.
    """
    schema = events.schema
    user_type, place_type = schema[user].dataType.simpleString(), schema[place].dataType.simpleString()

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        last = state.get if state.exists else (None, pd.Timestamp.min)
        rows = pd.concat(list(batches)).sort_values([ts, place], kind="stable")
        place_now, time_now, out = last[0], pd.Timestamp(last[1]), []
        for p, t in rows[[place, ts]].itertuples(index=False):
            if t < time_now:
                continue
            if place_now is not None and p != place_now:
                out.append((key[0], place_now, p, t))
            place_now, time_now = p, t
        state.update((place_now, time_now))
        state.setTimeoutTimestamp(int(max(time_now.value // 10**6, state.getCurrentWatermarkMs()) + 86_400_000))
        yield pd.DataFrame(out, columns=[user, "from_id", "to_id", "at"])

    return (
        events.withWatermark(ts, late)
        .groupBy(user)
        .applyInPandasWithState(
            step,
            f"{user} {user_type}, from_id {place_type}, to_id {place_type}, at timestamp",
            f"place {place_type}, t timestamp",
            "append",
            GroupStateTimeout.EventTimeTimeout,
        )
    )


def moving_flows(moved: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Flows between places by time window, from a stream of moves."""
    return windowed_counts(moved, ["from_id", "to_id"], "at", width, late)
