"""Streaming forms of alerts, weekly sums, sessions and job life cycles."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fresh_alerts(events: DataFrame, keys: list[str], at: str, *, late: str = "7 days") -> DataFrame:
    """Events once per key; one that is later than the watermark is dropped, as is a repeat within it."""
    return events.withWatermark(at, late).dropDuplicatesWithinWatermark(keys)


def weekly_sums(events: DataFrame, group: str, item: str, value: str, at: str, *, late: str = "2 days") -> DataFrame:
    """Per Monday week and group the sum over items of each item's greatest value.

    Two aggregations follow each other, so a stream runs it in append mode.
    """
    week = F.window(F.col(at), "7 days", "7 days", "4 days")  # the epoch was a Thursday
    most = events.withWatermark(at, late).groupBy(week, group, item).agg(F.max(value).alias("most"))
    out = most.groupBy(F.window(F.window_time("window"), "7 days", "7 days", "4 days").alias("week"), group).agg(F.sum("most").alias("total"))
    return out.select(F.col("week.start").alias("week"), group, "total")


def sessions(events: DataFrame, user: str, at: str, *, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """user, started, ended (last event and the gap), n_events of bursts of activity."""
    s = events.withWatermark(at, late).groupBy(user, F.session_window(at, gap).alias("s")).agg(F.count("*").alias("n_events"))
    return s.select(user, F.col("s.start").alias("started"), F.col("s.end").alias("ended"), "n_events")


def session_activity(events: DataFrame, user: str, at: str, kind: str, *, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """user, started, n_events, active_seconds and kinds (distinct ones) of bursts of activity.

    A user is active from a burst's first event to its last; the gap that ends it isn't activity.
    """
    seconds = F.unix_micros(F.max(at)) - F.unix_micros(F.min(at))
    s = events.withWatermark(at, late).groupBy(user, F.session_window(at, gap).alias("s")).agg(F.count("*").alias("n_events"), (seconds / 1e6).alias("active_seconds"), F.sort_array(F.collect_set(kind)).alias("kinds"))
    return s.select(user, F.col("s.start").alias("started"), "n_events", "active_seconds", "kinds")


STATE = "first_seen timestamp, closed timestamp"
OUT = "board string, job string, event string, at timestamp, first_seen timestamp"


def _job_events(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
    first, closed = state.get if state.exists else (None, None)
    rows = pd.concat(list(frames)).sort_values("at")
    out = []
    for listed, at in zip(rows["listed"], rows["at"]):
        event = None
        if listed and first is None:
            first, event = at, "opened"
        elif listed and pd.notna(closed) and closed is not None:
            closed, event = None, "reopened"
        elif not listed and first is not None and (closed is None or pd.isna(closed)):
            closed, event = at, "closed"
        if event:
            out.append((*key, event, at, first))
    if first is not None:
        state.update((first, closed))
    yield pd.DataFrame(out, columns=["board", "job", "event", "at", "first_seen"])


def job_lifecycle(observations: DataFrame) -> DataFrame:
    """Events of jobs from a stream of (board, job, listed, at); the first sight of a job survives closing.

    A board that couldn't be fetched sends no observations, so it closes nothing.
    """
    from pyspark.sql.streaming.state import GroupStateTimeout

    return observations.groupBy("board", "job").applyInPandasWithState(_job_events, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def velocity(metrics: DataFrame, latest: DataFrame, windows: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Micro-batch of latest observations against stored ones: used from foreachBatch with a static history."""
    joined = latest.join(metrics.select(F.col("key").alias("_k"), F.col("at").alias("_at"), F.col("value").alias("_v")), F.col("key") == F.col("_k"))
    picks = [F.max(F.when((F.col("_at") >= F.col("at") - far) & (F.col("_at") <= F.col("at") - near), F.struct("_at", "_v"))).alias(name) for name, (far, near) in windows.items()]
    return joined.groupBy("key", "at", "value").agg(*picks).select("key", "at", "value", *[(F.col("value") - F.col(f"{n}._v")).alias(f"delta_{n}") for n in windows])


def run_available(stream: DataFrame, query: str, *, mode: str = "append", checkpoint: str) -> DataFrame:
    """Run a stream over what is there now into a memory table and return it."""
    q = stream.writeStream.outputMode(mode).format("memory").queryName(query).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.table(query)
