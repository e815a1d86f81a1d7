"""Streams of changes and events. Functions take and return streaming (or batch) DataFrames unless they say otherwise."""

from __future__ import annotations

import zoneinfo
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def event_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 1) -> DataFrame:
    """Parquet files that arrive in a folder; the number per trigger bounds what is in flight."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def subscribe(events: DataFrame, types: list[str] | None = None, project: str | None = None, workspace: str | None = None) -> DataFrame:
    """Events of the given types, of the project where one is named, else of the workspace."""
    if types is not None:
        events = events.filter(F.col("event_type").isin(types)) if types else events.filter(F.lit(False))
    if project is not None:
        return events.filter(F.col("project_id") == project)
    return events.filter(F.col("workspace_id") == workspace) if workspace is not None else events


def conditions_hold(data: Column, conditions: list[tuple[str, str, str]]) -> Column:
    """Whether all (key, operator, value) hold on a map: equals, contains, exists; another operator never does."""
    out = F.lit(True)
    for key, operator, value in conditions:
        held = F.try_element_at(data, F.lit(key))
        out = out & {
            "equals": F.coalesce(held == value, F.lit(False)),
            "contains": F.coalesce(F.contains(held, F.lit(value)), F.lit(False)),
            "exists": F.map_contains_key(data, key),
        }.get(operator, F.lit(False))
    return out


def quiet(at: Column, zone: Column, start: Column, end: Column) -> Column:
    """Whether the local time HH:MM lies in [start, end), which may wrap midnight; false where unset or the zone is unknown.

    An empty zone is UTC.
    """
    known = F.when(zone == "", F.lit("UTC")).when(zone.isin(sorted(zoneinfo.available_timezones())), zone)
    now = F.date_format(F.from_utc_timestamp(at, known), "HH:mm")
    inside = F.when(start <= end, (now >= start) & (now < end)).otherwise((now >= start) | (now < end))
    return F.coalesce(F.when((start != "") & (end != ""), inside), F.lit(False))


def windowed_counts(events: DataFrame, at: str, by: str, size: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and sums in tumbling or sliding event-time windows; rows later than `late` are left out by the stream."""
    frame = F.window(at, size, slide) if slide else F.window(at, size)
    timed = events.withWatermark(at, late) if events.isStreaming else events
    out = timed.groupBy(frame.alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n", "total")


def session_windows(events: DataFrame, at: str, by: str, gap: str, late: str = "1 hour") -> DataFrame:
    timed = events.withWatermark(at, late) if events.isStreaming else events
    out = timed.groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), by, "n")


def repetition_stream(blocks: DataFrame, key: str = "content_hash", block: str = "block_id") -> DataFrame:
    """Numbers each block among those of its hash over the whole stream: (hash, block_id, index); state: the count."""

    def number(hash_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        seen = state.get[0] if state.exists else 0
        for frame in frames:
            frame = frame.sort_values(block)
            yield pd.DataFrame({"content_hash": hash_[0], "block_id": frame[block], "index": range(seen + 1, seen + 1 + len(frame))})
            seen += len(frame)
        state.update((seen,))

    return blocks.groupBy(key).applyInPandasWithState(
        number, "content_hash string, block_id string, index long", "seen long", "append", GroupStateTimeout.NoTimeout
    )


def deadline_notices(tasks: DataFrame, now: str = "at", due: str = "due", task: str = "task_id", hours: int = 24) -> DataFrame:
    """One notice for each task seen within `hours` of its due time; a task no longer due can be noticed again."""

    def check(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        told = state.get[0] if state.exists else False
        notices = []
        for frame in frames:
            for row in frame.sort_values(now).itertuples(index=False):
                left = getattr(row, due) - getattr(row, now)
                near = pd.Timedelta(0) <= left < pd.Timedelta(hours=hours)
                if near and not told:
                    notices.append((key[0], getattr(row, now)))
                told = near
        state.update((told,))
        yield pd.DataFrame(notices, columns=["task_id", "at"])

    return tasks.groupBy(task).applyInPandasWithState(
        check, "task_id long, at timestamp", "told boolean", "append", GroupStateTimeout.NoTimeout
    )


def digests(events: DataFrame, sent: DataFrame, now: Column, user: str = "user_id", at: str = "ts", category: str = "event_type") -> DataFrame:
    """Unread events of each user since the last digest (24 hours where there was none), by category. A batch function."""
    last = events.join(sent.select(user, "last_sent"), user, "left")
    since = F.coalesce(F.col("last_sent"), now - F.expr("interval 24 hours"))
    unread = last.filter((F.col(at) > since) & (F.col(at) <= now))
    return unread.groupBy(user, category).agg(F.count(F.lit(1)).alias("n"), F.max(at).cast("timestamp").alias("newest"))


def tee(stream: DataFrame, sinks: list[Callable[[DataFrame, int], None]], checkpoint: str):
    """Writes each micro-batch to several sinks from one read; the slowest sets the pace."""

    def write(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            for sink in sinks:
                sink(kept, number)
        finally:
            kept.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
