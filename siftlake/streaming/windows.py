"""Batch forms of the watching operators; siftlake.streaming.live runs the same logic on streams."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def collapse(events: DataFrame, *keys: str) -> DataFrame:
    """The one event (kind C, D or U; ordered by seq) that a key's events amount to.

    The last event counts; only updates after a creation are part of the creation.
    """
    last = F.max_by("kind", "seq").alias("last")
    before = F.max_by(F.when(F.col("kind") != "U", F.col("kind")), F.when(F.col("kind") != "U", F.col("seq"))).alias("before")
    merged = events.groupBy(*keys).agg(last, before)
    kind = F.when((F.col("last") == "U") & (F.col("before") == "C"), "C").otherwise(F.col("last"))
    return merged.select(*keys, kind.alias("kind"))


def anchored_windows(events: DataFrame, *keys: str, seconds: int, most: int | None = None, path: str | None = None) -> DataFrame:
    """events (keys, ts, seq) with window_start and turn (from 1): a key's window opens at an event and holds those less
    than `seconds` after it; the next event opens the next one. With most, a window also ends at so many events, or
    at so many different values of path.

    Where a window opens depends on all windows before it, so a key's events are folded in order, in a stream over
    sorted rows: state is one window, whatever the number of a key's events.
    """
    ordered = events.repartition(*keys).sortWithinPartitions(*keys, "ts", "seq")
    schema = T.StructType([*events.schema.fields, T.StructField("window_start", T.LongType()), T.StructField("turn", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, start, turn, seen = None, None, 0, set()
        for batch in batches:
            starts, turns = [], []
            columns = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in (*keys, "ts", *([path] if path else []))]
            for *own, at, place in zip(*columns, strict=True) if path else zip(*columns, columns[0], strict=True):
                full = most is not None and (len(seen) if path else turn) >= most
                if own != key or at - start >= seconds or full:
                    key, start, turn = own, at, 0
                    seen.clear()
                turn += 1
                if path:
                    seen.add(place)
                starts.append(start)
                turns.append(turn)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(starts, pa.int64()), pa.array(turns, pa.int64())], names=[*batch.schema.names, "window_start", "turn"])

    return ordered.mapInArrow(run, schema)


def debounce_windows(events: DataFrame, *keys: str, seconds: int = 5, most: int = 200, path: str = "path") -> DataFrame:
    """events with window_start: a window opens at the first event and ends `seconds` later or at `most` pending paths."""
    return anchored_windows(events, *keys, seconds=seconds, most=most, path=path).drop("turn")


def rename_pairs(events: DataFrame, *group: str) -> DataFrame:
    """group, old_path, new_path: renames among events (group, path, kind, seq), where a group is one folder in one window.

    A group's events are collapsed by path. If exactly one path was deleted and exactly one other changed, the one was
    renamed to the other; a path that the window created first was never indexed, so its deletion counts for nothing.
    """
    first = events.groupBy(*group, "path").agg(F.min_by("kind", "seq").alias("first"))
    merged = collapse(events, *group, "path").join(first, [*group, "path"])
    gone, came = (F.col("kind") == "D") & (F.col("first") != "C"), F.col("kind") == "U"
    count = lambda c: F.sum(c.cast("int"))
    pick = lambda c: F.max(F.when(c, F.col("path")))
    per = merged.groupBy(*group).agg(count(gone).alias("d"), count(came).alias("u"), pick(gone).alias("old_path"), pick(came).alias("new_path"))
    return per.filter("d = 1 and u = 1").drop("d", "u")


def rate_limited(requests: DataFrame, key: str, limit: int = 60, seconds: int = 60) -> DataFrame:
    """requests (key, ts, seq) with allowed: the first `limit` of each window, which opens at a request."""
    return anchored_windows(requests, key, seconds=seconds).withColumn("allowed", F.col("turn") <= limit).drop("turn", "window_start")


def refresh_wait(last: int, now: int, interval: int) -> int:
    """Milliseconds until the next refresh, of which there is one an interval at most, however many events arrive."""
    return max(0, interval - (now - last))


def due(last_run: int | None, now: int, every: int) -> bool:
    """Whether a periodic job runs now; jobs run by a scheduler with the availableNow trigger and do not overlap."""
    return last_run is None or now - last_run >= every


def longest_root(events: DataFrame, roots: DataFrame) -> DataFrame:
    """events (path) with the source of the longest root (source, root) that holds their path; null without one.

    Every prefix of a path at a slash is looked up, so the join is an equi-join.
    """
    parts = F.split("path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    steps = events.select("path").distinct().withColumn("root", F.explode(prefixes)).join(roots, "root")
    best = steps.groupBy("path").agg(F.max_by("source", F.length("root")).alias("source"))
    return events.join(best, "path", "left")
