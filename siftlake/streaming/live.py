"""Structured Streaming: landing folder to change log, live activity, debounced events, running statistics."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from siftlake.functions import exprs
from siftlake.operators.browse import recent_activity
from siftlake.operators.changes import apply_batch, sequence

BATCH = (
    "source string, scan_timestamp bigint, delete_paths array<string>, rename_paths array<struct<old_path: string, new_path: string>>, "
    "indexing_failures array<struct<path: string, error: string>>, "
    "files array<struct<path: string, mtime: bigint, size: bigint, kind: string, file_hash: string, is_new: boolean, force: boolean, "
    "lines: array<struct<archive_path: string, line_number: bigint, content: string>>>>, _corrupt_record string"
)


def read_batches(spark: SparkSession, landing: str, files_per_trigger: int = 32) -> DataFrame:
    """Change batches (JSON, one object a line, gzip or plain) as they land; undecodable ones keep their text in _corrupt_record."""
    reader = spark.readStream.schema(BATCH).option("maxFilesPerTrigger", files_per_trigger)
    rows = reader.option("columnNameOfCorruptRecord", "_corrupt_record").json(landing)
    return rows.select("*", F.col("_metadata.file_path").alias("request"))


def changes_of(batches: DataFrame) -> DataFrame:
    """One row per change of each batch: request, source, ts, ordinal, op, path, new_path, mtime, size, kind, file_hash, is_new, force, error.

    A file that was indexed clears its errors, so an upsert gives a clear_error row too; a batch with a time of its
    own gives a scan row.
    """
    empty = F.lit(None)
    row = lambda op, path, **c: F.struct(
        F.lit(op).alias("op"), path.cast("string").alias("path"),
        *[c.get(k, F.lit(False) if t == "boolean" else empty).cast(t).alias(k) for k, t in (
            ("new_path", "string"), ("mtime", "bigint"), ("size", "bigint"), ("kind", "string"), ("file_hash", "string"), ("is_new", "boolean"), ("force", "boolean"), ("error", "string"))],
    )
    flag = lambda c: F.coalesce(c, F.lit(False))
    parts = [
        F.transform("delete_paths", lambda p: row("delete", p)),
        F.transform("rename_paths", lambda r: row("rename", r["old_path"], new_path=r["new_path"])),
        F.transform("files", lambda f: row(
            "upsert", f["path"], mtime=f["mtime"], size=f["size"], kind=f["kind"], file_hash=f["file_hash"], is_new=flag(f["is_new"]), force=flag(f["force"]))),
        F.transform("files", lambda f: row("clear_error", f["path"])),
        F.transform("indexing_failures", lambda f: row("error", f["path"], error=exprs.truncate_error(f["error"]))),
        F.filter(F.array(row("scan", F.lit(""))), lambda _: F.col("scan_timestamp").isNotNull()),
    ]
    none = F.filter(F.array(row("", F.lit(""))), lambda _: F.lit(False))
    all_rows = F.concat(*[F.coalesce(p, none) for p in parts])
    good = batches.filter("_corrupt_record is null")
    return good.select("request", "source", F.col("scan_timestamp").alias("ts"), F.posexplode(all_rows).alias("ordinal", "change")).select(
        "request", "source", "ts", "ordinal", "change.*"
    )


def lines_of(batches: DataFrame) -> DataFrame:
    """The lines of each batch's files: request, source, path (with the archive member), line_number, content."""
    files = batches.filter("_corrupt_record is null").select("request", "source", F.explode("files").alias("f"))
    rows = files.select("request", "source", "f.path", F.explode("f.lines").alias("x"))
    path = F.when(F.coalesce("x.archive_path", F.lit("")) == "", F.col("path")).otherwise(exprs.join_composite(F.col("path"), F.col("x.archive_path")))
    return rows.select("request", "source", path.alias("path"), "x.line_number", "x.content")


def numbered(rows: DataFrame, batch_id: int) -> DataFrame:
    """Changes with seq, their order over all batches (see `changes.sequence`). A batch holds a bounded number of requests."""
    turn = F.row_number().over(Window.orderBy("request", "ordinal")).cast("long")
    return rows.withColumn("seq", sequence(F.lit(batch_id).cast("long"), F.col("op"), turn)).drop("ordinal")


def deal_batches(files: DataFrame, most_files: int = 200, most_bytes: int = 8 << 20) -> DataFrame:
    """files (source, path, lines) with batch: runs of files by path of at most most_files files, and of at most most_bytes
    of text unless one file alone has more.

    The files are dealt by ranges of their paths; a range is folded in order, so batches do not cross ranges.
    """
    sized = files.withColumn("bytes", F.aggregate("lines", F.lit(0).cast("long"), lambda n, x: n + F.coalesce(F.octet_length(x["content"]), F.lit(0))))
    ordered = sized.repartitionByRange("source", "path").sortWithinPartitions("source", "path")
    schema = T.StructType([*files.schema.fields, T.StructField("batch", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, number, held, size, last = TaskContext.get().partitionId(), 0, 0, 0, None
        for batch in batches:
            names = []
            own, sizes = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("source", "bytes"))
            for source, n in zip(own, sizes, strict=True):
                if held and (source != last or held >= most_files or size + n > most_bytes):
                    number, held, size = number + 1, 0, 0
                held, size, last = held + 1, size + n, source
                names.append(f"{part}-{number}")
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(names, pa.string())], names=[*batch.schema.names[:-1], "batch"])

    return ordered.mapInArrow(run, schema)


def write_batches(files: DataFrame, landing: str, scan_timestamp: int, most_files: int = 200, most_bytes: int = 8 << 20) -> None:
    """Write files (source, path, mtime, size, kind, file_hash, is_new, force, lines as in BATCH) as change batches to a
    landing folder, one JSON object each, which `read_batches` takes up."""
    fields = ("path", "mtime", "size", "kind", "file_hash", "is_new", "force", "lines")
    dealt = deal_batches(files.select("source", *fields), most_files, most_bytes)
    rows = dealt.groupBy("source", "batch").agg(F.sort_array(F.collect_list(F.struct(*fields))).alias("files"))
    rows.select("source", F.lit(scan_timestamp).cast("long").alias("scan_timestamp"), "files").write.mode("append").option("compression", "gzip").json(landing)


def append_changes(batches: DataFrame, log: str, quarantine: str, checkpoint: str):
    """Start a query that appends to a log folder: changes and lines, by batch, and undecodable input to a quarantine.

    A batch that is run again after a failure overwrites its own folders, so each change is in the log once.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        numbered(changes_of(batch), batch_id).write.mode("overwrite").parquet(f"{log}/changes/batch={batch_id}")
        lines_of(batch).drop("request").write.mode("overwrite").parquet(f"{log}/lines/batch={batch_id}")
        bad = batch.filter("_corrupt_record is not null").select("_corrupt_record")
        bad.write.mode("overwrite").parquet(f"{quarantine}/batch={batch_id}")
        batch.unpersist()

    return batches.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def replay(files: DataFrame, lines: DataFrame, log: str, batch_ids: list[int]) -> tuple[DataFrame, DataFrame]:
    """files and lines of an index after the log's batches, in order."""
    spark = files.sparkSession
    for n in sorted(batch_ids):
        changed, told = (spark.read.parquet(f"{log}/{part}/batch={n}") for part in ("changes", "lines"))
        files, lines = apply_batch(files, lines, changed, told)
    return files, lines


def recent_then_live(spark: SparkSession, path: str, schema: str, newest: int = 20) -> tuple[DataFrame, DataFrame]:
    """An activity table's newest rows, oldest first, and the stream of the rows after them."""
    table = spark.read.schema(schema).parquet(path)
    last = table.agg(F.max("seq")).first()[0]
    recent = recent_activity(table, newest).orderBy("occurred_at", "seq")
    live = activity_stream(spark, path, schema)
    return recent.filter(F.col("seq") <= (last or 0)), live if last is None else live.filter(F.col("seq") > last)


def start_stats(activity: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str, rate_hz: float = 1.0):
    """Start the running statistics of an activity stream: sink gets the whole table after a change, rate_hz times a second at most."""
    writer = running_stats(activity).writeStream.outputMode("complete").foreachBatch(sink)
    return writer.option("checkpointLocation", checkpoint).trigger(processingTime=f"{max(1, round(1000 / rate_hz))} milliseconds").start()


def activity_stream(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows appended to an activity table."""
    return spark.readStream.schema(schema).parquet(path)


def running_stats(activity: DataFrame) -> DataFrame:
    """Counts of a stream by source and action, for the complete output mode."""
    return activity.groupBy("source", "action").agg(F.count(F.lit(1)).alias("count"))


def collapse_kinds(kinds: list[str]) -> str:
    """What a sequence of C, U, D amounts to: its last event, except that updates after a creation belong to it."""
    before = next((k for k in reversed(kinds) if k != "U"), None)
    return "C" if kinds[-1] == "U" and before == "C" else kinds[-1]


def debounced(events: DataFrame, seconds: int = 5, most: int = 200, late: str = "30 seconds") -> DataFrame:
    """Collapsed events of a stream (path, kind, seq, ts as timestamp): path, kind, events.

    A path's window opens at its first event and closes `seconds` later by event time, or at `most` events. Events
    that are later than `late` behind the newest one are dropped by the watermark.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, first = state.get if state.exists else ([], None)
        held = list(held)
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({"path": [key[0]], "kind": [collapse_kinds(held)], "events": [len(held)]})
            return
        for part in parts:
            for kind, ts in part.sort_values("seq")[["kind", "ts"]].itertuples(index=False):
                first = int(ts.timestamp() * 1000) if first is None else first
                held.append(kind)
                if len(held) >= most:
                    yield pd.DataFrame({"path": [key[0]], "kind": [collapse_kinds(held)], "events": [len(held)]})
                    held, first = [], None
        if held:
            state.update((held, first))
            state.setTimeoutTimestamp(max(first + seconds * 1000, state.getCurrentWatermarkMs() + 1))
        elif state.exists:
            state.remove()

    return events.withWatermark("ts", late).groupBy("path").applyInPandasWithState(
        run, "path string, kind string, events int", "kinds array<string>, first bigint", "append", GroupStateTimeout.EventTimeTimeout
    )


def rate_limited(requests: DataFrame, limit: int = 60, seconds: int = 60) -> DataFrame:
    """Requests of a stream (key, seq, ts in seconds) with allowed: windows open at a key's first request."""

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        opened, used = state.get if state.exists else (None, 0)
        for part in parts:
            part = part.sort_values(["ts", "seq"])
            allowed = []
            for ts in part["ts"]:
                if opened is None or ts - opened >= seconds:
                    opened, used = int(ts), 0
                used += 1
                allowed.append(used <= limit)
            yield pd.DataFrame({"key": key[0], "seq": part["seq"], "allowed": allowed})
        state.update((opened, used))

    return requests.groupBy("key").applyInPandasWithState(
        run, "key string, seq bigint, allowed boolean", "opened bigint, used int", "append", GroupStateTimeout.NoTimeout
    )


class CircuitBreaker:
    """Opens after a number of failures in a row; a success closes it."""

    def __init__(self, limit: int, alert: Callable[[int], None] = lambda n: None):
        self.limit, self.alert, self.failures = limit, alert, 0

    @property
    def open(self) -> bool:
        return self.failures >= self.limit

    def record(self, success: bool) -> bool:
        """Whether work may go on."""
        self.failures = 0 if success else self.failures + 1
        if self.failures == self.limit:
            self.alert(self.failures)
        return not self.open
