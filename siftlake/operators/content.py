"""Content-addressed store of extracted text: one row per line of each distinct hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

CHUNK_BYTES = 1024


def put(content: DataFrame, incoming: DataFrame, overwrite: bool = False) -> DataFrame:
    """content with the blobs of incoming (both file_hash, line_number, content). Without overwrite, known hashes stay."""
    old, new = (incoming, content) if overwrite else (content, incoming)
    known = old.select("file_hash").distinct()
    return old.unionByName(new.join(known, "file_hash", "left_anti"))


def blobs(lines: DataFrame) -> DataFrame:
    """One copy of each distinct content of lines: content slots of the least file of each hash."""
    own = lines.filter("file_hash is not null and line_number >= 2")
    keepers = lines.filter("file_hash is not null").groupBy("file_hash").agg(F.min(F.struct("source", "file_id")).alias("keeper"))
    kept = own.join(keepers, "file_hash").filter("source = keeper.source and file_id = keeper.file_id")
    return kept.select("file_hash", (F.col("line_number") - 2).alias("line_number"), F.rtrim("content").alias("content"))


def get_lines(content: DataFrame, file_hash: str, low: int, high: int) -> DataFrame:
    """Lines low to high of a blob, both included."""
    return content.filter((F.col("file_hash") == file_hash) & F.col("line_number").between(low, high)).orderBy("line_number")


def chunks(content: DataFrame, target: int = CHUNK_BYTES) -> DataFrame:
    """file_hash, chunk_num, start_line, end_line, data: lines dealt to chunks of about target bytes.

    A line belongs to the chunk in which the blob's bytes before it end; 0 gives a chunk a line.
    """
    width = F.octet_length("content") + 1
    before = F.coalesce(
        F.sum(width).over(Window.partitionBy("file_hash").orderBy("line_number").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)
    )
    slot = F.floor(before / target).cast("long") if target > 0 else F.col("line_number")
    dealt = content.withColumn("slot", slot)
    cut = dealt.groupBy("file_hash", "slot").agg(
        F.min("line_number").alias("start_line"), F.max("line_number").alias("end_line"), F.sort_array(F.collect_list(F.struct("line_number", "content"))).alias("parts")
    )
    number = F.row_number().over(Window.partitionBy("file_hash").orderBy("slot")) - 1
    return cut.select("file_hash", number.cast("long").alias("chunk_num"), "start_line", "end_line", F.array_join("parts.content", "\n").alias("data"))


def chunks_for_range(chunk_table: DataFrame, file_hash: str, low: int, high: int) -> DataFrame:
    """Chunks that overlap lines low to high."""
    return chunk_table.filter((F.col("file_hash") == file_hash) & (F.col("start_line") <= high) & (F.col("end_line") >= low)).orderBy("chunk_num")


def orphans(content: DataFrame, live: DataFrame) -> DataFrame:
    """Rows of content whose hash no live file has."""
    return content.join(live.filter("file_hash is not null").select("file_hash").distinct(), "file_hash", "left_anti")


def orphan_stats(content: DataFrame, live: DataFrame) -> DataFrame:
    return orphans(content, live).agg(
        F.count(F.lit(1)).alias("rows"), F.countDistinct("file_hash").alias("keys"), F.coalesce(F.sum(F.octet_length("content")), F.lit(0)).alias("bytes")
    )


def compact(content: DataFrame, live: DataFrame) -> DataFrame:
    """content without orphans."""
    return content.join(live.filter("file_hash is not null").select("file_hash").distinct(), "file_hash", "left_semi")


def should_compact(content: DataFrame, live: DataFrame, threshold: float = 10.0) -> DataFrame:
    """orphan_percent of the stored bytes and whether it reaches the threshold."""
    keys = live.filter("file_hash is not null").select("file_hash", F.lit(True).alias("alive")).distinct()
    width = F.octet_length("content")
    sums = content.join(keys, "file_hash", "left").agg(F.sum(width).alias("all"), F.sum(F.when(F.col("alive").isNull(), width).otherwise(0)).alias("dead"))
    percent = F.when(F.col("all") > 0, F.col("dead") * 100.0 / F.col("all")).otherwise(F.lit(0.0))
    return sums.select(percent.alias("orphan_percent")).withColumn("compact", F.col("orphan_percent") >= threshold)


def pending(files: DataFrame, content: DataFrame) -> DataFrame:
    """Number of distinct hashes of files that have no content yet."""
    missing = files.filter("file_hash is not null").join(content.select("file_hash").distinct(), "file_hash", "left_anti")
    return missing.agg(F.countDistinct("file_hash").alias("pending"))


def lookup(hits: DataFrame, content: DataFrame) -> DataFrame:
    """Hits (file_hash, line_number of the file) with their content from the store; null while it is not stored."""
    stored = content.select("file_hash", (F.col("line_number") + 2).alias("line_number"), F.col("content").alias("stored"))
    return hits.join(stored, ["file_hash", "line_number"], "left")


def accepted_payloads(payloads: DataFrame, files: DataFrame) -> DataFrame:
    """Archive payloads whose hash is still that of their file; stale ones are left out. One text per payload."""
    live = payloads.join(files.select("source", "path", "file_hash"), ["source", "path", "file_hash"])
    ordered = F.sort_array(F.col("lines"))
    return live.select("file_hash", F.array_join(F.transform(ordered, lambda x: F.rtrim(x["content"])), "\n").alias("text"))
