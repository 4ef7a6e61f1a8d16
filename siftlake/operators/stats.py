"""Statistics: rollups over files, snapshots, deltas, errors, storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siftlake.functions import exprs


def by_kind(files: DataFrame) -> DataFrame:
    """count, size and mean extraction time of each source's kinds; rows of null kind are a source's totals."""
    spent = F.avg("extract_ms") if "extract_ms" in files.columns else F.lit(None).cast("double")
    return files.rollup("source", "kind").agg(
        F.count(F.lit(1)).alias("count"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"), spent.alias("avg_extract_ms")
    ).filter("source is not null")


def kinds(files: DataFrame) -> DataFrame:
    return files.groupBy("kind").agg(F.count(F.lit(1)).alias("count"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"))


def by_extension(files: DataFrame, limit: int = 100) -> DataFrame:
    """The most frequent extensions of files outside archives."""
    rows = files.filter(~exprs.is_composite(F.col("path"))).withColumn("ext", exprs.extension(F.col("path"))).filter("ext <> ''")
    counted = rows.groupBy("ext").agg(F.count(F.lit(1)).alias("count"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"))
    return counted.orderBy(F.desc("count"), "ext").limit(limit)


def totals(files: DataFrame, lines: DataFrame) -> DataFrame:
    """total_files, outer_files, total_size, indexed_lines."""
    outer = (~exprs.is_composite(F.col("path"))).cast("long")
    a = files.agg(F.count(F.lit(1)).alias("total_files"), F.coalesce(F.sum(outer), F.lit(0)).alias("outer_files"), F.coalesce(F.sum("size"), F.lit(0)).alias("total_size"))
    return a.crossJoin(lines.agg(F.count(F.lit(1)).alias("indexed_lines")))


def snapshot(files: DataFrame, scanned_at: int) -> DataFrame:
    """A scan history row of each source: scanned_at, total_files, total_size, by_kind (map to count and size)."""
    per = files.groupBy("source", "kind").agg(F.count(F.lit(1)).alias("count"), F.coalesce(F.sum("size"), F.lit(0)).alias("size"))
    entry = F.struct("kind", F.struct("count", "size"))
    return per.groupBy("source").agg(
        F.lit(scanned_at).cast("long").alias("scanned_at"), F.sum("count").alias("total_files"), F.sum("size").alias("total_size"),
        F.map_from_entries(F.sort_array(F.collect_list(entry))).alias("by_kind"),
    )


def history(scans: DataFrame, limit: int = 100) -> DataFrame:
    """The newest points of the scan history, oldest first."""
    return scans.orderBy(F.desc("scanned_at")).limit(limit).orderBy("scanned_at")


def apply_deltas(current: DataFrame, deltas: DataFrame) -> DataFrame:
    """source, kind, count, size after deltas; sums do not fall below zero."""
    both = current.select("source", "kind", "count", "size").unionByName(deltas.select("source", "kind", "count", "size"))
    floor = lambda c: F.greatest(F.sum(c), F.lit(0)).alias(c)
    return both.groupBy("source", "kind").agg(floor("count"), floor("size"))


def errors(failures: DataFrame, clears: DataFrame | None = None) -> DataFrame:
    """source, path, error, first_seen, last_seen, count of failures that no later success has cleared.

    failures: source, path, seq, ts, error; clears: source, path, seq. The last error text stays.
    """
    rows = failures
    if clears is not None:
        last = clears.groupBy("source", "path").agg(F.max("seq").alias("cleared"))
        rows = rows.join(last, ["source", "path"], "left").filter("cleared is null or seq > cleared").drop("cleared")
    return rows.groupBy("source", "path").agg(
        F.max_by("error", "seq").alias("error"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.count(F.lit(1)).alias("count")
    )


def errors_page(found: DataFrame, limit: int = 200, offset: int = 0) -> DataFrame:
    return found.orderBy(F.desc("last_seen"), "source", "path").offset(offset).limit(min(limit, 1000))


def batch_summary(batches: DataFrame) -> DataFrame:
    """Per queued batch: files, content lines, deletions and failures. batches: id, files (array of structs with lines), delete_paths, failures."""
    content = F.aggregate("files", F.lit(0), lambda n, f: n + F.size(F.filter(f["lines"], lambda x: x["line_number"] >= 2)))
    return batches.select(
        "id", F.size("files").alias("files"), content.alias("content_lines"), F.size("delete_paths").alias("deletes"), F.size("failures").alias("failures")
    )


def delete_delta(files: DataFrame, gone: DataFrame) -> DataFrame:
    """source, kind, count, size that the deletion of paths (source, path) takes from the totals; archive members do not count."""
    outer = files.filter(~exprs.is_composite(F.col("path"))).join(gone.select("source", "path").distinct(), ["source", "path"], "left_semi")
    return outer.groupBy("source", "kind").agg((-F.count(F.lit(1))).alias("count"), (-F.coalesce(F.sum("size"), F.lit(0))).alias("size"))
