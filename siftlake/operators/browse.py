"""Reading an index: directory listings, files, context windows, recent changes, palette, links."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from siftlake.functions import exprs
from siftlake.operators.search import with_duplicates
from siftlake.schemas import LINKS, PATH_SLOT
from siftlake.storage import join_small

MAX_RECENT = 1000


def _children(rest: Column) -> tuple[Column, Column]:
    """First step of a path below a prefix, and whether it is a file. A step ends at `/` or `::`, whichever is first."""
    slash, mark = F.instr(rest, "/"), F.instr(rest, "::")
    ends_at_slash = (slash > 0) & ((mark == 0) | (slash < mark))
    step = F.when(ends_at_slash, F.substring(rest, F.lit(1), slash - 1)).when(mark > 0, F.substring(rest, F.lit(1), mark - 1)).otherwise(rest)
    return step, ~ends_at_slash


def list_dir(files: DataFrame, prefix: str) -> DataFrame:
    """Immediate children below a prefix (empty, `dir/` or `archive::`): source, name, path, is_file, kind, size, mtime.

    Folders come first, then files, each by path. A plain folder does not list what is inside its archives; an
    archive's nested archive is a file of kind archive. A real file wins over a virtual one of the same path.
    """
    below = files.filter(F.startswith("path", F.lit(prefix)) & (F.length("path") > len(prefix))) if prefix else files
    if "::" not in prefix:
        below = below.filter(~exprs.is_composite(F.col("path")))
    rest = F.substring("path", len(prefix) + 1, 1 << 30)
    step, is_file = _children(rest)
    rows = below.select("source", step.alias("name"), is_file.alias("is_file"), (step == rest).alias("real"), "kind", "size", "mtime", "file_id")
    best = F.max(F.struct("real", "file_id", "kind", "size", "mtime")).alias("best")
    grouped = rows.groupBy("source", "name", "is_file").agg(best)
    own = lambda c: F.when(F.col("is_file") & F.col("best.real"), F.col(f"best.{c}"))
    kind = F.when(F.col("is_file"), F.coalesce(own("kind"), F.lit("archive")))
    tail = F.when(F.col("is_file"), F.lit("")).otherwise(F.lit("/"))
    return grouped.select(
        "source", "name", F.concat(F.lit(prefix), F.col("name"), tail).alias("path"), "is_file", kind.alias("kind"), own("size").alias("size"), own("mtime").alias("mtime")
    ).orderBy("source", "is_file", "path")


def ancestor_prefixes(path: str) -> list[str]:
    """Prefixes whose listings show the way to a path: the root, every folder, every archive."""
    return ["", *[path[: m.end()] for m in re.finditer(r"/|::", path)]]


def expand_tree(files: DataFrame, path: str) -> DataFrame:
    """Listings of all ancestors of a path, with the column prefix. The ancestors are few: one per path step."""
    parts = [list_dir(files, p).withColumn("prefix", F.lit(p)) for p in ancestor_prefixes(path)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def file_page(lines: DataFrame, source: str, path: str, offset: int = 0, limit: int | None = None) -> DataFrame:
    """Slots 0 and 1, and limit content lines from offset (all without a limit); total is the number of content lines."""
    own = lines.filter((F.col("source") == source) & (F.col("path") == path))
    low = 2 + offset
    inside = F.col("line_number") >= low
    if limit is not None:
        inside &= F.col("line_number") < low + limit
    total = own.agg(F.greatest(F.count(F.lit(1)) - 2, F.lit(0)).alias("total"))
    page = own.filter((F.col("line_number") < 2) | inside).crossJoin(F.broadcast(total))  # one row
    return page.select("line_number", "content", "total").orderBy("line_number")


def file_view(index, path: str, source: str, errors: DataFrame, offset: int = 0, limit: int | None = None) -> DataFrame:
    """One row about a file and a page of it: path, kind, mtime, size, total_lines, metadata (its path and tags), lines and
    their line_offsets (empty where they follow each other from slot 2 on), content_unavailable, indexing_error (an
    archive member's own, else its archive's), duplicate_paths.

    index has files and lines (see siftlake.plans.corpus.Index); errors: source, path, error. An unknown file gives no
    row. A page without a limit is the whole file, which has MAX_LINES_PER_FILE lines at most.
    """
    own = index.files.filter((F.col("source") == source) & (F.col("path") == path))
    page = file_page(index.lines, source, path, offset, limit)
    content, shown = F.col("line_number") >= 2, exprs.strip_path_mark(F.col("content"))
    sorted_of = lambda keep, text: F.sort_array(F.collect_list(F.when(keep, F.struct("line_number", text.alias("text")))))
    told = page.agg(
        F.max("total").alias("total_lines"), sorted_of(~content & (shown != ""), shown)["text"].alias("metadata"),
        sorted_of(content, F.col("content")).alias("rows"), F.max(content).alias("has_content"),
    )
    offsets = F.col("rows.line_number")
    plain = F.forall(F.transform(offsets, lambda n, i: n == i + 2), lambda same: same)
    absent = (F.coalesce("total_lines", F.lit(0)) > offset) & ~F.coalesce("has_content", F.lit(False))
    told = told.select(
        "total_lines", "metadata", F.col("rows.text").alias("lines"),
        F.when(plain, F.array().cast("array<bigint>")).otherwise(offsets).alias("line_offsets"), absent.alias("content_unavailable"),
    )
    found = member_errors(own.crossJoin(F.broadcast(told)), errors).withColumnRenamed("error", "indexing_error")  # one row each
    return with_duplicates(found, index.files).drop("text")


def gap_filled(lines: DataFrame, source: str, path: str, start: int, end: int) -> DataFrame:
    """Lines [start, end) of a file, empty where the index has none."""
    spark = lines.sparkSession
    slots = spark.range(start, end).withColumnRenamed("id", "line_number")
    own = lines.filter((F.col("source") == source) & (F.col("path") == path)).select("line_number", "content")
    return slots.join(own, "line_number", "left").select("line_number", F.coalesce("content", F.lit("")).alias("content")).orderBy("line_number")


def needs_offsets(lines: DataFrame) -> DataFrame:
    """source, file_id, sequential: whether a file's content lines are numbered without gaps."""
    content = lines.filter("line_number >= 2").groupBy("source", "file_id")
    spread = F.max("line_number") - F.min("line_number") + 1
    return content.agg((spread == F.count(F.lit(1))).alias("sequential"))


def context(lines: DataFrame, requests: DataFrame, window: int = 1) -> DataFrame:
    """Lines around requested ones: requests are (source, path, center).

    request columns, line_number, content, match_index (place of the centre in its frame). A request of an unknown file
    has no lines. Each request is widened to its 2 * window + 1 line numbers, so the join is an equi-join on
    (source, path, line_number), with both sides hashed alike, instead of a range comparison within each file.
    """
    around = F.explode(F.sequence(F.greatest(F.col("center") - window, F.lit(0)), F.col("center") + window))
    wide = requests.select("source", "path", "center", around.alias("line_number"))
    found = join_small(lines.select("source", "path", "line_number", "content"), wide, ["source", "path", "line_number"])
    frame = Window.partitionBy("source", "path", "center")
    index = F.sum((F.col("line_number") < F.col("center")).cast("long")).over(frame)
    return found.withColumn("match_index", index)


def metadata_context(lines: DataFrame, source: str, path: str) -> DataFrame:
    """The metadata slot of an image or audio file."""
    return lines.filter((F.col("source") == source) & (F.col("path") == path) & (F.col("line_number") == 1)).select("line_number", "content")


def list_files(files: DataFrame, source: str | None = None) -> DataFrame:
    rows = files.filter(F.col("source") == source) if source else files
    return rows.orderBy("path", "source")


def list_sources(files: DataFrame) -> DataFrame:
    return files.select("source").distinct().orderBy("source")


def palette(files: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Files whose path holds the query; an empty query lists those indexed last."""
    if query:
        found = files.filter(exprs.contains_term(F.col("path"), query)).orderBy("path", "source")
    else:
        seen = F.coalesce("indexed_at", "mtime") if "indexed_at" in files.columns else F.col("mtime")
        found = files.orderBy(F.desc(seen), "path", "source")
    return found.limit(limit)


def recent_files(files: DataFrame, limit: int = 20, by: str = "mtime") -> DataFrame:
    """Files of the latest time, archive members left out."""
    return files.filter(~exprs.is_composite(F.col("path"))).orderBy(F.desc(by), "source", "path").limit(limit)


def recent_activity(activity: DataFrame, limit: int = 20) -> DataFrame:
    if not 0 <= limit <= MAX_RECENT:
        raise ValueError(f"limit must lie between 0 and {MAX_RECENT}")
    return activity.orderBy(F.desc("occurred_at"), F.desc("seq")).limit(limit)


def member_errors(members: DataFrame, errors: DataFrame) -> DataFrame:
    """members with error: the member's own, else that of its outer archive. errors: source, path, error."""
    own = errors.select("source", "path", F.col("error").alias("own_error"))
    outer = errors.select("source", F.col("path").alias("outer_path"), F.col("error").alias("outer_error"))
    rows = members.withColumn("outer_path", exprs.outer_path(F.col("path")))
    rows = rows.join(own, ["source", "path"], "left").join(outer, ["source", "outer_path"], "left")
    return rows.withColumn("error", F.coalesce("own_error", "outer_error")).drop("own_error", "outer_error", "outer_path")


def create_links(spark: SparkSession, targets: list[tuple], now: int, ttl: int, new_code) -> DataFrame:
    """A links table of (source, path, archive_path, kind, mtime); a ttl of 0 never expires."""
    rows = [(new_code(), *t, now, None if ttl == 0 else now + ttl) for t in targets]
    return spark.createDataFrame(rows, LINKS)


def resolve_link(links: DataFrame, code: str, now: int) -> DataFrame:
    return live_links(links, now).filter(F.col("code") == code)


def live_links(links: DataFrame, now: int) -> DataFrame:
    """Links that have not expired."""
    return links.filter(F.col("expires_at").isNull() | (F.col("expires_at") >= now))
