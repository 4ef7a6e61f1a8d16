"""From files to index tables: binary files in, one row per line out."""

from __future__ import annotations

import re
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siftlake.functions import exprs
from siftlake.functions.query import glob_to_regex, include_prefixes
from siftlake.functions.text import MAX_LINE
from siftlake.schemas import SCANNER_VERSION
from siftlake.sources import archives
from siftlake.sources.extract import extract, html_text
from siftlake.storage import ship_package

LINE_ROWS = "path string, mtime bigint, size bigint, line_number bigint, content string, error string"


def scan(spark: SparkSession, root: str, includes: tuple[str, ...] = (), excludes: tuple[str, ...] = (), include_hidden: bool = False) -> DataFrame:
    """path (relative), mtime, size, content of the files below root.

    Include patterns narrow the folders that are listed at all; hidden files and folders are left out unless asked for.
    """
    folders = include_prefixes(list(includes)) if includes else None
    paths = [f"{root.rstrip('/')}/{f}" for f in folders] if folders else [root]
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(paths)
    base = F.regexp_replace(F.lit(root.rstrip("/") + "/"), "^file:/*", "/")
    plain = F.regexp_replace("path", "^file:/*", "/")
    rows = files.select(
        F.substring(plain, F.length(base) + 1, F.lit(1 << 30)).alias("path"), F.unix_timestamp("modificationTime").alias("mtime"), F.col("length").alias("size"), "content"
    )
    if not include_hidden:
        rows = rows.filter(~exprs.has_hidden_component(F.col("path")))
    for pattern in excludes:
        rows = rows.filter(~F.rlike("path", F.lit(glob_to_regex(pattern))))
    if includes:
        keep = F.lit(False)
        for pattern in includes:
            keep |= F.rlike("path", F.lit(glob_to_regex(pattern)))
        rows = rows.filter(keep)
    return rows


def extract_lines(files: DataFrame, now: int | None = None, max_line: int = MAX_LINE) -> DataFrame:
    """Lines of files (path, mtime, size, content), archive members included: LINE_ROWS.

    A member is a file of its own with the path archive::member. Damaged files and members have their slots 0 and 1 and
    an error.
    """
    ship_package(files.sparkSession)
    now = int(time.time()) if now is None else now
    names = ["path", "mtime", "size", "line_number", "content", "error"]
    schema = pa.schema([("path", pa.string()), ("mtime", pa.int64()), ("size", pa.int64()), ("line_number", pa.int64()), ("content", pa.string()), ("error", pa.string())])

    def lines_of(path: str, mtime, size, data: bytes, error: str | None = None):
        found = extract(path, data, max_line)
        for number, content in found.rows(path):
            yield path, mtime, size, number, content, error or found.error

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for path, mtime, size, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = data or b""
                if archives.is_archive(path):
                    rows += [(path, mtime, size, 0, f"[PATH] {path}", None), (path, mtime, size, 1, "", None)]
                    for m in archives.members(path, data, now):
                        if m.skipped and m.path == path:
                            rows[-2:] = [(path, mtime, size, 0, f"[PATH] {path}", m.skipped), (path, mtime, size, 1, "", m.skipped)]
                            continue
                        rows += lines_of(f"{path}::{m.path}", m.mtime, m.size, m.data or b"", m.skipped)
                else:
                    rows += lines_of(path, mtime, size, data)
                while len(rows) >= 20_000:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows[:20_000]], schema=schema)
                    rows = rows[20_000:]
            yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=schema)

    return files.select("path", "mtime", "size", "content").mapInArrow(run, LINE_ROWS)


def file_rows(lines: DataFrame, source: str) -> DataFrame:
    """files rows of extracted lines; the kind is that of the extension, refined by MIME tags and content lines."""
    mime = F.max(F.when(F.col("line_number") == 1, F.regexp_extract("content", r"\[FILE:mime\] (\S+)", 1)))
    per = lines.groupBy("path", "mtime", "size").agg(
        F.count(F.lit(1)).alias("line_count"), mime.alias("mime"), F.max((F.col("line_number") >= 2).cast("int")).alias("has_content")
    )
    kind = exprs.kind_of_extension(exprs.leaf_extension(F.col("path")))
    refined = F.when(~kind.isin("text", "unknown"), kind).when(F.coalesce("mime", F.lit("")) != "", exprs.kind_of_mime(F.col("mime")))
    refined = refined.when(F.col("has_content") == 1, F.lit("text")).otherwise(F.lit("unknown"))
    return per.select(
        F.lit(source).alias("source"), F.xxhash64(F.lit(source), "path").alias("file_id"), "path", "mtime", "size", refined.alias("kind"),
        F.lit(SCANNER_VERSION).alias("scanner_version"), "line_count",
    )


def html_titles(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with title and text: what the HTML extractor finds in a column. A null page has neither."""
    ship_package(pages.sparkSession)
    at, schema = pages.columns.index(html), T.StructType([*pages.schema.fields, T.StructField("title", T.StringType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if page is None else html_text(page) for page in batch.column(at).to_pylist()]
            titles = [None if x is None else dict(x.tags).get("HTML:title", "") for x in found]
            texts = [None if x is None else "\n".join(x.lines) for x in found]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(titles, pa.string()), pa.array(texts, pa.string())], names=[*batch.schema.names, "title", "text"])

    return pages.mapInArrow(run, schema)


def byte_range(files: DataFrame, start: int, end: int | None = None) -> DataFrame:
    """files with content cut to the bytes from start to end, both included (to the last without an end), and total: the size."""
    length = F.lit(1 << 30) if end is None else F.lit(max(0, end - start + 1))
    return files.withColumn("total", F.octet_length("content")).withColumn("content", F.substring("content", F.lit(start + 1), length))


def parse_range(header: str, total: int) -> tuple[int, int] | None:
    """First and last byte of a Range header (`bytes=a-b`, `bytes=a-`, `bytes=-n`); None if it cannot be met."""
    m = re.fullmatch(r"bytes=(\d*)-(\d*)", header.strip())
    if not m or m[0] == "bytes=-" or total == 0:
        return None
    if not m[1]:
        return (max(0, total - int(m[2])), total - 1) if int(m[2]) else None
    first, last = int(m[1]), min(int(m[2]), total - 1) if m[2] else total - 1
    return (first, last) if first <= last else None
