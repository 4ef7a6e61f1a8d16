"""Views that turn the input tables into a content index."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftlake.schemas import PATH_MARK
from siftlake.storage import read_table

BASE_TIME = 1_700_000_000
_EXTENSIONS = ("txt", "md", "pdf", "rs", "docx")
_KINDS = ("text", "text", "pdf", "code", "document")


@dataclass(frozen=True)
class Index:
    """files and lines of an index (see siftlake.schemas), and whole texts per file where they are at hand."""

    files: DataFrame
    lines: DataFrame
    texts: DataFrame


def _choose(values: tuple, at) -> object:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (at % len(values) + 1).cast("int"))


def document_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as files, with their text."""
    d = read_table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    path = F.concat(F.col("lang"), F.lit("/"), (i % 10).cast("string"), F.lit("/doc_"), i.cast("string"), F.lit("."), _choose(_EXTENSIONS, i))
    return d.select(
        "source", i.alias("file_id"), path.alias("path"), _choose(_KINDS, i).alias("kind"), (F.lit(BASE_TIME) + i * 3600).alias("mtime"),
        F.col("n_chars").alias("size"), F.sha2("text", 256).alias("file_hash"), "text",
    )


def index_of(files_with_text: DataFrame) -> Index:
    """An index of files with a column text: slot 0 is the path, slot 1 is empty, content starts at slot 2."""
    slots = F.concat(F.array(F.concat(F.lit(PATH_MARK), F.col("path")), F.lit("")), F.split("text", "\n"))
    columns = ["source", "file_id", "path", "kind", "mtime", "size", "file_hash"]
    lines = files_with_text.select(*columns, F.posexplode(slots).alias("line_number", "content"))
    lines = lines.withColumn("line_number", F.col("line_number").cast("long"))
    whole = F.concat(F.lit(PATH_MARK), F.col("path"), F.lit("\n\n"), F.col("text"))
    texts = files_with_text.select(*columns, whole.alias("content"))
    return Index(files_with_text.drop("text"), lines, texts)


def document_index(spark: SparkSession, sf_dir: str) -> Index:
    return index_of(document_files(spark, sf_dir))


def activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as a change and activity log."""
    e = read_table(spark, sf_dir, "events")
    action = F.when(F.col("event_type") == "signup", "added").when(F.col("event_type") == "error", "deleted")
    action = action.when(F.col("event_type") == "purchase", "renamed").otherwise("modified")
    base = F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/f"), (F.col("event_id") % 20).cast("string"))
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")
    return e.select(
        F.lit("events").alias("source"), F.col("event_id").alias("seq"), seconds.alias("occurred_at"), action.alias("action"),
        F.concat(base, F.lit(".txt")).alias("path"), F.when(F.col("event_type") == "purchase", F.concat(base, F.lit(".new"))).alias("new_path"),
    )


def watch_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as file system events per user and day: create (C), delete (D), update (U)."""
    e = read_table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type") == "signup", "C").when(F.col("event_type") == "error", "D").otherwise("U")
    seconds = F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000).cast("long")
    return e.select("user_id", F.floor(seconds / 86400).cast("long").alias("day"), F.col("event_id").alias("seq"), seconds.alias("ts"), kind.alias("kind"))


def scan_snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """What the index knows of documents, and what a scan of the local files sees."""
    d = read_table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    server = d.filter(i % 10 != 3).select(
        i.alias("path"), (F.lit(BASE_TIME) + i * 3600).alias("known_mtime"), (7 + i % 2).alias("scanner_version"),
        F.when(i % 6 != 0, F.lit(BASE_TIME)).alias("indexed_at"),
    )
    late = F.when(i % 4 == 0, 60).otherwise(0)
    local = d.filter(i % 10 != 7).select(i.alias("path"), (F.lit(BASE_TIME) + i * 3600 + late).alias("mtime"))
    return server, local


def archive_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents as members of seven archives: file_id, path."""
    d = read_table(spark, sf_dir, "documents")
    i = F.col("doc_id")
    path = F.concat(F.lit("arc_"), (i % 7).cast("string"), F.lit(".zip::"), F.col("lang"), F.lit("/m_"), i.cast("string"), F.lit(".txt"))
    return d.select("source", i.alias("file_id"), path.alias("path"), (i % 3 == 0).alias("has_error"))


#: The same views for DuckDB, as common table expressions.
FILES_SQL = """files as (
  select doc_id as file_id, source,
         lang || '/' || (doc_id % 10)::varchar || '/doc_' || doc_id::varchar || '.' || (['txt','md','pdf','rs','docx'])[doc_id % 5 + 1] as path,
         1700000000 + doc_id * 3600 as mtime, n_chars as size, (['text','text','pdf','code','document'])[doc_id % 5 + 1] as kind,
         sha256(text) as file_hash, text
  from documents)"""
LINES_SQL = FILES_SQL + """,
lines as (
  select source, file_id, path, kind, mtime, size, file_hash, 0::bigint as line_number, '[PATH] ' || path as content from files
  union all select source, file_id, path, kind, mtime, size, file_hash, 1::bigint, '' from files
  union all select source, file_id, path, kind, mtime, size, file_hash, (i + 1)::bigint, p[i]
    from (select *, unnest(generate_series(1, len(p))) as i from (select *, string_split(text, chr(10)) as p from files)))"""
ACTIVITY_SQL = """activity as (
  select event_id as seq, 'events' as source, epoch_us(ts) // 1000000 as occurred_at,
         case event_type when 'signup' then 'added' when 'error' then 'deleted' when 'purchase' then 'renamed' else 'modified' end as action,
         concat('u', user_id::varchar, '/f', (event_id % 20)::varchar, '.txt') as path,
         case when event_type = 'purchase' then concat('u', user_id::varchar, '/f', (event_id % 20)::varchar, '.new') end as new_path
  from events)"""
WATCH_SQL = """watch as (
  select user_id, (epoch_us(ts) // 1000000) // 86400 as day, event_id as seq, epoch_us(ts) // 1000000 as ts,
         case event_type when 'signup' then 'C' when 'error' then 'D' else 'U' end as kind from events)"""
SCAN_SQL = """server as (
  select doc_id as path, 1700000000 + doc_id * 3600 as known_mtime, 7 + doc_id % 2 as scanner_version,
         case when doc_id % 6 = 0 then null else 1700000000 end as indexed_at from documents where doc_id % 10 <> 3),
seen as (select doc_id as path, 1700000000 + doc_id * 3600 + (case when doc_id % 4 = 0 then 60 else 0 end) as mtime from documents where doc_id % 10 <> 7)"""
MEMBERS_SQL = """members as (
  select source, doc_id as file_id, 'arc_' || (doc_id % 7)::varchar || '.zip::' || lang || '/m_' || doc_id::varchar || '.txt' as path, doc_id % 3 = 0 as has_error
  from documents)"""
