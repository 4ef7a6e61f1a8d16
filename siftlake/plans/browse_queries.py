"""Queries for browsing and statistics."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlake.functions import exprs
from siftlake.operators import browse, content, search, stats
from siftlake.operators.search import SearchParams
from siftlake.plans.corpus import ACTIVITY_SQL, FILES_SQL, LINES_SQL, MEMBERS_SQL, activity, archive_members, document_files, document_index
from siftlake.storage import read_table

QUERIES: dict = {}
ORACLE: dict = {}


def _query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


def _requests(spark, d):
    files = document_files(spark, d)
    return files.select("source", "path", (F.lit(2) + F.col("file_id") % 5).alias("center"))


_REQUESTS_SQL = "r as (select source, path, 2 + file_id % 5 as center from files)"


@_query(
    "j6_context_batch",
    f"with {LINES_SQL}, {_REQUESTS_SQL} select r.source, r.path, r.center, l.line_number, l.content, "
    "count(*) filter (l.line_number < r.center) over (partition by r.source, r.path, r.center) as match_index "
    "from r join lines l on l.source = r.source and l.path = r.path and l.line_number between r.center - 5 and r.center + 5",
)
def j6_context_batch(spark, d):
    return browse.context(document_index(spark, d).lines, _requests(spark, d), window=5)


@_query(
    "w3_context",
    f"with {LINES_SQL} select line_number, content, count(*) filter (line_number < 3) over () as match_index from lines where file_id = 11 and line_number between 2 and 4",
)
def w3_context(spark, d):
    wanted = document_files(spark, d).filter("file_id = 11").select("source", "path", F.lit(3).cast("long").alias("center"))
    return browse.context(document_index(spark, d).lines, wanted).select("line_number", "content", "match_index")


def _file(spark, d, file_id: int):
    row = document_files(spark, d).filter(F.col("file_id") == file_id).select("source", "path").first()
    return (row["source"], row["path"]) if row else ("", "")


@_query(
    "t8_file_page",
    f"with {LINES_SQL}, o as (select * from lines where file_id = 12) select line_number, content, (select count(*) - 2 from o)::bigint as total from o "
    "where line_number < 2 or (line_number >= 3 and line_number < 6)",
)
def t8_file_page(spark, d):
    return browse.file_page(document_index(spark, d).lines, *_file(spark, d, 12), offset=1, limit=3)


@_query(
    "w8_gap_fill",
    f"with {LINES_SQL} select g.i as line_number, coalesce(l.content, '') as content from generate_series(0, 199) as g(i) "
    "left join (select * from lines where file_id = 12) l on l.line_number = g.i",
)
def w8_gap_fill(spark, d):
    return browse.gap_filled(document_index(spark, d).lines, *_file(spark, d, 12), 0, 200)


@_query(
    "w10_offsets",
    f"with {LINES_SQL} select source, file_id, max(line_number) - min(line_number) + 1 = count(*) as sequential from lines "
    "where line_number >= 2 and content <> '' group by source, file_id",
)
def w10_offsets(spark, d):
    # Empty lines are not stored, which leaves gaps.
    return browse.needs_offsets(document_index(spark, d).lines.filter("content <> ''"))


@_query(
    "b1_list_dir",
    f"with {FILES_SQL}, b as (select source, split_part(substr(path, 4), '/', 1) as name from files where starts_with(path, 'en/')) "
    "select distinct source, name, 'en/' || name || '/' as path, false as is_file from b",
)
def b1_list_dir(spark, d):
    return browse.list_dir(document_files(spark, d), "en/").select("source", "name", "path", "is_file")


@_query(
    "b1_list_files",
    f"with {FILES_SQL} select source, substr(path, 6) as name, path, true as is_file, kind, size, mtime from files where starts_with(path, 'en/1/')",
)
def b1_list_files(spark, d):
    return browse.list_dir(document_files(spark, d), "en/1/")


def _members(spark, d):
    plain = document_files(spark, d).select("source", "file_id", "path", "kind", "size", "mtime")
    inner = archive_members(spark, d).select(
        "source", "file_id", "path", F.lit("text").alias("kind"), F.lit(1).cast("long").alias("size"), F.lit(0).cast("long").alias("mtime")
    )
    return plain.union(inner)


@_query(
    "b2_archive_listing",
    f"with {MEMBERS_SQL}, b as (select source, split_part(substr(path, 12), '/', 1) as name from members where starts_with(path, 'arc_3.zip::')) "
    "select distinct source, name, 'arc_3.zip::' || name || '/' as path, false as is_file from b",
)
def b2_archive_listing(spark, d):
    return browse.list_dir(_members(spark, d), "arc_3.zip::").select("source", "name", "path", "is_file")


@_query(
    "b2_plain_root",
    f"with {FILES_SQL} select distinct source, split_part(path, '/', 1) as name, split_part(path, '/', 1) || '/' as path, false as is_file from files",
)
def b2_plain_root(spark, d):
    return browse.list_dir(_members(spark, d), "").select("source", "name", "path", "is_file")


@_query(
    "b3_expand_tree",
    f"with {FILES_SQL} select distinct '' as prefix, source, split_part(path, '/', 1) || '/' as path from files "
    "union all select distinct 'en/', source, 'en/' || split_part(path, '/', 2) || '/' from files where starts_with(path, 'en/') "
    "union all select 'en/1/', source, path from files where starts_with(path, 'en/1/')",
)
def b3_expand_tree(spark, d):
    return browse.expand_tree(document_files(spark, d), "en/1/doc_1.md").select("prefix", "source", "path")


@_query("f17_palette", f"with {FILES_SQL} select source, path, file_id from files where contains(lower(path), 'doc_9') order by path, source limit 50")
def f17_palette(spark, d):
    return browse.palette(document_files(spark, d), "DOC_9").select("source", "path", "file_id")


@_query("src17_list_files", f"with {FILES_SQL} select source, path, mtime, kind from files")
def src17_list_files(spark, d):
    return browse.list_files(document_files(spark, d)).select("source", "path", "mtime", "kind")


@_query("src18_sources", "select distinct source from documents")
def src18_sources(spark, d):
    return browse.list_sources(document_files(spark, d))


@_query("t4_recent_mtime", f"with {FILES_SQL} select source, path, mtime from files order by mtime desc, source, path limit 20")
def t4_recent_mtime(spark, d):
    return browse.recent_files(document_files(spark, d)).select("source", "path", "mtime")


@_query("t5_recent_activity", f"with {ACTIVITY_SQL} select seq, occurred_at, action, path, new_path from activity order by occurred_at desc, seq desc limit 100")
def t5_recent_activity(spark, d):
    return browse.recent_activity(activity(spark, d), 100).select("seq", "occurred_at", "action", "path", "new_path")


@_query(
    "j11_error_fallback",
    f"with {MEMBERS_SQL}, e as (select source, path, 'own' as error from members where has_error union all select distinct source, 'arc_' || (file_id % 7)::varchar || '.zip', 'outer' from members where file_id % 7 < 3) "
    "select m.source, m.path, coalesce(o.error, u.error) as error from members m left join e o on o.source = m.source and o.path = m.path "
    "left join e u on u.source = m.source and u.path = split_part(m.path, '::', 1)",
)
def j11_error_fallback(spark, d):
    m = archive_members(spark, d)
    outer = m.filter("file_id % 7 < 3").select("source", exprs.outer_path(F.col("path")).alias("path"), F.lit("outer").alias("error")).distinct()
    own = m.filter("has_error").select("source", "path", F.lit("own").alias("error"))
    return browse.member_errors(m, own.union(outer)).select("source", "path", "error")


@_query("a1_by_kind", f"with {FILES_SQL} select kind, count(*) as count, coalesce(sum(size), 0)::bigint as size from files group by kind")
def a1_by_kind(spark, d):
    return stats.kinds(document_files(spark, d))


@_query(
    "a1_by_source_and_kind",
    f"with {FILES_SQL} select source, kind, count(*) as count, coalesce(sum(size), 0)::bigint as size from files group by rollup (source, kind) having source is not null",
)
def a1_by_source_and_kind(spark, d):
    return stats.by_kind(document_files(spark, d)).drop("avg_extract_ms")


@_query(
    "a2_by_ext",
    f"with {FILES_SQL} select lower(regexp_extract(path, '[^.]*$')) as ext, count(*) as count, sum(size)::bigint as size from files group by 1 order by 2 desc, 1 limit 100",
)
def a2_by_ext(spark, d):
    return stats.by_extension(document_files(spark, d))


@_query(
    "a3_rows",
    f"with {LINES_SQL} select (select count(*) from files) as total_files, (select count(*) from files) as outer_files, "
    "(select sum(size) from files)::bigint as total_size, (select count(*) from lines) as indexed_lines",
)
def a3_rows(spark, d):
    index = document_index(spark, d)
    return stats.totals(index.files, index.lines)


@_query(
    "a13_snapshot",
    f"with {FILES_SQL} select source, 1700000000 as scanned_at, count(*) as total_files, sum(size)::bigint as total_size, count(*) filter (kind = 'pdf') as pdf_files from files group by source",
)
def a13_snapshot(spark, d):
    snap = stats.snapshot(document_files(spark, d), 1_700_000_000)
    pdf = F.coalesce(F.col("by_kind")["pdf"]["count"], F.lit(0)).cast("long")
    return snap.select("source", F.col("scanned_at").cast("int").alias("scanned_at"), "total_files", "total_size", pdf.alias("pdf_files"))


@_query(
    "a11_delta",
    f"with {FILES_SQL}, b as (select source, kind, 1 as count, size from files union all select source, kind, -2, -2 * size from files where file_id % 5 = 2) "
    "select source, kind, greatest(sum(count), 0)::bigint as count, greatest(sum(size), 0)::bigint as size from b group by source, kind",
)
def a11_delta(spark, d):
    files = document_files(spark, d)
    base = files.select("source", "kind", F.lit(1).alias("count"), "size")
    gone = files.filter("file_id % 5 = 2").select("source", "kind", F.lit(-2).alias("count"), (F.col("size") * -2).alias("size"))
    return stats.apply_deltas(base, gone)


@_query(
    "a10_delete_delta",
    f"with {FILES_SQL} select f.source, f.kind, -count(*) as count, -sum(f.size)::bigint as size from files f join labels l on l.doc_id = f.file_id where l.toxic = 1 group by all",
)
def a10_delete_delta(spark, d):
    files = document_files(spark, d)
    toxic = read_table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("file_id"))
    return stats.delete_delta(files, files.join(toxic, "file_id", "left_semi"))


@_query(
    "b5_file_view",
    f"with {LINES_SQL}, o as (select * from lines where file_id = 12) select path, kind, mtime, size, (select count(*) - 2 from o)::bigint as total_lines, path as metadata, "
    "(select string_agg(content, chr(10) order by line_number) from o where line_number between 3 and 5) as lines, "
    "(select string_agg(line_number::varchar, ',' order by line_number) from o where line_number between 3 and 5) as line_offsets, 'broken' as indexing_error, "
    "(select count(*) from files f where f.file_hash = files.file_hash and f.file_id <> 12) as duplicates from files where file_id = 12",
)
def b5_file_view(spark, d):
    source, path = _file(spark, d, 12)
    errors = spark.createDataFrame([(source, path, "broken")], "source string, path string, error string")
    seen = browse.file_view(document_index(spark, d), path, source, errors, offset=1, limit=3)
    return seen.select(
        "path", "kind", "mtime", "size", "total_lines", F.array_join("metadata", " ").alias("metadata"), F.array_join("lines", "\n").alias("lines"),
        F.array_join(F.col("line_offsets").cast("array<string>"), ",").alias("line_offsets"), "indexing_error", F.size("duplicate_paths").cast("long").alias("duplicates"),
    )


_CONTENT_SQL = (
    "keep as (select file_hash, min({'s': source, 'f': file_id}) as k from files group by file_hash), "
    "stored as (select l.file_hash, line_number - 2 as line_number, rtrim(content) as content from lines l join keep on keep.file_hash = l.file_hash "
    "and keep.k.s = l.source and keep.k.f = l.file_id where line_number >= 2), live as (select * from files where file_id % 4 <> 0)"
)


def _content(spark, d):
    index = document_index(spark, d)
    return content.blobs(index.lines), index.files.filter("file_id % 4 <> 0")


@_query(
    "a6_orphans",
    f"with {LINES_SQL}, {_CONTENT_SQL} select count(*) as rows, count(distinct file_hash) as keys, coalesce(sum(strlen(content)), 0)::bigint as bytes from stored "
    "where not exists (select 1 from live where live.file_hash = stored.file_hash)",
)
def a6_orphans(spark, d):
    return content.orphan_stats(*_content(spark, d))


@_query(
    "j9_orphan_keys",
    f"with {LINES_SQL}, {_CONTENT_SQL} select distinct file_hash from stored where not exists (select 1 from live where live.file_hash = stored.file_hash)",
)
def j9_orphan_keys(spark, d):
    return content.orphans(*_content(spark, d)).select("file_hash").distinct()


@_query(
    "c4_compact",
    f"with {LINES_SQL}, {_CONTENT_SQL} select file_hash, line_number, content from stored where exists (select 1 from live where live.file_hash = stored.file_hash)",
)
def c4_compact(spark, d):
    return content.compact(*_content(spark, d))


@_query(
    "a15_compaction_due",
    f"with {LINES_SQL}, {_CONTENT_SQL}, o as (select strlen(content) as n, exists (select 1 from live where live.file_hash = stored.file_hash) as alive from stored) "
    "select round(sum(case when alive then 0 else n end) * 100.0 / sum(n), 6) as orphan_percent, sum(case when alive then 0 else n end) * 100.0 / sum(n) >= 10 as compact from o",
)
def a15_compaction_due(spark, d):
    return content.should_compact(*_content(spark, d)).withColumn("orphan_percent", F.round("orphan_percent", 6))


@_query(
    "j10_pending",
    f"with {LINES_SQL}, {_CONTENT_SQL} select count(distinct file_hash) as pending from files where not exists (select 1 from live where live.file_hash = files.file_hash)",
)
def j10_pending(spark, d):
    stored, live = _content(spark, d)
    return content.pending(document_files(spark, d).drop("text"), content.compact(stored, live))


@_query(
    "c1_chunks",
    f"with {LINES_SQL}, {_CONTENT_SQL}, b as (select *, coalesce(sum(strlen(content) + 1) over (partition by file_hash order by line_number rows between unbounded preceding and 1 preceding), 0) // 1024 as slot from stored), "
    "g as (select file_hash, slot, min(line_number) as start_line, max(line_number) as end_line, string_agg(content, chr(10) order by line_number) as data from b group by file_hash, slot) "
    "select file_hash, (row_number() over (partition by file_hash order by slot) - 1)::bigint as chunk_num, start_line, end_line, data from g",
)
def c1_chunks(spark, d):
    return content.chunks(_content(spark, d)[0])


@_query(
    "src19_chunk_range",
    f"with {LINES_SQL}, {_CONTENT_SQL}, b as (select *, coalesce(sum(strlen(content) + 1) over (partition by file_hash order by line_number rows between unbounded preceding and 1 preceding), 0) // 1024 as slot from stored), "
    "g as (select file_hash, slot, min(line_number) as start_line, max(line_number) as end_line from b group by file_hash, slot) "
    "select start_line, end_line from g where file_hash = (select file_hash from files where file_id = 12) and start_line <= 5 and end_line >= 3",
)
def src19_chunk_range(spark, d):
    row = document_files(spark, d).filter("file_id = 12").select("file_hash").first()
    found = content.chunks_for_range(content.chunks(_content(spark, d)[0]), row["file_hash"] if row else "", 3, 5)
    return found.select("start_line", "end_line")


@_query(
    "j5_content_lookup",
    f"with {LINES_SQL}, {_CONTENT_SQL} select l.source, l.file_id, l.line_number, s.content as stored from lines l left join stored s on s.file_hash = l.file_hash and s.line_number = l.line_number - 2 "
    "where contains(lower(l.content), 'of the')",
)
def j5_content_lookup(spark, d):
    index = document_index(spark, d)
    hits = search.candidates(index, SearchParams("of the", mode="exact"))
    return content.lookup(hits, content.blobs(index.lines)).select("source", "file_id", "line_number", "stored")


@_query(
    "j12_accepted_payloads",
    f"with {LINES_SQL} select f.file_hash, string_agg(rtrim(l.content), chr(10) order by l.line_number) as text from files f join lines l on l.source = f.source and l.file_id = f.file_id "
    "where l.line_number >= 2 and f.kind <> 'pdf' group by f.source, f.path, f.file_hash",
)
def j12_accepted_payloads(spark, d):
    index = document_index(spark, d)
    parts = index.lines.filter("line_number >= 2").groupBy("source", "path", "file_hash").agg(F.collect_list(F.struct("line_number", "content")).alias("lines"))
    # The PDF files have changed since they were sent.
    now = index.files.withColumn("file_hash", F.when(F.col("kind") == "pdf", F.lit("changed")).otherwise(F.col("file_hash")))
    return content.accepted_payloads(parts, now)


@_query("c3_get_lines", f"with {LINES_SQL} select line_number - 2 as line_number, rtrim(content) as content from lines where file_id = 12 and line_number between 5 and 9")
def c3_get_lines(spark, d):
    row = document_files(spark, d).filter("file_id = 12").select("file_hash").first()
    return content.get_lines(content.blobs(document_index(spark, d).lines), row["file_hash"] if row else "", 3, 7).select("line_number", "content")


@_query(
    "labels_join",
    "select l.quality, l.toxic, count(*) as files from documents d join labels l using (doc_id) group by all",
)
def labels_join(spark, d):
    joined = document_files(spark, d).join(read_table(spark, d, "labels").withColumnRenamed("doc_id", "file_id"), "file_id")
    return joined.groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("files"))
