"""Queries over change logs, scans, errors and watched events."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftlake.operators import changes, stats
from siftlake.plans.corpus import (
    ACTIVITY_SQL, FILES_SQL, LINES_SQL, MEMBERS_SQL, SCAN_SQL, WATCH_SQL, activity, archive_members, document_files, document_index, scan_snapshots, watch_events,
)
from siftlake.storage import read_table
from siftlake.streaming import windows

QUERIES: dict = {}
ORACLE: dict = {}


def _query(name: str, sql: str | None = None):
    def register(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return register


_OPS_SQL = (
    f"{ACTIVITY_SQL}, ops as (select source, seq, occurred_at, path, case when action = 'deleted' then 'delete' else 'upsert' end as op from activity where action <> 'renamed' "
    "union all select source, seq, occurred_at, path, 'delete' from activity where action = 'renamed' "
    "union all select source, seq, occurred_at, new_path, 'upsert' from activity where action = 'renamed')"
)


@_query(
    "w6_latest_wins",
    f"with {_OPS_SQL}, l as (select *, row_number() over (partition by source, path order by seq desc, op desc) as n from ops) "
    "select source, path, seq, occurred_at from l where n = 1 and op <> 'delete'",
)
def w6_latest_wins(spark, d):
    return changes.latest(changes.renames_as_changes(activity(spark, d))).select("source", "path", "seq", "occurred_at")


@_query(
    "f22_stale_guard",
    f"with {ACTIVITY_SQL}, u as (select source, path, seq, 1 + (seq * 7919) % 1000 as mtime from activity), "
    "g as (select *, coalesce(max(mtime) over (partition by source, path order by seq rows between unbounded preceding and 1 preceding), 0) as least from u) "
    "select source, path, seq, mtime from g where mtime >= least",
)
def f22_stale_guard(spark, d):
    log = activity(spark, d).select("source", "path", "seq", (1 + (F.col("seq") * 7919) % 1000).alias("mtime"), F.lit(False).alias("force"))
    return changes.accepted_upserts(log).select("source", "path", "seq", "mtime")


@_query(
    "m3_delete",
    f"with {MEMBERS_SQL}, f as (select source, path from members union all select distinct source, split_part(path, '::', 1) from members) "
    "select source, path from f where not (split_part(path, '::', 1) in ('arc_2.zip', 'arc_5.zip'))",
)
def m3_delete(spark, d):
    m = archive_members(spark, d).select("source", "path")
    files = m.union(m.select("source", F.substring_index("path", "::", 1).alias("path")).distinct())
    gone = m.select("source").distinct().crossJoin(spark.createDataFrame([("arc_2.zip",), ("arc_5.zip",), ("absent",)], "path string"))
    return changes.delete_paths(files, gone)


@_query(
    "m4_rename",
    f"with {MEMBERS_SQL}, f as (select source, path from members union all select distinct source, split_part(path, '::', 1) from members), "
    "o as (select distinct source from f where path = 'arc_2.zip') "
    "select source, case when split_part(path, '::', 1) = 'arc_2.zip' then 'moved.zip' || substr(path, 10) else path end as path from f",
)
def m4_rename(spark, d):
    m = archive_members(spark, d).select("source", "path")
    files = m.union(m.select("source", F.substring_index("path", "::", 1).alias("path")).distinct())
    moves = m.select("source").distinct().crossJoin(spark.createDataFrame([("arc_2.zip", "moved.zip"), ("absent", "x")], "old string, new string"))
    taken = m.filter("path like 'arc_3.zip::%'").select("source", F.lit("arc_4.zip").alias("old"), F.lit("arc_3.zip").alias("new")).distinct()
    both = files.filter("path = 'arc_4.zip'").select("source").distinct()
    return changes.rename_paths(files, moves.union(taken.join(both, "source", "left_semi")))


@_query(
    "m8_activity",
    f"with {ACTIVITY_SQL} select source, seq, occurred_at, case action when 'added' then 'added' when 'deleted' then 'deleted' when 'renamed' then 'renamed' else 'modified' end as action, path, new_path "
    "from activity where action in ('deleted', 'renamed') or seq % 9 <> 0",
)
def m8_activity(spark, d):
    a = activity(spark, d)
    op = F.when(F.col("action") == "deleted", "delete").when(F.col("action") == "renamed", "rename").otherwise("upsert")
    log = a.select(
        "source", "seq", F.col("occurred_at").alias("ts"), op.alias("op"), (F.col("action") == "added").alias("is_new"),
        F.when(F.col("seq") % 9 == 0, 0).otherwise(F.col("occurred_at")).alias("mtime"), "path", "new_path",
    )
    return changes.activity_of(log)


@_query("w7_retention", f"with {ACTIVITY_SQL} select seq, action, path from activity order by seq desc limit 1000")
def w7_retention(spark, d):
    return changes.retained(activity(spark, d), 1000).select("seq", "action", "path")


@_query("m9_delete_source", f"with {FILES_SQL} select source, path from files where source <> 'src3'")
def m9_delete_source(spark, d):
    return changes.without_source(document_files(spark, d), "src3").select("source", "path")


_STATUS = (
    "case when s.path is null then 'new' when l.path is null then 'deleted' when l.mtime > s.known_mtime then 'modified' "
    "when s.scanner_version < 8 then 'upgraded' else 'unchanged' end"
)


@_query("j8_scan_diff", f"with {SCAN_SQL} select coalesce(l.path, s.path) as path, {_STATUS} as status from seen l full join server s on s.path = l.path")
def j8_scan_diff(spark, d):
    server, local = scan_snapshots(spark, d)
    return changes.scan_diff(local, server, upgrade=True)


@_query("a16_summary", f"with {SCAN_SQL}, x as (select {_STATUS} as status from seen l full join server s on s.path = l.path) select status, count(*) as files from x group by status")
def a16_summary(spark, d):
    server, local = scan_snapshots(spark, d)
    return changes.scan_diff(local, server, upgrade=True).groupBy("status").agg(F.count(F.lit(1)).alias("files"))


@_query(
    "f21_needs_reindex",
    f"with {SCAN_SQL} select l.path, case when s.path is null then 'new' when l.mtime > s.known_mtime then 'modified' "
    "when s.indexed_at is null or s.indexed_at < 1700000000 then 'forced' else 'unchanged' end as status from seen l left join server s on s.path = l.path",
)
def f21_needs_reindex(spark, d):
    server, local = scan_snapshots(spark, d)
    return changes.scan_diff(local, server, force_since=1_700_000_000).filter("status <> 'deleted'")


@_query("j7_deleted", f"with {SCAN_SQL} select path from server where path not in (select path from seen)")
def j7_deleted(spark, d):
    server, local = scan_snapshots(spark, d)
    return changes.deletions(local, server)


_ERRORS_SQL = (
    f"{ACTIVITY_SQL}, c as (select source, path, max(seq) as cleared from activity where action = 'added' group by all), "
    "f as (select a.* from activity a left join c using (source, path) where a.action = 'deleted' and (c.cleared is null or a.seq > c.cleared)), "
    "r as (select source, path, arg_max('error ' || seq::varchar, seq) as error, min(occurred_at) as first_seen, max(occurred_at) as last_seen, count(*) as count from f group by source, path)"
)


def _errors(spark, d):
    a = activity(spark, d)
    failures = a.filter("action = 'deleted'").select("source", "path", "seq", F.col("occurred_at").alias("ts"), F.concat(F.lit("error "), F.col("seq").cast("string")).alias("error"))
    return stats.errors(failures, a.filter("action = 'added'").select("source", "path", "seq"))


@_query("a12_error_rollup", f"with {_ERRORS_SQL} select * from r")
def a12_error_rollup(spark, d):
    return _errors(spark, d)


@_query("t6_errors_page", f"with {_ERRORS_SQL} select * from r order by last_seen desc, source, path limit 200 offset 20")
def t6_errors_page(spark, d):
    return stats.errors_page(_errors(spark, d), offset=20)


@_query("t7_history", f"with {ACTIVITY_SQL}, s as (select seq as scanned_at from activity where action = 'added') select scanned_at from s order by scanned_at desc limit 100")
def t7_history(spark, d):
    return stats.history(activity(spark, d).filter("action = 'added'").select(F.col("seq").alias("scanned_at")))


@_query(
    "st2_collapse",
    f"with {WATCH_SQL}, g as (select user_id, day, arg_max(kind, seq) as last, arg_max(kind, seq) filter (kind <> 'U') as before from watch group by user_id, day) "
    "select user_id, day, case when last = 'U' and before = 'C' then 'C' else last end as kind from g",
)
def st2_collapse(spark, d):
    return windows.collapse(watch_events(spark, d), "user_id", "day")


def _windows_sql(seconds: int) -> str:
    """o: the starts of each user's windows. The next one opens at the first event that the one before it does not hold."""
    return (
        f"o as (select user_id, min(ts) as start from watch group by user_id union all "
        f"select o.user_id, (select min(w.ts) from watch w where w.user_id = o.user_id and w.ts >= o.start + {seconds}) as start from o where o.start is not null), "
        "p as (select w.*, (select max(o.start) from o where o.user_id = w.user_id and o.start <= w.ts) as window_start from watch w)"
    )


_WINDOW = 30 * 86_400


@_query(
    "st1_windows",
    f"with recursive {WATCH_SQL}, {_windows_sql(_WINDOW)} select user_id, window_start, count(*) as events from p group by all",
)
def st1_windows(spark, d):
    dealt = windows.debounce_windows(watch_events(spark, d), "user_id", seconds=_WINDOW, path="seq")
    return dealt.groupBy("user_id", "window_start").agg(F.count(F.lit(1)).alias("events"))


@_query(
    "j13_rename_pairs",
    f"with recursive {WATCH_SQL}, {_windows_sql(2 * 86_400)}, c as (select user_id, window_start, path, arg_max(kind, seq) as last, arg_max(kind, seq) filter (kind <> 'U') as before, arg_min(kind, seq) as first "
    "from (select *, 'f' || (seq % 20)::varchar as path from p) group by all), k as (select *, case when last = 'U' and before = 'C' then 'C' else last end as kind from c) "
    "select user_id, window_start, max(path) filter (kind = 'D' and first <> 'C') as old_path, max(path) filter (kind = 'U') as new_path from k group by all "
    "having count(*) filter (kind = 'D' and first <> 'C') = 1 and count(*) filter (kind = 'U') = 1",
)
def j13_rename_pairs(spark, d):
    events = watch_events(spark, d).withColumn("path", F.concat(F.lit("f"), (F.col("seq") % 20).cast("string")))
    dealt = windows.debounce_windows(events, "user_id", seconds=2 * 86_400)
    return windows.rename_pairs(dealt, "user_id", "window_start")


@_query(
    "st9_rate_limit",
    f"with recursive {WATCH_SQL}, {_windows_sql(_WINDOW)} select user_id, seq, row_number() over (partition by user_id, window_start order by ts, seq) <= 2 as allowed from p",
)
def st9_rate_limit(spark, d):
    return windows.rate_limited(watch_events(spark, d), "user_id", limit=2, seconds=_WINDOW).select("user_id", "seq", "allowed")


_BATCH_SQL = (
    f"{LINES_SQL}, gone as (select f.* from files f join labels l on l.doc_id = f.file_id where l.toxic = 1), "
    "sent as (select f.* from files f join labels l on l.doc_id = f.file_id where l.quality = 0 and l.toxic = 0)"
)


def _batch(spark, d):
    """A batch over documents as an index: toxic ones are deleted, those of low quality are sent again, older by an hour if their id is odd."""
    index, labels = document_index(spark, d), read_table(spark, d, "labels").withColumnRenamed("doc_id", "file_id")
    marked = index.files.join(labels, "file_id")
    none = lambda t: F.lit(None).cast(t)
    gone = marked.filter("toxic = 1").select(
        F.lit("delete").alias("op"), "source", "path", none("string").alias("new_path"), none("long").alias("mtime"), none("long").alias("size"), none("string").alias("kind"),
        none("string").alias("file_hash"), F.lit(False).alias("force"), F.lit(1).cast("long").alias("seq"),
    )
    mtime = F.when(F.col("file_id") % 2 == 1, F.col("mtime") - 3600).otherwise(F.col("mtime") + 3600)
    sent = marked.filter("quality = 0 and toxic = 0").select(
        F.lit("upsert").alias("op"), "source", "path", none("string").alias("new_path"), mtime.alias("mtime"), F.lit(3).cast("long").alias("size"), "kind",
        F.lit("new").alias("file_hash"), F.lit(False).alias("force"), F.lit(2).cast("long").alias("seq"),
    )
    told = sent.select("source", "path", F.posexplode(F.array(F.concat(F.lit("[PATH] "), "path"), F.lit(""), F.lit("now"))).alias("line_number", "content"))
    return changes.apply_batch(index.files, index.lines, gone.unionByName(sent), told.withColumn("line_number", F.col("line_number").cast("long")))


@_query(
    "m2_upsert_files",
    f"with {_BATCH_SQL} select source, file_id, path, case when file_id in (select file_id from sent) and file_id % 2 = 0 then mtime + 3600 else mtime end as mtime, "
    "case when file_id in (select file_id from sent) and file_id % 2 = 0 then 3 else size end::bigint as size from files where file_id not in (select file_id from gone)",
)
def m2_upsert_files(spark, d):
    return _batch(spark, d)[0].select("source", "file_id", "path", "mtime", "size")


@_query(
    "m2_upsert_lines",
    f"with {_BATCH_SQL}, kept as (select * from lines where file_id not in (select file_id from gone) and not (file_id in (select file_id from sent) and file_id % 2 = 0)), "
    "told as (select source, file_id, unnest([0, 1, 2])::bigint as line_number, unnest(['[PATH] ' || path, '', 'now']) as content from sent where file_id % 2 = 0) "
    "select source, file_id, line_number, content from kept union all select * from told",
)
def m2_upsert_lines(spark, d):
    return _batch(spark, d)[1].select("source", "file_id", "line_number", "content")


@_query(
    "m4_rename_lines",
    f"with {LINES_SQL} select file_id, line_number, case when starts_with(path, 'en/1/doc_1') then 'moved' || substr(path, 11) else path end as path, "
    "case when starts_with(path, 'en/1/doc_1') and line_number = 0 then '[PATH] moved' || substr(path, 11) else content end as content from lines",
)
def m4_rename_lines(spark, d):
    lines = document_index(spark, d).lines
    old = lines.filter(F.startswith("path", F.lit("en/1/doc_1"))).select("source", F.col("path").alias("old")).distinct()
    moves = old.withColumn("new", F.concat(F.lit("moved"), F.substring("old", 11, 1000)))
    return changes.rename_lines(lines, moves).select("file_id", "line_number", "path", "content")


@_query(
    "m5_sentinels",
    f"with {MEMBERS_SQL}, s as (select source, split_part(path, '::', 1) as path, max(file_id) as seq from members where has_error group by all) "
    "select m.source, m.path, m.file_id as seq from members m left join s on s.source = m.source and s.path = split_part(m.path, '::', 1) where s.seq is null or m.file_id >= s.seq",
)
def m5_sentinels(spark, d):
    members = archive_members(spark, d).select("source", "path", F.col("file_id").alias("seq"), "has_error")
    sentinels = members.filter("has_error").select("source", F.substring_index("path", "::", 1).alias("path"), "seq", F.lit("upsert").alias("op"), F.lit(0).alias("mtime"))
    return changes.without_stale_members(members.drop("has_error"), sentinels)


@_query(
    "j14_longest_root",
    f"with {FILES_SQL}, roots(source, root) as (values ('all-en', 'en'), ('one', 'en/1'), ('french', 'fr')) "
    "select f.file_id, (select arg_max(r.source, length(r.root)) from roots r where f.path = r.root or starts_with(f.path, r.root || '/')) as source from files f",
)
def j14_longest_root(spark, d):
    roots = spark.createDataFrame([("all-en", "en"), ("one", "en/1"), ("french", "fr")], "source string, root string")
    found = windows.longest_root(document_files(spark, d).select("path", "file_id"), roots)
    return found.select("file_id", "source")
