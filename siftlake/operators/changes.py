"""Changes without MERGE: an append-only log and views of its latest state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siftlake.functions import exprs
from siftlake.schemas import PATH_MARK, PATH_SLOT

#: Order of the operations of one batch.
PHASES = {"delete": 0, "rename": 1, "upsert": 2, "clear_error": 3, "error": 4, "scan": 5}


def sequence(batch: Column, op: Column, ordinal: Column) -> Column:
    """A number that orders changes: by batch, by phase within it, by place within that."""
    phase = F.element_at(F.create_map(*[F.lit(x) for kv in PHASES.items() for x in kv]), op).cast("long")
    return batch.cast("long") * 10_000_000_000 + phase * 1_000_000_000 + ordinal


def accepted_upserts(changes: DataFrame) -> DataFrame:
    """Upserts that are not older than what was accepted before them (source, path, seq, mtime, force).

    Without forced rows and zero mtimes, a row is accepted iff its mtime is at least the greatest before it: a rejected
    row is below that maximum, so it cannot change it. Such rows reset the guard: the maximum runs from the last of them.
    """
    path = Window.partitionBy("source", "path").orderBy("seq")
    resets = F.coalesce(F.col("force"), F.lit(False)) | (F.col("mtime") == 0)
    era = F.sum(resets.cast("int")).over(path.rowsBetween(Window.unboundedPreceding, 0))
    rows = changes.withColumn("era", era)
    before = Window.partitionBy("source", "path", "era").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    least = F.coalesce(F.max("mtime").over(before), F.lit(0))
    return rows.withColumn("ok", resets | (F.col("mtime") >= least)).filter("ok").drop("era", "ok")


def renames_as_changes(log: DataFrame) -> DataFrame:
    """log (source, seq, action, path, new_path) with each rename as a deletion and an upsert of the new path."""
    moved = log.filter("action = 'renamed'")
    gone = moved.select("source", "seq", "occurred_at", "path", F.lit("delete").alias("op"))
    came = moved.select("source", "seq", "occurred_at", F.col("new_path").alias("path"), F.lit("upsert").alias("op"))
    rest = log.filter("action <> 'renamed'").select(
        "source", "seq", "occurred_at", "path", F.when(F.col("action") == "deleted", "delete").otherwise("upsert").alias("op")
    )
    return rest.unionByName(gone).unionByName(came)


def latest(changes: DataFrame, keep_deleted: bool = False) -> DataFrame:
    """The last change of each source and path; deleted paths are left out.

    max_by combines on the map side, so a path with very many changes is no single task's work.
    """
    others = [c for c in changes.columns if c not in ("source", "path")]
    last = changes.groupBy("source", "path").agg(F.max_by(F.struct(*others), F.struct("seq", "op")).alias("last"))
    rows = last.select("source", "path", *[f"last.{c}" for c in others])
    return rows if keep_deleted else rows.filter("op <> 'delete'")


def delete_paths(files: DataFrame, gone: DataFrame) -> DataFrame:
    """files without deleted paths (source, path) and without members of deleted archives. Unknown paths do nothing."""
    keys = gone.select("source", F.col("path").alias("outer_path")).distinct()
    rows = files.join(gone.select("source", "path").distinct(), ["source", "path"], "left_anti")
    return rows.withColumn("outer_path", exprs.outer_path(F.col("path"))).join(keys, ["source", "outer_path"], "left_anti").drop("outer_path")


def rename_paths(files: DataFrame, moves: DataFrame) -> DataFrame:
    """files with moves (source, old, new) applied to paths and to archive members.

    A move whose old path is unknown, or whose new path exists, does nothing.
    """
    known = files.select("source", F.col("path").alias("old"))
    taken = files.select("source", F.col("path").alias("new"))
    valid = moves.join(known, ["source", "old"], "left_semi").join(taken, ["source", "new"], "left_anti")
    outer = exprs.outer_path(F.col("path"))
    rows = files.withColumn("old", outer).join(valid, ["source", "old"], "left")
    member = F.substring("path", F.length("old") + 1, F.lit(1 << 30))
    return rows.withColumn("path", F.when(F.col("new").isNotNull(), F.concat("new", member)).otherwise(F.col("path"))).drop("old", "new")


def rename_lines(lines: DataFrame, moves: DataFrame) -> DataFrame:
    """lines of an index with moves applied (see `rename_paths`): paths, and the path slot's content."""
    moved = rename_paths(lines.select("source", "path").distinct().withColumn("before", F.col("path")), moves).withColumnRenamed("path", "after")
    rows = lines.join(moved.withColumnRenamed("before", "path"), ["source", "path"])
    content = F.when(F.col("line_number") == PATH_SLOT, F.concat(F.lit(PATH_MARK), "after")).otherwise(F.col("content"))
    return rows.withColumn("content", content).withColumn("path", F.col("after")).drop("after").select(*lines.columns)


def without_stale_members(files: DataFrame, changes: DataFrame) -> DataFrame:
    """files (source, path, seq) without the archive members that were indexed before their archive's last sentinel.

    A sentinel is an upsert of an archive with mtime 0: its members are indexed anew from there on. If that breaks
    off, the archive keeps mtime 0 and counts as modified at the next scan.
    """
    outer = changes.filter((F.col("op") == "upsert") & (F.col("mtime") == 0) & ~exprs.is_composite(F.col("path")))
    last = outer.groupBy("source", F.col("path").alias("outer_path")).agg(F.max("seq").alias("sentinel"))
    rows = files.withColumn("outer_path", exprs.outer_path(F.col("path"))).join(last, ["source", "outer_path"], "left")
    stale = exprs.is_composite(F.col("path")) & (F.col("seq") < F.col("sentinel"))
    return rows.filter(~F.coalesce(stale, F.lit(False))).drop("outer_path", "sentinel")


def apply_batch(files: DataFrame, lines: DataFrame, changes: DataFrame, new_lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files and lines of an index after one batch: deletions, then renames, then upserts with their lines.

    changes: op, source, path, new_path, mtime, size, kind, file_hash, force, seq; new_lines: source, path, line_number,
    content. An upsert older than what the index has is left out unless forced or of mtime 0; a path keeps its file_id.
    A path that the batch upserts twice takes the later one.
    """
    gone = changes.filter("op = 'delete'").select("source", "path")
    moves = changes.filter("op = 'rename'").select("source", F.col("path").alias("old"), F.col("new_path").alias("new"))
    files, lines = rename_paths(delete_paths(files, gone), moves), rename_lines(delete_paths(lines, gone), moves)
    sent = latest(changes.filter("op = 'upsert'").select("source", "path", "mtime", "size", "kind", "file_hash", "force", "seq", "op"))
    known = files.select("source", "path", F.col("mtime").alias("known"), F.col("file_id").alias("known_id"))
    sent = sent.join(known, ["source", "path"], "left")
    sent = sent.filter(F.coalesce("force", F.lit(False)) | (F.col("mtime") == 0) | F.col("known").isNull() | (F.col("mtime") >= F.col("known")))
    upserts = sent.withColumn("file_id", F.coalesce("known_id", F.xxhash64("source", "path")))
    files = files.join(upserts, ["source", "path"], "left_anti").unionByName(upserts.select(*files.columns))
    told = new_lines.select("source", "path", "line_number", "content").join(upserts, ["source", "path"]).select(*lines.columns)
    return files, lines.join(upserts, ["source", "path"], "left_anti").unionByName(told)


def activity_of(changes: DataFrame) -> DataFrame:
    """Activity rows of changes (op, is_new, mtime): outer files only, no archive sentinels (mtime 0)."""
    action = F.when(F.col("op") == "delete", "deleted").when(F.col("op") == "rename", "renamed")
    action = action.when(F.col("is_new"), "added").otherwise("modified")
    keep = ~exprs.is_composite(F.col("path")) & (F.col("op").isin("delete", "rename") | (F.col("mtime") != 0))
    return changes.filter(keep).select("source", "seq", F.col("ts").alias("occurred_at"), action.alias("action"), "path", "new_path")


def retained(activity: DataFrame, newest: int = 10_000) -> DataFrame:
    """The newest rows. A top-k: each task keeps its own newest before they meet."""
    return activity.orderBy(F.desc("seq")).limit(newest)


def scan_diff(local: DataFrame, server: DataFrame, upgrade: bool = False, force_since: int | None = None) -> DataFrame:
    """path, status: new, modified, upgraded, forced, unchanged or deleted.

    local: path, mtime; server: path, known_mtime, scanner_version, indexed_at.
    """
    both = local.join(server, "path", "full_outer")
    status = exprs.needs_reindex(F.col("known_mtime"), F.col("mtime"), F.col("scanner_version"), F.col("indexed_at"), upgrade, force_since)
    return both.select("path", F.when(F.col("mtime").isNull(), "deleted").otherwise(status).alias("status"))


def deletions(local: DataFrame, server: DataFrame) -> DataFrame:
    return server.join(local, "path", "left_anti").select("path")


def without_source(table: DataFrame, source: str) -> DataFrame:
    """A table after a source was dropped."""
    return table.filter(~F.col("source").eqNullSafe(F.lit(source)))
