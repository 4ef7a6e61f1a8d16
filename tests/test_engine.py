import json

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from siftlake.functions import exprs
from siftlake.operators import browse, changes, content, stats
from siftlake.operators.search import SearchParams, best_lines, centred_window, clamp_window, document_lines, next_offset, search_hits, search_page, with_duplicates
from siftlake.plans.corpus import Index, index_of
from siftlake.sources import ingest
from siftlake.streaming import live, windows

FILES = "source string, file_id long, path string, kind string, mtime long, size long, file_hash string, text string"


@pytest.fixture(scope="module")
def index(spark):
    rows = [
        ("s", 1, "docs/both.txt", "text", 1000, 1, "h", "Alpha one\nbeta two\nalpha beta"),
        ("s", 2, "docs/alpha.txt", "text", 9000, 2, "h", "only alpha here"),
        ("t", 3, "a.zip::in/x.md", "text", 5000, None, None, "TODO fix me\nFIXME later"),
        ("t", 4, "a.zip", "archive", 5000, 9, "z", ""),
    ]
    return index_of(spark.createDataFrame(rows, FILES))


def ids(df):
    return sorted((r.file_id, r.line_number) for r in df.collect())


def test_modes(index):
    hits = lambda **p: ids(search_hits(index, SearchParams(**p)))
    assert hits(q="alpha") == [(1, 2), (1, 4), (2, 0), (2, 2)]
    assert hits(q="beta two", mode="exact") == [(1, 3)] and hits(q="Alpha", mode="exact", case_sensitive=True) == [(1, 2)]
    assert hits(q="TODO|FIXME", mode="regex") == [(3, 2), (3, 3)] and hits(q="TODO|FIXME", mode="regex", prefilter=True) == []
    assert hits(q="both", mode="file-exact") == [(1, 0)] and hits(q=r"\.md$", mode="file-regex") == [(3, 0)] and hits(q="dbt both", mode="file-fuzzy") == []
    assert hits(q="docs both", mode="file-fuzzy") == [(1, 0)]
    assert hits(q="alpha beta", mode="document") == [(1, 2), (1, 3), (1, 4)]
    assert hits(q="alpha", mode="doc-exact") == [(1, 2), (2, 0)] and hits(q="one.beta", mode="doc-regex") == [(1, 2)]
    assert hits(q="xy", path_prefix="docs") == [(1, 0), (2, 0)] and hits(q="xy") == []
    assert hits(q="alpha", date_to=5000) == [(1, 2), (1, 4)] and hits(q="fix", sources=("t", "gone")) == [(3, 2), (3, 3)]
    assert hits(q="fix", path_prefix="a.zip") == []
    with pytest.raises(ValueError, match="look-around"):
        search_hits(index, SearchParams("a(?=b)", mode="regex"))


def test_hits_carry_composite_paths_and_duplicates(index):
    [hit] = search_hits(index, SearchParams("fix me", mode="exact")).collect()
    assert (hit.path, hit.archive_path, hit.snippet) == ("a.zip", "in/x.md", "TODO fix me")
    pages = [search_page(index, SearchParams("alpha", mode="exact", limit=2, offset=o)).collect() for o in (0, 2)]
    assert len({(r.file_id, r.line_number) for p in pages for r in p}) == 4
    found = with_duplicates(search_hits(index, SearchParams("alpha one", mode="exact")), index.files).collect()
    assert [r.duplicate_paths for r in found] == [["docs/alpha.txt"]]


def test_browsing(index, spark):
    assert [(r.path, r.kind) for r in browse.list_dir(index.files, "").collect()] == [("docs/", None), ("a.zip", "archive")]
    assert [r.path for r in browse.list_dir(index.files, "a.zip::").collect()] == ["a.zip::in/"]
    page = browse.file_page(index.lines, "s", "docs/both.txt", offset=1, limit=1).collect()
    assert [(r.line_number, r.total) for r in page] == [(0, 3), (1, 3), (3, 3)]
    wanted = spark.createDataFrame([("s", "docs/both.txt", 0), ("x", "none", 4)], "source string, path string, center long")
    found = browse.context(index.lines, wanted, 1).orderBy("line_number").collect()
    assert [(r.line_number, r.match_index) for r in found] == [(0, 0), (1, 0)]
    links = browse.create_links(spark, [("s", "p", None, "text", 1)], 100, 50, lambda: "code12")
    assert browse.resolve_link(links, "code12", 150).count() == 1 and browse.resolve_link(links, "code12", 151).count() == 0


def test_changes(spark):
    log = spark.createDataFrame(
        [("s", "p", i, m, f) for i, (m, f) in enumerate([(10, False), (5, False), (10, False), (3, True), (4, False), (0, False), (2, False)])],
        "source string, path string, seq long, mtime long, force boolean",
    )
    assert sorted(r.seq for r in changes.accepted_upserts(log).collect()) == [0, 2, 3, 4, 5, 6]
    files = spark.createDataFrame([("s", "a.zip"), ("s", "a.zip::m"), ("s", "b"), ("s", "c")], "source string, path string")
    moves = spark.createDataFrame([("s", "a.zip", "z.zip"), ("s", "b", "c"), ("s", "gone", "x")], "source string, old string, new string")
    assert sorted(r.path for r in changes.rename_paths(files, moves).collect()) == ["b", "c", "z.zip", "z.zip::m"]
    gone = spark.createDataFrame([("s", "a.zip"), ("s", "nope")], "source string, path string")
    assert sorted(r.path for r in changes.delete_paths(files, gone).collect()) == ["b", "c"]
    failures = spark.createDataFrame([("s", "p", 1, 10, "e1"), ("s", "p", 3, 30, "e3"), ("s", "q", 2, 20, "e2")], "source string, path string, seq long, ts long, error string")
    clears = spark.createDataFrame([("s", "q", 5), ("s", "p", 2)], "source string, path string, seq long")
    assert [tuple(r) for r in stats.errors(failures, clears).collect()] == [("s", "p", "e3", 30, 30, 1)]
    assert [r["count"] for r in stats.errors(failures).orderBy("path").collect()] == [2, 1]


def test_content_store(spark):
    old = spark.createDataFrame([("k", 0, "old")], "file_hash string, line_number long, content string")
    new = spark.createDataFrame([("k", 0, "new"), ("j", 0, ""), ("j", 1, "x")], "file_hash string, line_number long, content string")
    put = lambda **p: sorted((r.file_hash, r.content) for r in content.put(old, new, **p).collect())
    assert put() == [("j", ""), ("j", "x"), ("k", "old")] and put(overwrite=True) == [("j", ""), ("j", "x"), ("k", "new")]
    twenty = spark.createDataFrame([("b", i, f"line {i}") for i in range(20)], "file_hash string, line_number long, content string")
    parts = content.chunks(twenty, 40).orderBy("chunk_num").collect()
    assert parts[0].start_line == 0 and all(a.end_line + 1 == b.start_line for a, b in zip(parts, parts[1:])) and parts[-1].end_line == 19
    assert "\n".join(p.data for p in parts) == "\n".join(f"line {i}" for i in range(20))
    assert content.chunks(twenty, 0).count() == 20 and [r.line_number for r in content.get_lines(twenty, "b", 3, 5).collect()] == [3, 4, 5]
    live_files = spark.createDataFrame([("b",)], "file_hash string")
    both = twenty.union(new)
    assert content.compact(both, live_files).count() == 20 and content.orphan_stats(both, live_files).first()["keys"] == 2


def test_scalar_columns(spark):
    row = spark.range(1).select(
        exprs.extension(F.lit("a/.bashrc")).alias("a"), exprs.extension(F.lit("a.b/c")).alias("b"), exprs.leaf_extension(F.lit("x.zip::y.TXT")).alias("c"),
        exprs.kind_of_mime(F.lit("image/png")).alias("d"), exprs.kind_of_mime(F.lit("application/zip")).alias("e"), exprs.archive_path(F.lit("a::b::c")).alias("f"),
        exprs.meta_tags(F.lit("[EXIF:Make] Apple [x] [AUDIO:codec] MP3")).alias("g"), exprs.content_hash(F.lit(""), 1).alias("h"), exprs.known_kind(F.lit("binary")).alias("i"),
        exprs.sane_archive_mtime(F.lit(2_000_000_000).cast("long"), 1_700_000_000).alias("j"), exprs.split_lines(F.lit("a\r\nb\n")).alias("k"),
    ).first()
    assert row[:6] == ("bashrc", "", "txt", "image", "archive", "b::c")
    assert [tuple(t) for t in row.g] == [("EXIF", "Make", "Apple [x]"), ("AUDIO", "codec", "MP3")] and row.h is None and row.i == "unknown"
    assert row.j == 2_000_000_000 - 3_155_760_000 and row.k == ["a", "b"]


def test_ingest(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / ".git").mkdir()
    (tmp_path / "a/note.md").write_text("hello\nworld\n")
    (tmp_path / "a/skip.log").write_text("x")
    (tmp_path / ".git/config").write_text("x")
    (tmp_path / "blob").write_bytes(b"\x89PNG\r\n\x1a\n\0")
    files = ingest.scan(spark, str(tmp_path), excludes=("**/*.log",))
    lines = ingest.extract_lines(files, now=2_000_000_000)
    assert sorted((r.path, r.line_number, r.content) for r in lines.filter("line_number <> 1").collect()) == [
        ("a/note.md", 0, "[PATH] a/note.md"), ("a/note.md", 2, "hello"), ("a/note.md", 3, "world"), ("blob", 0, "[PATH] blob"),
    ]
    assert {r.path: r.kind for r in ingest.file_rows(lines, "here").collect()} == {"a/note.md": "text", "blob": "image"}
    part = ingest.byte_range(files.filter("path = 'blob'"), 1, 3).first()
    assert bytes(part.content) == b"PNG" and part.total == 9
    assert ingest.parse_range("bytes=2-", 9) == (2, 8) and ingest.parse_range("bytes=-3", 9) == (6, 8) and ingest.parse_range("bytes=0-99", 9) == (0, 8)
    assert ingest.parse_range("bytes=9-", 9) is None and ingest.parse_range("bytes=-", 9) is None and ingest.parse_range("x", 9) is None


def test_landing_stream(spark, tmp_path):
    landing = tmp_path / "in"
    landing.mkdir()
    batch = {"source": "s", "scan_timestamp": 5, "delete_paths": ["d"], "rename_paths": [{"old_path": "o", "new_path": "n"}], "indexing_failures": [{"path": "f", "error": "e"}], "files": [{"path": "p", "mtime": 1, "size": 2, "kind": "text", "lines": [{"line_number": 0, "content": "[PATH] p"}, {"line_number": 2, "content": "now alpha"}, {"archive_path": "m", "line_number": 0, "content": "[PATH] p::m"}]}]}
    (landing / "one.json").write_text(json.dumps(batch) + "\n")
    (landing / "two.json").write_text("{broken\n")
    where = [str(tmp_path / x) for x in ("log", "bad", "check")]
    for _ in range(2):
        live.append_changes(live.read_batches(spark, str(landing)), *where).awaitTermination(120)
    log = spark.read.parquet(f"{where[0]}/changes")
    rows = log.orderBy("seq").collect()
    assert [(r.op, r.path, r.new_path) for r in rows] == [("delete", "d", None), ("rename", "o", "n"), ("upsert", "p", None), ("clear_error", "p", None), ("error", "f", None), ("scan", "", None)]
    told = spark.read.parquet(f"{where[0]}/lines")
    assert sorted((r.path, r.line_number) for r in told.collect()) == [("p", 0), ("p", 2), ("p::m", 0)]
    failed, cleared = (log.filter(F.col("op") == op).select("source", "path", "seq", "ts", "error") for op in ("error", "clear_error"))
    assert [r.path for r in stats.errors(failed, cleared.select("source", "path", "seq")).collect()] == ["f"]
    old = [("s", 1, "p", "text", 0, 1, "h", "gone line"), ("s", 2, "o", "text", 5, 1, "g", "alpha moves"), ("s", 3, "d", "text", 5, 1, None, "alpha dies")]
    before = index_of(spark.createDataFrame(old, FILES))
    files, lines = live.replay(before.files, before.lines, where[0], [0])
    assert sorted((r.file_id, r.path, r.mtime) for r in files.collect()) == [(1, "p", 1), (2, "n", 5)]
    after = Index(files, lines, before.texts)
    assert sorted((r.path, r.snippet) for r in search_hits(after, SearchParams("alpha", mode="exact")).collect()) == [("n", "alpha moves"), ("p", "now alpha")]
    assert [r.snippet for r in search_hits(after, SearchParams("[PATH] n", mode="file-exact")).collect()] == ["n"]
    assert [r[0] for r in spark.read.parquet(where[1]).select("_corrupt_record").collect()] == ["{broken"]


def test_batches_are_written_and_taken_up(spark, tmp_path):
    schema = "source string, path string, mtime long, size long, kind string, file_hash string, is_new boolean, force boolean, lines array<struct<archive_path: string, line_number: bigint, content: string>>"
    rows = [("s", f"p{i:02}", i, 1, "text", None, True, False, [(None, 0, f"[PATH] p{i:02}"), (None, 2, "x" * (900 if i == 4 else 10))]) for i in range(12)]
    files = spark.createDataFrame(rows, schema).coalesce(1)
    dealt = [(r.path, r.batch) for r in live.deal_batches(files, most_files=3, most_bytes=300).orderBy("path").collect()]
    sizes = {}
    for path, batch in dealt:
        sizes.setdefault(batch, []).append(path)
    assert all(len(p) <= 3 for p in sizes.values()) and ["p04"] in sizes.values() and sorted(sum(sizes.values(), [])) == [r[1] for r in rows]
    where = [str(tmp_path / x) for x in ("in", "log", "bad", "check")]
    live.write_batches(files, where[0], 7, most_files=5)
    live.append_changes(live.read_batches(spark, where[0]), *where[1:]).awaitTermination(120)
    log = spark.read.parquet(f"{where[1]}/changes")
    assert sorted(r.path for r in log.filter("op = 'upsert'").collect()) == [r[1] for r in rows] and log.filter("op = 'scan'").count() >= 3
    assert spark.read.parquet(f"{where[1]}/lines").count() == 24 and log.select("seq").distinct().count() == log.count()


def test_rename_pairs(spark):
    rows = [(1, "a", "D"), (2, "b", "U"), (1, "c", "C"), (2, "c", "D")]
    events = spark.createDataFrame([("one", p, k, n) for n, (_, p, k) in enumerate(rows)] + [("two", "x", "D", 9), ("two", "y", "U", 10), ("two", "z", "U", 11)], "folder string, path string, kind string, seq long")
    assert [tuple(r) for r in windows.rename_pairs(events, "folder").collect()] == [("one", "a", "b")]


def test_rate_limit_stream(spark, tmp_path):
    spark.createDataFrame([("k", i, t) for i, t in enumerate([0, 1, 2, 3, 61])], "key string, seq long, ts long").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("key string, seq long, ts long").parquet(str(tmp_path / "in"))
    query = live.rate_limited(stream, limit=3).writeStream.format("memory").queryName("limited").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert [r.allowed for r in spark.table("limited").orderBy("seq").collect()] == [True, True, True, False, True]


def test_anchored_windows(spark):
    times = [("a", 0), ("a", 4), ("a", 5), ("a", 9), ("a", 30), ("b", 3), ("b", 8), (None, 1), (None, 2)]
    events = spark.createDataFrame([(k, t, i, f"p{i % 2}") for i, (k, t) in enumerate(times)], "key string, ts long, seq long, path string")
    got = {r.seq: (r.window_start, r.turn) for r in windows.anchored_windows(events, "key", seconds=5).collect()}
    assert got == {0: (0, 1), 1: (0, 2), 2: (5, 1), 3: (5, 2), 4: (30, 1), 5: (3, 1), 6: (8, 1), 7: (1, 1), 8: (1, 2)}
    full = {r.seq: r.window_start for r in windows.debounce_windows(events, "key", seconds=100, most=2).collect()}
    assert full == {0: 0, 1: 0, 2: 5, 3: 5, 4: 30, 5: 3, 6: 3, 7: 1, 8: 1}
    allowed = windows.rate_limited(events, "key", limit=1, seconds=5)
    assert sorted(r.seq for r in allowed.filter("not allowed").collect()) == [1, 3, 8]


def test_recent_rows_and_the_stream_after_them(spark, tmp_path):
    path, schema = str(tmp_path / "activity"), "source string, seq long, occurred_at long, action string, path string, new_path string"
    row = lambda n: ("s", n, 100 + n, "added", f"p{n}", None)
    spark.createDataFrame([row(n) for n in range(5)], schema).coalesce(1).write.parquet(path)
    recent, stream = live.recent_then_live(spark, path, schema, newest=3)
    assert [r.seq for r in recent.collect()] == [2, 3, 4]
    spark.createDataFrame([row(n) for n in (5, 6)], schema).coalesce(1).write.mode("append").parquet(path)
    query = stream.writeStream.format("memory").queryName("after").trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(r.seq for r in spark.table("after").collect()) == [5, 6]


def test_ranked_documents(index):
    hits = document_lines(index, SearchParams("alpha beta", mode="document"), per_file=2).orderBy("turn").collect()
    assert [(r.file_id, r.line_number, r.turn, r.hits_truncated) for r in hits][0][:2] == (1, 4) and len(hits) == 2 and all(r.hits_truncated for r in hits)
    assert best_lines(index, SearchParams("alpha beta", mode="document")).collect()[0].line_number == 4
    assert document_lines(index, SearchParams("a b", mode="document")).count() == 0


def test_pages_and_windows_of_lines():
    assert next_offset(0, 100, 250) == 100 and next_offset(200, 100, 250) == 250
    assert clamp_window(-3, 10, 50) == 0 and clamp_window(45, 10, 50) == 40 and clamp_window(3, 100, 50) == 0 and centred_window(25, 10, 50) == 20
    assert windows.refresh_wait(100, 130, 50) == 20 and windows.refresh_wait(0, 130, 50) == 0
    assert windows.due(None, 5, 10) and windows.due(0, 10, 10) and not windows.due(1, 10, 10)


def test_entry_points(spark):
    found, oracle = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(oracle) <= set(found) and len(found) > 80
    assert __spark_entry__.entry(spark).columns == ["source", "file_id", "path", "line_number", "content"]
