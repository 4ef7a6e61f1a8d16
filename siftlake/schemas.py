"""Tables of a content index, as DDL strings."""

from __future__ import annotations

FILE_KINDS = ("text", "code", "pdf", "archive", "image", "audio", "video", "document", "executable", "epub", "dicom", "unknown")

FILES = (
    "source string, file_id bigint, path string, mtime bigint, size bigint, kind string, indexed_at bigint, "
    "extract_ms bigint, file_hash string, scanner_version int, line_count bigint"
)
#: One row per line. File attributes are repeated on each line: columnar encodings store them once per run, and a
#: filtered search then needs no join with files.
LINES = (
    "source string, file_id bigint, path string, kind string, mtime bigint, size bigint, file_hash string, line_number bigint, content string"
)
CHANGES = (
    "seq bigint, source string, op string, path string, new_path string, mtime bigint, size bigint, kind string, force boolean, ts bigint"
)
ACTIVITY = ("source string, seq bigint, occurred_at bigint, action string, path string, new_path string")
FAILURES = ("source string, seq bigint, path string, error string, ts bigint")
CONTENT = ("file_hash string, line_number bigint, content string")
LINKS = (
    "code string, source string, path string, archive_path string, kind string, mtime bigint, created_at bigint, expires_at bigint"
)

#: Reserved line slots: the path, all metadata tags, then content.
PATH_SLOT, METADATA_SLOT, FIRST_CONTENT_SLOT = 0, 1, 2
PATH_MARK = "[PATH] "
SCANNER_VERSION = 8
#: Lines beyond this are not indexed.
MAX_LINES_PER_FILE = 1_000_000
