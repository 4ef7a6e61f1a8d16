"""Column expressions over paths, kinds and content."""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from siftlake.schemas import FILE_KINDS, PATH_MARK, PATH_SLOT

MIN_TERM = 3


# --- paths ---


def basename(path: Column) -> Column:
    """Text after the last slash."""
    return F.substring_index(path, "/", -1)


def extension(path: Column) -> Column:
    """Lower-case text after the last dot of the basename; empty without a dot. `.bashrc` has the extension bashrc."""
    name = basename(path)
    return F.when(F.contains(name, F.lit(".")), F.lower(F.substring_index(name, ".", -1))).otherwise(F.lit(""))


def leaf_extension(path: Column) -> Column:
    """Extension of the innermost archive member."""
    return extension(F.substring_index(path, "::", -1))


def is_composite(path: Column) -> Column:
    return F.contains(path, F.lit("::"))


def outer_path(path: Column) -> Column:
    """The part before the first `::`."""
    return F.substring_index(path, "::", 1)


def archive_path(path: Column) -> Column:
    """The part after the first `::`, null for a plain file."""
    return F.when(is_composite(path), F.substring(path, F.instr(path, "::") + 2, F.length(path)))


def join_composite(path: Column, member: Column) -> Column:
    return F.concat_ws("::", path, member)


def under_prefix(path: Column, prefix: str) -> Column:
    """The path itself or anything below it; members of an archive are not below it. `%` and `_` are literal."""
    prefix = prefix.strip("/")
    return (path == prefix) | F.startswith(path, F.lit(prefix + "/")) if prefix else F.lit(True)


def strip_path_mark(content: Column) -> Column:
    mark = F.startswith(content, F.lit(PATH_MARK))
    return F.when(mark, F.substring(content, len(PATH_MARK) + 1, 1 << 30)).otherwise(content)


def normalise_separators(path: Column) -> Column:
    return F.replace(path, F.lit("\\"), F.lit("/"))


def encode_row(file_id: Column, line_number: Column) -> Column:
    return file_id * 1_000_000 + line_number


def decode_row(row: Column) -> tuple[Column, Column]:
    return F.floor(row / 1_000_000).cast("long"), row % 1_000_000


def has_hidden_component(path: Column) -> Column:
    """A component that starts with a dot, other than `.` and `..`."""
    return F.rlike(path, F.lit(r"(^|/)\.(?!\.?(/|$))"))


def display_path(path: Column) -> Column:
    """A member of an archive with an arrow after the archive."""
    return F.when(is_composite(path), F.concat(outer_path(path), F.lit(" → "), archive_path(path))).otherwise(path)


_LAST_STEP = r"(?s)^(.*)(?:::|[/\\])(.*)$"


def display_name(path: Column) -> Column:
    """What follows the last `::`, slash or backslash."""
    return F.when(F.rlike(path, F.lit(_LAST_STEP)), F.regexp_extract(path, _LAST_STEP, 2)).otherwise(path)


def display_folder(path: Column) -> Column:
    """What precedes the last `::`, slash or backslash; empty without one."""
    return F.when(F.rlike(path, F.lit(_LAST_STEP)), F.regexp_extract(path, _LAST_STEP, 1)).otherwise(F.lit(""))


def child_prefix(kind: Column, path: Column) -> Column:
    """The prefix that lists what is inside an entry of a listing."""
    return F.when(kind == "archive", F.concat(path, F.lit("::"))).otherwise(path)


def should_expand(is_file: Column, path: Column, active: str) -> Column:
    """Whether an entry of a listing holds an active path: a folder below which it lies, or its archive."""
    inside = (path == active) | F.startswith(F.lit(active), F.concat(path, F.lit("::")))
    return F.when(is_file, inside).otherwise(F.startswith(F.lit(active), path))


# --- kinds ---

# Which extensions belong to which kind. Any other extension is of unknown kind.
KIND_OF_EXTENSION = {
    "archive": "zip tar gz bz2 xz tgz tbz2 txz 7z",
    "pdf": "pdf",
    "image": "jpg jpeg png gif bmp ico webp heic tiff tif raw cr2 nef arw",
    "audio": "mp3 flac ogg m4a aac wav wma opus",
    "video": "mp4 mkv avi mov wmv webm m4v flv",
    "document": "docx docm dotx dotm xlsx xls xlsm xltx xltm pptx pptm potx potm pages numbers key",
    "epub": "epub",
    "dicom": "dcm dicom",
    "binary": (
        "exe dll so dylib sys scr efi o a lib obj wasm deb rpm pkg msi snap flatpak class jar pyc pyd "
        "bin img iso dmg vmdk vhd qcow2 db sqlite sqlite3 mdb ttf otf woff woff2"
    ),
    "code": (
        "rs ts js mjs cjs jsx tsx py rb go java c cpp cc cxx h hpp cs swift kt scala r m pl "
        "sh bash zsh fish ps1 bat cmd vbs vba bas cls lua el clj hs ml fs ex erl dart jl nim zig s asm "
        "html htm xhtml xml svg css scss sass less json yaml yml toml ini cfg conf env properties plist nix hcl tf "
        "sql graphql gql proto diff patch gitignore gitattributes gitmodules dockerignore "
        "makefile dockerfile procfile gemfile rakefile mod sum cabal gradle sln csproj vcxproj"
    ),
    "text": "md markdown rst tex adoc org txt log csv tsv lock",
}


def kind_of_extension(ext: Column) -> Column:
    """Kind of a lower-case extension; unknown without a match."""
    pairs = [F.lit(x) for kind, exts in KIND_OF_EXTENSION.items() for e in exts.split() for x in (e, kind)]
    return F.coalesce(F.element_at(F.create_map(*pairs), ext), F.lit("unknown"))


def known_kind(kind: Column) -> Column:
    """Kinds outside the set collapse to unknown."""
    return F.when(kind.isin(*FILE_KINDS), kind).otherwise(F.lit("unknown"))


def kind_of_mime(mime: Column) -> Column:
    """Kind by the start of a MIME type."""
    starts = {"image/": "image", "audio/": "audio", "video/": "video", "text/": "text"}
    whole = {"application/pdf": "pdf", "application/epub+zip": "epub", "application/dicom": "dicom"}
    archives = ("zip", "x-tar", "gzip", "x-bzip2", "x-xz", "x-7z-compressed", "x-rar-compressed")
    found = F.when(mime.isin(*[f"application/{a}" for a in archives]), F.lit("archive"))
    for m, kind in whole.items():
        found = found.when(mime == m, F.lit(kind))
    for m, kind in starts.items():
        found = found.when(F.startswith(mime, F.lit(m)), F.lit(kind))
    return found.otherwise(F.lit("unknown"))


def expand_kinds(kinds: Iterable[str]) -> list[str]:
    """Kinds that a choice in the user interface stands for: image covers dicom."""
    return sorted({k for kind in kinds for k in ((kind, "dicom") if kind == "image" else (kind,))})


# --- terms and predicates ---


def _bytes(text: str) -> int:
    return len(text.encode("utf-8", "surrogatepass"))


def fuzzy_terms(query: str) -> list[str]:
    """Runs of letters, digits and underscores of at least MIN_TERM bytes of UTF-8."""
    return [t for t in re.split(r"[^\w]+", query) if _bytes(t) >= MIN_TERM]


def phrase_terms(query: str) -> list[str]:
    """The whole query as one literal, if it has MIN_TERM bytes."""
    return [query] if _bytes(query) >= MIN_TERM else []


def document_terms(query: str) -> list[str]:
    """White-space separated tokens of at least MIN_TERM bytes; punctuation counts."""
    return [t for t in query.split() if _bytes(t) >= MIN_TERM]


def regex_literals(pattern: str) -> str:
    """The literal fragments of a pattern, joined by blanks. An escape drops both of its characters."""
    out, i = [""], 0
    while i < len(pattern):
        if pattern[i] == "\\":
            i += 2
            out.append("")
            continue
        if pattern[i] in "^$.*+?|()[]{}":
            out.append("")
        else:
            out[-1] += pattern[i]
        i += 1
    return " ".join(w for w in out if w.strip())


def contains_term(content: Column, term: str) -> Column:
    """Substring match without regard to case."""
    return F.contains(F.lower(content), F.lit(term.lower()))


def contains_all(content: Column, terms: Iterable[str]) -> Column:
    return reduce(lambda a, b: a & b, [contains_term(content, t) for t in terms], F.lit(True))


def contains_any(content: Column, terms: Iterable[str]) -> Column:
    return reduce(lambda a, b: a | b, [contains_term(content, t) for t in terms], F.lit(False))


def matches_regex(content: Column, pattern: str, case_sensitive: bool = False, dot_all: bool = False, unicode: bool = True) -> Column:
    """Regular expression match. Look-around and back-references are refused: linear-time engines have none."""
    if re.search(r"\(\?(?:[=!]|<[=!])|\\[1-9]", pattern):
        raise ValueError("look-around and back-references are not supported")
    flags = ("" if case_sensitive else "i") + ("s" if dot_all else "") + ("U" if unicode else "")
    return F.rlike(content, F.lit(f"(?{flags}){pattern}" if flags else pattern))


def slot(line_number: Column) -> Column:
    return F.when(line_number == PATH_SLOT, F.lit("path")).when(line_number == 1, F.lit("metadata")).otherwise(F.lit("content"))


def split_lines(text: Column) -> Column:
    """Array of lines: \\n or \\r\\n ends a line, and a last line end adds no empty line."""
    return F.split(F.regexp_replace(text, "\r?\n$", ""), "\r?\n")


# --- metadata tags ---

TAG = r"\[([A-Z]+):([^\]]+)\] (.*?)(?= \[[A-Z]+:[^\]]+\] |$)"


def meta_tags(content: Column) -> Column:
    """Array of (prefix, key, value) from `[PREFIX:key] value [PREFIX:key] value ...`."""
    parts = [F.regexp_extract_all(content, F.lit(TAG), F.lit(i)) for i in (1, 2, 3)]
    return F.transform(
        F.arrays_zip(*[p.alias(n) for p, n in zip(parts, ("prefix", "key", "value"), strict=True)]),
        lambda t: F.struct(t["prefix"].alias("prefix"), t["key"].alias("key"), F.trim(t["value"]).alias("value")),
    )


def truncate_error(message: Column, most: int = 500) -> Column:
    """At most `most` bytes of UTF-8, cut between characters, and an ellipsis if anything was cut."""
    data = F.encode(message, "UTF-8")
    size = F.lit(most - 3)  # a character has four bytes at most
    for n in range(most - 2, most + 1):
        goes_on = F.hex(F.substring(data, n + 1, 1)).between("80", "BF")
        size = F.when(goes_on, size).otherwise(F.lit(n))
    kept = F.decode(F.substring(data, F.lit(1), size), "UTF-8")
    return F.when(F.octet_length(message) > most, F.concat(kept, F.lit("…"))).otherwise(message)


def image_dimensions(tags: Column) -> Column:
    """width, height from an image's tags (see `meta_tags`): the Exif pixel size, else the Exif image size, else the header's; null
    without both. Of repeated tags the last counts."""
    last = lambda prefix, key: F.element_at(F.filter(tags, lambda t: (t["prefix"] == prefix) & (t["key"] == key)), -1)["value"]
    number = lambda c: F.regexp_extract(c, r"^\s*(\d+)", 1).try_cast("int")
    has = lambda prefix, key: F.exists(tags, lambda t: (t["prefix"] == prefix) & (t["key"] == key))
    exif = lambda key: F.when(has("EXIF", key), number(last("EXIF", key)))
    plain = F.when(has("IMAGE", "dimensions"), last("IMAGE", "dimensions"))
    side = lambda at: F.regexp_extract(plain, r"^(\d+)x(\d+)", at).try_cast("int")
    width = F.coalesce(exif("PixelXDimension"), exif("ImageWidth"), side(1))
    height = F.coalesce(exif("PixelYDimension"), exif("ImageLength"), side(2))
    return F.when((width > 0) & (height > 0), F.struct(width.alias("width"), height.alias("height")))


def html_title(html: Column) -> Column:
    """Text of the first title element without attributes, runs of white space as one blank; empty without one. The references
    &lt; &gt; &quot; &amp; are read where a semicolon ends them: a title may be cut inside of one. The HTML extractor
    reads titles as browsers do, `&amp` at the end among them."""
    title = F.regexp_extract(html, "<title>([^<]*+)</title>", 1)
    for reference, plain in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        title = F.replace(title, F.lit(reference), F.lit(plain))
    return F.trim(F.regexp_replace(title, "[\\t\\n\\f\\r ]+", " "))


def force_timestamp(text: Column) -> Column:
    """Seconds since 1970 of a number, a date, or a date and time (blank or T between) in the session's time zone; else null."""
    shape = lambda pattern, form: F.when(F.rlike(text, F.lit(pattern)), F.unix_timestamp(F.try_to_timestamp(text, F.lit(form))))
    day, clock = r"^\d{4}-\d{2}-\d{2}", r"\d{2}:\d{2}:\d{2}$"
    number = F.when(F.rlike(text, F.lit(r"^[+-]?\d+$")), text.try_cast("long"))
    return F.coalesce(number, shape(f"{day}T{clock}", "yyyy-MM-dd'T'HH:mm:ss"), shape(f"{day} {clock}", "yyyy-MM-dd HH:mm:ss"), shape(f"{day}$", "yyyy-MM-dd"))


def event_below(path: Column, new_path: Column, prefix: str) -> Column:
    """Whether a change concerns a folder or anything below it."""
    return F.startswith(path, F.lit(prefix)) | F.coalesce(F.startswith(new_path, F.lit(prefix)), F.lit(False))


def content_hash(data: Column, version: int) -> Column:
    """Hash of bytes and extractor version; null for empty content, so empty files are never duplicates."""
    salt = F.lit(version.to_bytes(4, "little"))
    return F.when(F.length(data) > 0, F.sha2(F.concat(data.cast("binary"), salt), 256))


def sane_archive_mtime(ts: Column, now: int) -> Column:
    """Member times in the future are a century off if they lie before 2100, and unknown otherwise."""
    return F.when(ts <= now, ts).when(ts <= 4_102_444_799, ts - 3_155_760_000)


def needs_reindex(known: Column, seen: Column, version: Column, indexed_at: Column, upgrade: bool, force_since: int | None) -> Column:
    """Status of a local file against the index: new, modified, upgraded, forced or unchanged.

    known: mtime in the index (null: absent); seen: local mtime.
    """
    status = F.when(known.isNull(), F.lit("new")).when(seen > known, F.lit("modified"))
    if upgrade:
        from siftlake.schemas import SCANNER_VERSION

        status = status.when(version < SCANNER_VERSION, F.lit("upgraded"))
    if force_since is not None:
        status = status.when(indexed_at.isNull() | (indexed_at < force_since), F.lit("forced"))
    return status.otherwise(F.lit("unchanged"))
