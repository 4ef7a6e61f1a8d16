"""Archives: members of zip, tar and single compressed files, nested ones too."""

from __future__ import annotations

import bz2
import calendar
import fnmatch
import gzip
import io
import lzma
import re
import struct
import tarfile
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass

MAX_DEPTH = 10
MAX_MEMBER_BYTES = 10_240 * 1024

_TAR = re.compile(r"\.(tar|tgz|tbz2|txz|tar\.(gz|bz2|xz))$", re.IGNORECASE)
_SINGLE = re.compile(r"\.(gz|bz2|xz)$", re.IGNORECASE)
_ZIP = re.compile(r"\.zip$", re.IGNORECASE)
_SEVEN = re.compile(r"\.(7z|rar)$", re.IGNORECASE)


@dataclass
class Member:
    """A file inside an archive. data is None for what is indexed by name only; skipped tells why."""

    path: str
    data: bytes | None
    size: int | None = None
    mtime: int | None = None
    skipped: str | None = None


def is_archive(name: str) -> bool:
    return any(p.search(name) for p in (_TAR, _SINGLE, _ZIP, _SEVEN))


def hidden(path: str) -> bool:
    return any(c.startswith(".") and c not in (".", "..") for c in path.split("/"))


def dos_time(year: int, month: int, day: int, hour: int, minute: int, second: int) -> int | None:
    """Seconds of a zip entry's time; the format's first year stands for no time."""
    if year <= 1980 or not (1 <= month <= 12 and 1 <= day <= 31):
        return None
    return calendar.timegm((year, month, day, hour, minute, min(second, 59)))


def sane_time(ts: int | None, now: int) -> int | None:
    """Times in the future are a century off if before 2100, and unknown otherwise."""
    if ts is None or ts <= now:
        return ts
    return ts - 3_155_760_000 if ts <= 4_102_444_799 else None


def _zip_time(info: zipfile.ZipInfo) -> int | None:
    at, extra = 0, info.extra
    while at + 4 <= len(extra):
        kind, length = struct.unpack("<HH", extra[at : at + 4])
        if kind == 0x5455 and length >= 5 and extra[at + 4] & 1:
            return struct.unpack("<i", extra[at + 5 : at + 9])[0]
        at += 4 + length
    return dos_time(*info.date_time)


def members(name: str, data: bytes, now: int, excludes: tuple[str, ...] = (), include_hidden: bool = False, depth: int = MAX_DEPTH, prefix: str = "") -> Iterator[Member]:
    """All members of an archive, with paths relative to it; nested ones follow as outer::inner.

    A nested archive gives a row of its own name first. Archives that cannot be read, and those below depth levels,
    give their name with a reason. Members are cut at MAX_MEMBER_BYTES.
    """
    try:
        for path, size, mtime, read in _entries(name, data):
            if (not include_hidden and hidden(path)) or any(fnmatch.fnmatch(path, e) for e in excludes):
                continue
            full = prefix + path
            if is_archive(path):
                if depth <= 0:
                    yield Member(full, None, size, sane_time(mtime, now), "nested too deep")
                    continue
                yield Member(full, None, size, sane_time(mtime, now))
                yield from members(path, read(), now, excludes, include_hidden, depth - 1, full + "::")
            else:
                yield Member(full, read()[:MAX_MEMBER_BYTES], size, sane_time(mtime, now))
    except Exception as broken:  # damaged or encrypted archives
        yield Member(prefix.removesuffix("::") or name, None, len(data), None, f"{type(broken).__name__}: {broken}"[:500])


def _entries(name: str, data: bytes):
    if _SEVEN.search(name):
        raise ValueError("no reader for this kind of archive")
    if _ZIP.search(name):
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            for info in z.infolist():
                if not info.is_dir():
                    yield info.filename, info.file_size, _zip_time(info), lambda i=info: z.read(i)
    elif _TAR.search(name):
        with tarfile.open(fileobj=io.BytesIO(data)) as t:
            for info in t:
                if info.isfile():
                    yield info.name.removeprefix("./"), info.size, int(info.mtime) or None, lambda i=info: t.extractfile(i).read()
    else:
        kind = _SINGLE.search(name)[1].lower()
        raw = {"gz": gzip, "bz2": bz2, "xz": lzma}[kind].decompress(data)
        yield name.rpartition("/")[2][: -len(kind) - 1], len(raw), None, lambda: raw
