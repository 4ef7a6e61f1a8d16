"""Which files of a folder tree are indexed: per-folder rules, markers that exclude folders, scan targets."""

from __future__ import annotations

import os
import re
import tomllib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, replace

from siftlake.functions.query import glob_to_regex, include_prefixes

INDEX_FILE, NOINDEX_FILE = ".index", ".noindex"


@dataclass(frozen=True)
class ScanRules:
    """What holds for the files of one folder. include applies relative to include_dir; None: every file."""

    exclude: tuple[str, ...] = ()
    include: tuple[str, ...] | None = None
    include_dir: str = ""
    include_hidden: bool = False
    follow_symlinks: bool = False
    max_content_size_mb: int = 10
    archives: bool = True
    archive_depth: int = 10

    def overridden(self, text: str, folder: str) -> ScanRules:
        """With the rules file (TOML) of a folder: exclusions add up, of anything else the innermost holds.

        A file that cannot be parsed changes nothing.
        """
        try:
            given = tomllib.loads(text)
        except tomllib.TOMLDecodeError:
            return self
        own = given.get("archives") or {}
        new = {k: given[k] for k in ("include_hidden", "follow_symlinks", "max_content_size_mb") if k in given}
        if "max_file_size_mb" in given:
            new.setdefault("max_content_size_mb", given["max_file_size_mb"])
        if "exclude" in given:
            new["exclude"] = (*self.exclude, *given["exclude"])
        if "include" in given:
            new |= {"include": tuple(given["include"]), "include_dir": folder}
        new |= {k: own[n] for k, n in (("archives", "enabled"), ("archive_depth", "max_depth")) if n in own}
        return replace(self, **new)

    def allows(self, path: str) -> bool:
        """Whether a file (a path relative to the tree's root) is indexed."""
        if not self.include_hidden and any(p.startswith(".") and p not in (".", "..") for p in path.split("/")):
            return False
        if any(re.search(glob_to_regex(e), path) for e in self.exclude):
            return False
        if self.include is None:
            return True
        below = path.removeprefix(f"{self.include_dir}/") if self.include_dir else path
        return any(re.search(glob_to_regex(i), below) for i in self.include)


def ancestors(folder: str) -> list[str]:
    """The folders from the root ("") to a folder."""
    parts = [p for p in folder.split("/") if p]
    return ["/".join(parts[:n]) for n in range(len(parts) + 1)]


def rules_for(folder: str, given: ScanRules, read: Callable[[str], str | None], cache: dict[str, ScanRules] | None = None) -> ScanRules:
    """The rules that hold in a folder; read gives a folder's rules file, if there is one. cache keeps folders already seen."""
    cache = {} if cache is None else cache
    found = given
    for f in ancestors(folder):
        if f not in cache:
            text = read(f)
            cache[f] = found if text is None else found.overridden(text, f)
        found = cache[f]
    return found


def watched(path: str, given: ScanRules, read: Callable[[str], str | None], marked: Callable[[str], bool]) -> ScanRules | None:
    """Rules for a file that has changed; None if a folder above it is marked as not indexed, or the rules leave it out."""
    folder = path.rpartition("/")[0]
    if any(marked(f) for f in ancestors(folder)):
        return None
    found = rules_for(folder, given, read)
    return found if found.allows(path) else None


def moved(old: str, new: str, allowed: Callable[[str], bool]) -> str | None:
    """What a rename amounts to under the rules: rename, delete (out of what is indexed), extract (into it), or nothing."""
    return {(True, True): "rename", (True, False): "delete", (False, True): "extract"}.get((allowed(old), allowed(new)))


def scan_target(path: str, is_file: bool, names: Iterable[str] = (INDEX_FILE, NOINDEX_FILE)) -> tuple[str, bool]:
    """What to scan for a path, and whether it is a rules file or marker. Such a file changes what its own folder holds,
    and that folder's rules are read as those of an entry of the folder above, so that one is scanned."""
    folder, _, name = path.rpartition("/")
    if not is_file or name not in names:
        return path, False
    return folder.rpartition("/")[0] or folder, True


def walk(root: str, given: ScanRules = ScanRules(), subdir: str = "", include_dirs: Iterable[str] | None = None) -> Iterator[tuple[str, ScanRules]]:
    """Paths of files to index below a local root, with the rules that hold for them.

    Left out are folders with a marker (other than the root), on another file system, excluded, or hidden; and links
    unless followed. include_dirs (by default the literal folders of the include patterns) and subdir narrow the
    folders that are listed at all. For folders that a single machine sees; ingest.scan reads shared storage.
    """
    terminals = include_dirs if include_dirs is not None else include_prefixes(list(given.include)) if given.include else None
    terminals = None if terminals is None else [t.strip("/") for t in terminals]
    device, cache = os.stat(root).st_dev, {}

    def near(folder: str, wanted: Iterable[str]) -> bool:
        return any(folder == t or f"{folder}/".startswith(f"{t}/") or f"{t}/".startswith(f"{folder}/") or not folder for t in wanted)

    def read(folder: str) -> str | None:
        try:
            with open(os.path.join(root, folder, INDEX_FILE), encoding="utf-8") as f:
                return f.read()
        except (OSError, UnicodeDecodeError):
            return None

    seen: set[tuple[int, int]] = set()
    todo = [""]
    while todo:
        folder = todo.pop()
        rules = rules_for(folder, given, read, cache)
        at = os.stat(os.path.join(root, folder))
        if (at.st_dev, at.st_ino) in seen:  # a followed link leads back
            continue
        seen.add((at.st_dev, at.st_ino))
        inner = []
        for entry in sorted(os.scandir(os.path.join(root, folder)), key=lambda e: e.name):
            path = f"{folder}/{entry.name}" if folder else entry.name
            if entry.is_symlink() and not rules.follow_symlinks:
                continue
            if entry.is_dir():
                marked = os.path.exists(os.path.join(entry.path, NOINDEX_FILE))
                hidden = entry.name.startswith(".") and not rules.include_hidden
                excluded = any(re.search(glob_to_regex(e), path) for e in rules.exclude)
                if marked or hidden or excluded or entry.stat().st_dev != device:
                    continue
                if (terminals is None or near(path, terminals)) and (not subdir or near(path, [subdir.strip("/")])):
                    inner.append(path)
            elif entry.name not in (INDEX_FILE, NOINDEX_FILE) and rules.allows(path):
                if not subdir or f"{path}/".startswith(f"{subdir.strip('/')}/"):
                    yield path, rules
        todo += reversed(inner)
