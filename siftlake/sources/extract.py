"""Extractors: bytes of a file to its lines. Slot 0 is the path, slot 1 the metadata tags, content starts at slot 2."""

from __future__ import annotations

import io
import os
import re
import subprocess
import tempfile
import wave
import zipfile
from collections.abc import Callable, Iterator, Mapping
from functools import reduce
from html.parser import HTMLParser
from xml.etree import ElementTree

from siftlake.functions.text import normalise
from siftlake.sources import media

MAX_CONTENT_BYTES = 10_240 * 1024
SNIFF_BYTES = 8192

# Leading bytes and the MIME types they stand for.
MAGIC = (
    (b"%PDF-", "application/pdf"),
    (b"\x89PNG\r\n\x1a\n", "image/png"),
    (b"GIF8", "image/gif"),
    (b"\xff\xd8\xff", "image/jpeg"),
    (b"BM", "image/bmp"),
    (b"PK\x03\x04", "application/zip"),
    (b"\x1f\x8b", "application/gzip"),
    (b"BZh", "application/x-bzip2"),
    (b"\xfd7zXZ\x00", "application/x-xz"),
    (b"7z\xbc\xaf\x27\x1c", "application/x-7z-compressed"),
    (b"Rar!", "application/x-rar-compressed"),
    (b"ID3", "audio/mpeg"),
    (b"fLaC", "audio/flac"),
    (b"OggS", "audio/ogg"),
    (b"\x7fELF", "application/x-executable"),
    (b"MZ", "application/x-msdownload"),
)


class Extracted:
    """metadata tags, content lines, and an error if the file could not be read as what it is."""

    def __init__(self, tags: list[tuple[str, str]] | None = None, lines: list[str] | None = None, error: str | None = None):
        self.tags, self.lines, self.error = tags or [], lines or [], error

    def rows(self, path: str) -> Iterator[tuple[int, str]]:
        yield 0, f"[PATH] {path}"
        yield 1, " ".join(f"[{k}] {v}" for k, v in self.tags)
        yield from enumerate(self.lines, 2)


def text_lines(text: str) -> list[str]:
    """Lines ended by \\n or \\r\\n; a final line end adds no line."""
    if not text:
        return []
    return [line[:-1] if line.endswith("\r") else line for line in (text[:-1] if text.endswith("\n") else text).split("\n")]


def decode(data: bytes) -> str:
    return data[:MAX_CONTENT_BYTES].decode("utf-8", "replace")


def looks_binary(data: bytes) -> bool:
    return b"\0" in data[:SNIFF_BYTES]


def sniff_mime(data: bytes) -> str | None:
    if data[128:132] == b"DICM":
        return "application/dicom"
    if data[:4] == b"RIFF" and data[8:12] == b"WAVE":
        return "audio/wav"
    if data[4:8] == b"ftyp":
        return "video/mp4"
    return next((mime for magic, mime in MAGIC if data.startswith(magic)), None)


def plain_text(data: bytes) -> Extracted:
    return Extracted(lines=[line.rstrip() for line in text_lines(decode(data))])


def _flat(value) -> str:
    if isinstance(value, list):
        return ", ".join(_flat(v) for v in value if v is not None)
    if isinstance(value, dict):
        return "{" + ", ".join(f"{k}: {_flat(v)}" for k, v in value.items() if v is not None) + "}"
    return str(value).lower() if isinstance(value, bool) else str(value)


def markdown(data: bytes) -> Extracted:
    """Front matter becomes tags; without a YAML reader, or if it is broken, it stays in the text."""
    text = decode(data)
    m = re.match(r"---\r?\n(.*?)\r?\n---\r?\n?", text, re.DOTALL)
    tags: list[tuple[str, str]] = []
    if m:
        try:
            import yaml

            head = yaml.safe_load(m[1])
        except Exception:  # no reader, or no YAML
            head = None
        if isinstance(head, dict):
            tags = [(f"FRONTMATTER:{k}", _flat(v)) for k, v in head.items() if v is not None]
            text = text[m.end() :]
    return Extracted(tags, [line.rstrip() for line in text_lines(text)])


class _Blocks(HTMLParser):
    """Text of block elements outside navigation and scripts. A block inside a block counts for both."""

    BLOCKS = {"h1", "h2", "h3", "h4", "h5", "h6", "p", "li", "td", "th", "pre", "blockquote", "figcaption"}
    SKIPPED = {"nav", "header", "footer", "script", "style"}
    VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, int]] = []
        self.texts: list[list[str] | None] = []
        self.title: list[str] = []
        self.description: str | None = None
        self.in_title = False

    def handle_starttag(self, tag, attrs):
        if tag == "meta":
            given = dict(attrs)
            if (given.get("name") or "").lower() == "description" and given.get("content"):
                self.description = given["content"]
        if tag in self.VOID:
            return
        if tag in self.BLOCKS and any(t == tag for t, _ in self.stack) and tag in ("p", "li", "td", "th"):
            self.handle_endtag(tag)
        if tag in self.BLOCKS:
            hidden = any(t in self.SKIPPED for t, _ in self.stack)
            self.texts.append(None if hidden else [])
            self.stack.append((tag, len(self.texts) - 1))
        else:
            self.stack.append((tag, -1))
        self.in_title |= tag == "title"

    def handle_endtag(self, tag):
        if tag == "title":
            self.in_title = False
        for i in range(len(self.stack) - 1, -1, -1):
            if self.stack[i][0] == tag:
                del self.stack[i:]
                break

    def handle_data(self, data):
        if self.in_title:
            self.title.append(data)
        if not any(t in self.SKIPPED for t, _ in self.stack):
            for _, at in self.stack:
                if at >= 0 and self.texts[at] is not None:
                    self.texts[at].append(data)


def html_text(text: str) -> Extracted:
    parser = _Blocks()
    parser.feed(text)
    parser.close()
    tags = []
    if title := " ".join("".join(parser.title).split()):
        tags.append(("HTML:title", title))
    if parser.description:
        tags.append(("HTML:description", " ".join(parser.description.split())))
    lines = [" ".join("".join(t).split()) for t in parser.texts if t is not None]
    return Extracted(tags, [line for line in lines if line])


def html(data: bytes) -> Extracted:
    return html_text(decode(data))


def pdf(data: bytes) -> Extracted:
    """No PDF reader is at hand: encrypted files are told apart, others are indexed by name."""
    if b"/Encrypt" in data:
        return Extracted(lines=["Content encrypted"])
    return Extracted(error="no PDF reader")


def _local(tag: str) -> str:
    return tag.rpartition("}")[2]


def _part(z: zipfile.ZipFile, name: str):
    try:
        return ElementTree.fromstring(z.read(name))
    except (KeyError, ElementTree.ParseError):
        return None


def _core_tags(z: zipfile.ZipFile, prefix: str) -> list[tuple[str, str]]:
    core = _part(z, "docProps/core.xml")
    wanted = {"title": "title", "creator": "author"}
    found = [(wanted[_local(e.tag)], (e.text or "").strip()) for e in core.iter() if _local(e.tag) in wanted] if core is not None else []
    return [(f"{prefix}:{k}", v) for k, v in found if v]


def _paragraphs(root, mark: str = "p", text: str = "t") -> list[str]:
    out = []
    for p in root.iter():
        if _local(p.tag) == mark:
            line = "".join(e.text or "" for e in p.iter() if _local(e.tag) == text).strip()
            if line:
                out.append(line)
    return out


def docx(data: bytes) -> Extracted:
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = _part(z, "word/document.xml")
        return Extracted(_core_tags(z, "DOCX"), _paragraphs(body) if body is not None else [])


def _numbered(z: zipfile.ZipFile, pattern: str) -> list[str]:
    found = [(int(m[1]), m[0]) for m in (re.fullmatch(pattern, n) for n in z.namelist()) if m]
    return [name for _, name in sorted(found)]


def pptx(data: bytes) -> Extracted:
    tags, lines = [], []
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        for i, name in enumerate(_numbered(z, r"ppt/slides/slide(\d+)\.xml"), 1):
            root = _part(z, name)
            found = _paragraphs(root) if root is not None else []
            if found:
                lines += [f"[PPTX:slide] {i}", *found]
        return Extracted(_core_tags(z, "PPTX") + tags, lines)


def xlsx(data: bytes) -> Extracted:
    """Sheet names as tags; each row's cells joined by tabs, without empty cells and rows."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        shared = _part(z, "xl/sharedStrings.xml")
        strings = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in shared if _local(si.tag) == "si"] if shared is not None else []
        book = _part(z, "xl/workbook.xml")
        tags = [("XLSX:sheet", s.get("name", "")) for s in book.iter() if _local(s.tag) == "sheet"] if book is not None else []
        lines = []
        for name in _numbered(z, r"xl/worksheets/sheet(\d+)\.xml"):
            root = _part(z, name)
            for row in root.iter() if root is not None else ():
                if _local(row.tag) != "row":
                    continue
                cells = []
                for c in row:
                    value = "".join(e.text or "" for e in c.iter() if _local(e.tag) in ("v", "t"))
                    if c.get("t") == "s" and value.isdigit() and int(value) < len(strings):
                        value = strings[int(value)]
                    if value.strip():
                        cells.append(value)
                if cells:
                    lines.append("\t".join(cells))
        return Extracted(tags, lines)


def epub(data: bytes) -> Extracted:
    """Metadata of the package file and the block text of the chapters in spine order."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        container = _part(z, "META-INF/container.xml")
        roots = [e.get("full-path") for e in container.iter() if _local(e.tag) == "rootfile"] if container is not None else []
        package = _part(z, roots[0]) if roots else None
        if package is None:
            return Extracted(error="no package file")
        base = roots[0].rpartition("/")[0]
        tags = [
            (f"EPUB:{_local(e.tag)}", e.text.strip()) for e in package.iter()
            if _local(e.tag) in ("title", "creator", "publisher", "language") and e.text and e.text.strip()
        ]
        hrefs = {e.get("id"): e.get("href") for e in package.iter() if _local(e.tag) == "item"}
        lines = []
        for ref in package.iter():
            if _local(ref.tag) == "itemref" and hrefs.get(ref.get("idref")):
                name = f"{base}/{hrefs[ref.get('idref')]}" if base else hrefs[ref.get("idref")]
                if name in z.namelist():
                    lines += html_text(decode(z.read(name))).lines
        return Extracted(tags, lines)


def _tagged(reader):
    """An extractor of a reader of tags; a file without any is told by its MIME type."""
    return lambda data: Extracted(tags) if (tags := reader(data)) else mime_only(data)


def audio(data: bytes) -> Extracted:
    """Parameters of WAV files."""
    try:
        with wave.open(io.BytesIO(data)) as w:
            return Extracted(media._signal("PCM", w.getframerate(), w.getnchannels(), 8 * w.getsampwidth(), w.getnframes() / w.getframerate()))
    except (wave.Error, EOFError, ZeroDivisionError):
        return mime_only(data)


def mime_only(data: bytes) -> Extracted:
    return Extracted([("FILE:mime", sniff_mime(data) or "application/octet-stream")])


_image, _mp4, _video, _pe, _dicom = map(_tagged, (media.image, media.mp4, media.matroska_or_avi, media.pe, media.dicom))
BY_EXTENSION = {
    "md": markdown, "markdown": markdown, "html": html, "htm": html, "xhtml": html, "pdf": pdf, "docx": docx, "xlsx": xlsx, "xlsm": xlsx,
    "pptx": pptx, "epub": epub, "wav": audio, "mp3": _tagged(media.mp3), "flac": _tagged(media.flac), "dcm": _dicom, "dicom": _dicom,
    **dict.fromkeys(("png", "gif", "bmp", "jpg", "jpeg", "webp", "tif", "tiff"), _image), **dict.fromkeys(("mp4", "m4v", "mov"), _mp4),
    **dict.fromkeys(("mkv", "webm", "avi"), _video), **dict.fromkeys(("exe", "dll", "sys", "scr", "cpl", "ocx", "drv", "efi"), _pe),
}


def extract(path: str, data: bytes, max_line: int = 0, overrides: Mapping[str, Callable[[bytes], Extracted]] | None = None) -> Extracted:
    """Lines of one file by a reader given for its extension, else by the extension, else as text, else by its leading bytes.

    A broken file is indexed by its name with an error. Content is pretty-printed where that is possible; max_line wraps
    content lines (0: as they are).
    """
    leaf = path.rpartition("::")[2].rpartition("/")[2]
    extension = leaf.rpartition(".")[2].lower() if "." in leaf else ""
    reader = (overrides or {}).get(extension) or BY_EXTENSION.get(extension)
    try:
        if reader is None:
            reader = _dicom if data[128:132] == b"DICM" else mime_only if looks_binary(data) or sniff_mime(data) else plain_text
        found = reader(data)
    except Exception as broken:  # whatever a damaged file makes a reader raise
        return Extracted(error=f"{type(broken).__name__}: {broken}"[:500])
    lines = normalise(list(enumerate(found.lines, 2)), extension, max_line)
    found.lines = [line for _, line in lines]
    return found


def external(command: list[str], timeout: float = 60.0) -> Callable[[bytes], Extracted]:
    """A reader that runs a program on each file and takes the lines that it prints.

    In the command, {file} is a temporary file with the content, {dir} a folder of its own; without {file} the content is the
    program's standard input. Lines of files that the program leaves in {dir} follow. A program that fails or takes
    too long gives an error.
    """

    def read(data: bytes) -> Extracted:
        with tempfile.TemporaryDirectory(prefix="siftlake-") as folder:
            os.mkdir(os.path.join(folder, "out"))
            given = os.path.join(folder, "in")
            with open(given, "wb") as f:
                f.write(data)
            places = {"{file}": given, "{dir}": os.path.join(folder, "out"), "{name}": "in"}
            args = [reduce(lambda a, kv: a.replace(*kv), places.items(), part) for part in command]
            piped = None if any("{file}" in part for part in command) else data
            try:
                done = subprocess.run(args, input=piped, capture_output=True, timeout=timeout, check=False)
            except (OSError, subprocess.TimeoutExpired) as failed:
                return Extracted(error=f"{command[0]}: {type(failed).__name__}")
            if done.returncode:
                return Extracted(error=f"{command[0]} ended with {done.returncode}: {decode(done.stderr).strip()}"[:500])
            lines = text_lines(decode(done.stdout))
            for at, _, names in sorted(os.walk(places["{dir}"])):
                for name in sorted(names):
                    with open(os.path.join(at, name), "rb") as f:
                        lines += text_lines(decode(f.read()))
            return Extracted(lines=lines)

    return read
