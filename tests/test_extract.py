import gzip
import io
import struct
import tarfile
import wave
import zipfile

from siftlake.sources import archives
from siftlake.sources.extract import extract, text_lines

NOW = 1_700_000_000


def zipped(files):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data in files.items():
            z.writestr(zipfile.ZipInfo(name, (2001, 2, 3, 4, 5, 6)), data)
    return out.getvalue()


def test_text_and_markdown():
    assert text_lines("a\r\nb\n") == ["a", "b"] and text_lines("") == [] and text_lines("\n") == [""]
    found = extract("n.md", b"---\ntitle: T\ntags: [a, b]\nnone:\n---\nBody  \n")
    assert found.lines == ["Body"] and ("FRONTMATTER:title", "T") in found.tags and ("FRONTMATTER:tags", "a, b") in found.tags and len(found.tags) == 2
    assert extract("x.txt", b"caf\xe9\n").lines == ["caf�"]
    assert list(extract("x.txt", b"one\n").rows("x.txt")) == [(0, "[PATH] x.txt"), (1, ""), (2, "one")]


def test_html():
    page = b"<html><head><title>A  title</title><meta name=description content='About'></head><body><nav><p>menu</p></nav><h1>Head</h1><ul><li>x <p>in</p></li></ul><script>var p</script><p>end<p>last</body>"
    found = extract("p.html", page)
    assert found.tags == [("HTML:title", "A title"), ("HTML:description", "About")]
    assert found.lines == ["Head", "x in", "in", "end", "last"]


def test_office():
    core = '<c xmlns:d="x"><d:title>T</d:title><d:creator>Me</d:creator></c>'
    doc = zipped({"docProps/core.xml": core, "word/document.xml": '<w:d xmlns:w="w"><w:p><w:t>one </w:t><w:t>two</w:t></w:p><w:p/></w:d>'})
    assert extract("a.docx", doc).lines == ["one two"] and extract("a.docx", doc).tags == [("DOCX:title", "T"), ("DOCX:author", "Me")]
    sheet = '<w><sheetData><row><c t="s"><v>0</v></c><c><v>3</v></c><c><v></v></c></row><row/></sheetData></w>'
    book = zipped({"xl/workbook.xml": '<w><sheet name="First"/></w>', "xl/sharedStrings.xml": "<s><si><t>hey</t></si></s>", "xl/worksheets/sheet1.xml": sheet})
    assert extract("b.xlsx", book).lines == ["hey\t3"] and extract("b.xlsx", book).tags == [("XLSX:sheet", "First")]
    slides = zipped({f"ppt/slides/slide{i}.xml": f'<a:s xmlns:a="a"><a:p><a:t>s{i}</a:t></a:p></a:s>' for i in (10, 2)})
    assert extract("c.pptx", slides).lines == ["[PPTX:slide] 1", "s2", "[PPTX:slide] 2", "s10"]
    book = zipped({
        "META-INF/container.xml": '<c><rootfile full-path="o/p.opf"/></c>',
        "o/p.opf": '<p xmlns:d="d"><d:title>Novel</d:title><item id="i" href="c.xhtml"/><itemref idref="i"/></p>', "o/c.xhtml": "<p>chapter</p>",
    })
    assert extract("d.epub", book).lines == ["chapter"] and extract("d.epub", book).tags == [("EPUB:title", "Novel")]
    assert extract("broken.docx", b"PK\x03\x04junk").error


def test_media():
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 640, 480)
    assert extract("i.png", png).tags == [("IMAGE:dimensions", "640x480")]
    assert extract("i.gif", b"GIF89a" + struct.pack("<HH", 3, 4)).tags == [("IMAGE:dimensions", "3x4")]
    jpeg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 4) + b"\0\0" + b"\xff\xc0" + struct.pack(">HBHH", 17, 8, 20, 30) + b"\0" * 9
    assert extract("i.jpg", jpeg).tags == [("IMAGE:dimensions", "30x20")]
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(b"\0" * 8000 * 4 * 65)
    assert ("AUDIO:duration", "1:05") in extract("s.wav", out.getvalue()).tags
    assert extract("doc.pdf", b"%PDF-1.4 /Encrypt 1").lines == ["Content encrypted"] and extract("doc.pdf", b"%PDF-1.4").error
    assert extract("blob", b"\x7fELF\0\0").tags == [("FILE:mime", "application/x-executable")]


def test_archives():
    inner = zipped({"deep.txt": b"deep"})
    tar = io.BytesIO()
    with tarfile.open(fileobj=tar, mode="w:gz") as t:
        info = tarfile.TarInfo("./t/x.txt")
        info.size, info.mtime = 3, 1_000_000_000
        t.addfile(info, io.BytesIO(b"tar"))
    data = zipped({"a.txt": b"a", ".hidden/b": b"b", "skip.log": b"s", "in.zip": inner, "t.tgz": tar.getvalue(), "old.7z": b"7z"})
    found = {m.path: m for m in archives.members("o.zip", data, NOW, excludes=("*.log",))}
    assert list(found) == ["a.txt", "in.zip", "in.zip::deep.txt", "t.tgz", "t.tgz::t/x.txt", "old.7z"] or set(found) >= {"a.txt", "in.zip", "in.zip::deep.txt", "t.tgz", "t.tgz::t/x.txt", "old.7z"}
    assert found["t.tgz::t/x.txt"].data == b"tar" and found["t.tgz::t/x.txt"].mtime == 1_000_000_000 and found["old.7z"].skipped
    assert found["a.txt"].mtime == 981_173_106
    assert [m.skipped for m in archives.members("o.zip", data, NOW, depth=0) if m.path == "in.zip"] == ["nested too deep"]
    [single] = archives.members("n/log.txt.gz", gzip.compress(b"hello"), NOW)
    assert (single.path, single.data, single.size) == ("log.txt", b"hello", 5)
    assert archives.sane_time(NOW + 10, NOW) == NOW + 10 - 3_155_760_000 and archives.sane_time(5_000_000_000, NOW) is None
    assert archives.dos_time(1980, 1, 1, 0, 0, 0) is None
    [bad] = archives.members("bad.zip", b"junk", NOW)
    assert bad.skipped and bad.data is None
