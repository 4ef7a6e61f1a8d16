"""Readers of headers, per-folder rules, external programs."""

import struct
import sys

from siftlake.functions.text import pretty
from siftlake.sources import media, rules
from siftlake.sources.extract import extract, external


def tiff(entries, order="<"):
    """A TIFF structure with one folder; text that does not fit in an entry follows it."""
    body, tail, at = b"", b"", 8 + 2 + 12 * len(entries) + 4
    for tag, kind, value in entries:
        raw = value if isinstance(value, bytes) else struct.pack(order + {3: "H", 4: "I"}[kind], value)
        n = len(raw) if kind == 2 else 1
        if len(raw) > 4:
            body += struct.pack(order + "HHII", tag, kind, n, at + len(tail))
            tail += raw
        else:
            body += struct.pack(order + "HHI", tag, kind, n) + raw.ljust(4, b"\0")
    return (b"II" if order == "<" else b"MM") + struct.pack(order + "HIH", 42, 8, len(entries)) + body + b"\0" * 4 + tail


def test_exif():
    for order in "<>":
        block = b"Exif\0\0" + tiff([(0x010F, 2, b"Maker Inc\0"), (0xA002, 4, 4000), (0xA003, 3, 3000)], order)
        jpeg = b"\xff\xd8\xff\xe1" + struct.pack(">H", len(block) + 2) + block + b"\xff\xda"
        assert extract("a.jpg", jpeg).tags == [("EXIF:Make", "Maker Inc"), ("EXIF:PixelXDimension", "4000"), ("EXIF:PixelYDimension", "3000")]
    assert media.exif(b"II*\0\xff\xff\xff\x7f") == [] and media.image(b"\xff\xd8\xff\xe1\0\x02") == [("IMAGE", "no metadata available")]
    webp = b"RIFF\0\0\0\0WEBPVP8X" + b"\0" * 8 + (99).to_bytes(3, "little") + (49).to_bytes(3, "little")
    assert media.image(webp) == [("IMAGE:dimensions", "100x50")]


def test_audio():
    frame = lambda n, t: n + struct.pack(">I", len(t) + 1) + b"\0\0\x03" + t
    frames = frame(b"TIT2", "Lied é".encode()) + frame(b"TRCK", b"7") + frame(b"APIC", b"junk")
    size = bytes(len(frames) >> 7 * i & 0x7F for i in (3, 2, 1, 0))
    found = extract("a.mp3", b"ID3\x03\0\0" + size + frames + b"\xff\xfb\x90\x40" + b"\0" * 32_000).tags
    assert found == [("TAG:title", "Lied é"), ("TAG:track", "7"), ("AUDIO:codec", "MP3"), ("AUDIO:sample_rate", "44100 Hz"), ("AUDIO:channels", "2 (stereo)"), ("AUDIO:duration", "0:02")]
    stream = b"\0" * 10 + (48_000 << 44 | 1 << 41 | 15 << 36 | 48_000 * 61).to_bytes(8, "big") + b"\0" * 16
    comment = b"ARTIST=Somebody"
    vorbis = struct.pack("<I", 1) + b"v" + struct.pack("<II", 1, len(comment)) + comment
    flac = b"fLaC\0" + len(stream).to_bytes(3, "big") + stream + b"\x84" + len(vorbis).to_bytes(3, "big") + vorbis
    assert extract("a.flac", flac).tags[0] == ("TAG:artist", "Somebody") and ("AUDIO:duration", "1:01") in extract("a.flac", flac).tags
    assert ("AUDIO:bit_depth", "16 bit") in media.flac(flac) and media.mp3(b"") == [] and media.flac(b"fLaC") == []


def test_video():
    box = lambda name, body: struct.pack(">I4s", 8 + len(body), name) + body
    header = box(b"mvhd", b"\0" * 12 + struct.pack(">II", 1000, 125_000) + b"\0" * 80)
    track = box(b"trak", box(b"tkhd", b"\0" * 76 + struct.pack(">II", 640 << 16, 360 << 16)))
    film = box(b"ftyp", b"isom") + box(b"moov", header + track)
    assert extract("a.mp4", film).tags == [("VIDEO:format", "MP4"), ("VIDEO:duration", "2:05"), ("VIDEO:resolution", "640x360")]
    assert extract("a.mkv", b"\x1aE\xdf\xa3...webm").tags == [("VIDEO:format", "WebM")] and media.mp4(struct.pack(">I4s", 3, b"moov")) == []


def test_programs_and_medical_images():
    name = lambda s: s.encode("utf-16-le") + b"\0\0"

    def entry(key, value, chars):
        body = b"\1\0" + name(key)
        body += b"\0" * (-(4 + len(body)) % 4) + value
        return struct.pack("<HH", 4 + len(body), chars) + body

    fixed = struct.pack("<IIIIII", 0xFEEF04BD, 0x10000, 1 << 16 | 2, 3 << 16 | 4, 5 << 16, 6) + b"\0" * 28
    head = b"\0\0" + name("VS_VERSION_INFO")
    head += b"\0" * (-(4 + len(head)) % 4)
    inner = entry("CompanyName", name("Some Firm"), 10)
    block = head + fixed + inner
    block = struct.pack("<HH", 4 + len(block), len(fixed)) + block
    found = extract("a.exe", b"MZ" + b"\0" * 62 + block).tags
    assert found == [("PE:FileVersion", "1.2.3.4"), ("PE:ProductVersion", "5.0.0.6"), ("PE:CompanyName", "Some Firm")]
    element = lambda g, e, vr, v: struct.pack("<HH2sH", g, e, vr, len(v)) + v
    data = b"\0" * 128 + b"DICM" + element(2, 0x10, b"UI", b"1.2.840.10008.1.2.1\0") + element(8, 0x60, b"CS", b"MR") + element(0x10, 0x10, b"PN", b"Doe^J ")
    data += element(0x28, 0x10, b"US", struct.pack("<H", 256)) + element(0x28, 0x11, b"US", struct.pack("<H", 512)) + element(0x7FE0, 0x10, b"US", b"")
    want = [("DICOM:PatientName", "Doe^J"), ("DICOM:Modality", "MR"), ("DICOM:Dimensions", "512x256"), ("DICOM:TransferSyntax", "1.2.840.10008.1.2.1")]
    assert extract("scan.dcm", data).tags == want and extract("no_name", data).tags == want


def test_toml():
    text = "a=1\nlist=[1,2]\n[t.u]\nk='v'\n[[rows]]\nx=true\n[[rows]]\nx=1.5\n"
    assert pretty(text, "toml") == 'a = 1\nlist = [\n    1,\n    2,\n]\n\n[t]\n\n[t.u]\nk = "v"\n\n[[rows]]\nx = true\n\n[[rows]]\nx = 1.5'
    assert pretty("a = ", "toml") == "a = " and extract("x.toml", b"a=1\n").lines == ["a = 1"]
    assert extract("x.json", b'{"a":[1]}').lines == ["{", '  "a": [', "    1", "  ]", "}"]


def test_external_programs():
    script = "import sys; print(sys.stdin.read().upper() if len(sys.argv) < 2 else open(sys.argv[1]).read()[::-1])"
    assert extract("a.xyz", b"one", overrides={"xyz": external([sys.executable, "-c", script])}).lines == ["ONE"]
    assert external([sys.executable, "-c", script, "{file}"])(b"abc").lines == ["cba"]
    assert external([sys.executable, "-c", "import sys; open(sys.argv[1] + '/b', 'w').write('left')", "{dir}"])(b"").lines == ["left"]
    assert "ended with 3" in external([sys.executable, "-c", "raise SystemExit(3)"])(b"").error and external(["/no/such"])(b"").error
    assert external([sys.executable, "-c", "import time; time.sleep(9)"], timeout=0.5)(b"").error


def test_rules(tmp_path):
    for path in ("a/one.txt", "a/two.log", "a/deep/three.txt", "a/deep/.hid/x.txt", "b/four.txt", "skip/five.txt", "c/sub/six.md", "c/seven.md", "top.txt"):
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text("x")
    (tmp_path / "skip/.noindex").write_text("")
    (tmp_path / "a/.index").write_text('exclude = ["**/*.log"]\nmax_content_size_mb = 3\n[archives]\nmax_depth = 2\n')
    (tmp_path / "a/deep/.index").write_text("include_hidden = true\n")
    (tmp_path / "c/.index").write_text('include = ["sub/**"]\n')
    (tmp_path / "b/.index").write_text("not [ toml")
    found = dict(rules.walk(str(tmp_path)))
    assert list(found) == ["top.txt", "a/one.txt", "a/deep/three.txt", "a/deep/.hid/x.txt", "b/four.txt", "c/sub/six.md"]
    deep = found["a/deep/three.txt"]
    assert (deep.max_content_size_mb, deep.archive_depth, deep.exclude, deep.include_hidden) == (3, 2, ("**/*.log",), True)
    assert [p for p, _ in rules.walk(str(tmp_path), subdir="a/deep")] == ["a/deep/three.txt", "a/deep/.hid/x.txt"]
    assert [p for p, _ in rules.walk(str(tmp_path), rules.ScanRules(include=("b/**",)))] == ["b/four.txt"]
    (tmp_path / "b/loop").symlink_to(tmp_path / "b")
    assert "b/loop/four.txt" not in dict(rules.walk(str(tmp_path))) and len(list(rules.walk(str(tmp_path), rules.ScanRules(follow_symlinks=True)))) >= 6


def test_changed_files_under_rules():
    files = {"": None, "a": 'exclude = ["a/x*"]'}
    seen = lambda p: rules.watched(p, rules.ScanRules(), files.get, lambda f: f == "n")
    assert seen("a/y") is not None and seen("a/x1") is None and seen("n/deep/z") is None
    allowed = lambda p: seen(p) is not None
    assert [rules.moved(o, n, allowed) for o, n in (("a/y", "b"), ("a/y", "a/x"), ("a/x", "b"), ("n/z", "a/x"))] == ["rename", "delete", "extract", None]
    assert rules.scan_target("r/a/b/.index", True) == ("r/a", True) and rules.scan_target("r/a/b.txt", True) == ("r/a/b.txt", False) and rules.scan_target("r/.noindex", False)[1] is False
