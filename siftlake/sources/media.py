"""Tags of images, audio, video, Windows programs and medical images, read from their headers."""

from __future__ import annotations

import struct
from collections.abc import Iterator

Tags = list[tuple[str, str]]

# Numbers of Exif tags and their names.
EXIF_NAMES = {
    0x0100: "ImageWidth", 0x0101: "ImageLength", 0x010E: "ImageDescription", 0x010F: "Make", 0x0110: "Model", 0x0112: "Orientation",
    0x011A: "XResolution", 0x011B: "YResolution", 0x0131: "Software", 0x0132: "DateTime", 0x013B: "Artist", 0x8298: "Copyright",
    0x829A: "ExposureTime", 0x829D: "FNumber", 0x8827: "PhotographicSensitivity", 0x9003: "DateTimeOriginal", 0x9004: "DateTimeDigitized",
    0x9209: "Flash", 0x920A: "FocalLength", 0xA002: "PixelXDimension", 0xA003: "PixelYDimension", 0xA433: "LensMake", 0xA434: "LensModel",
}
_EXIF_FOLDER = 0x8769
_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 7: 1, 9: 4, 10: 8}


def _tiff(data: bytes) -> Tags:
    """Tags of a TIFF structure, those of its Exif folder included. Each folder is read once."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or len(data) < 8:
        return []
    out, todo, seen = [], [struct.unpack(order + "I", data[4:8])[0]], set()
    while todo:
        at = todo.pop(0)
        if at in seen or at + 2 > len(data):
            continue
        seen.add(at)
        for i in range(struct.unpack(order + "H", data[at : at + 2])[0]):
            entry = data[at + 2 + 12 * i : at + 14 + 12 * i]
            if len(entry) < 12:
                break
            tag, kind, n = struct.unpack(order + "HHI", entry[:8])
            size = _SIZES.get(kind, 0) * n
            raw = entry[8:] if size <= 4 else data[(p := struct.unpack(order + "I", entry[8:])[0]) : p + size]
            if tag == _EXIF_FOLDER:
                todo.append(struct.unpack(order + "I", entry[8:])[0])
            elif tag in EXIF_NAMES and size and len(raw) >= size:
                value = _exif_value(raw[:size], kind, order)
                if value:
                    out.append((f"EXIF:{EXIF_NAMES[tag]}", value))
    return out


def _exif_value(raw: bytes, kind: int, order: str) -> str:
    if kind in (2, 7):
        return raw.split(b"\0")[0].decode("utf-8", "replace").strip()
    if kind in (5, 10):
        parts = struct.unpack(f"{order}{len(raw) // 4}{'I' if kind == 5 else 'i'}", raw)
        return ", ".join(f"{a / b:g}" if b else str(a) for a, b in zip(parts[::2], parts[1::2], strict=True))
    form = {1: "B", 3: "H", 4: "I", 9: "i"}[kind]
    return ", ".join(map(str, struct.unpack(f"{order}{len(raw) // struct.calcsize(form)}{form}", raw)))


def exif(data: bytes) -> Tags:
    """Exif tags of a JPEG, TIFF or PNG file."""
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 4 <= len(data) and data[at] == 0xFF and data[at + 1] != 0xDA:
            length = struct.unpack(">H", data[at + 2 : at + 4])[0]
            if data[at + 1] == 0xE1 and data[at + 4 : at + 10] == b"Exif\0\0":
                return _tiff(data[at + 10 : at + 2 + length])
            at += 2 + length
    elif data[:2] in (b"II", b"MM"):
        return _tiff(data)
    elif data[:8] == b"\x89PNG\r\n\x1a\n":
        at = 8
        while at + 8 <= len(data):
            length, kind = struct.unpack(">I4s", data[at : at + 8])
            if kind == b"eXIf":
                return _tiff(data[at + 8 : at + 8 + length])
            at += 12 + length
    return []


def image(data: bytes) -> Tags:
    """Exif tags, else what the header of a PNG, GIF, BMP, WebP or JPEG file says."""
    if found := exif(data):
        return found
    size, more = None, []
    if data[:8] == b"\x89PNG\r\n\x1a\n" and len(data) >= 24:
        size = struct.unpack(">II", data[16:24])
        if len(data) >= 26:
            colour = {0: "Grayscale", 2: "RGB", 3: "Indexed", 4: "Grayscale+Alpha", 6: "RGBA"}.get(data[25], "Unknown")
            more = [("IMAGE:bit_depth", str(data[24])), ("IMAGE:color", colour)]
    elif data[:4] == b"GIF8" and len(data) >= 10:
        size = struct.unpack("<HH", data[6:10])
    elif data[:2] == b"BM" and len(data) >= 26:
        width, height = struct.unpack("<ii", data[18:26])
        size = width, abs(height)
    elif data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        size = _webp(data)
    elif data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 < len(data) and data[at] == 0xFF:
            kind, length = data[at + 1], struct.unpack(">H", data[at + 2 : at + 4])[0]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                size = width, height
                break
            at += 2 + length
    return [("IMAGE:dimensions", f"{size[0]}x{size[1]}"), *more] if size else [("IMAGE", "no metadata available")]


def _webp(data: bytes) -> tuple[int, int] | None:
    kind = data[12:16]
    if kind == b"VP8X" and len(data) >= 30:
        return 1 + int.from_bytes(data[24:27], "little"), 1 + int.from_bytes(data[27:30], "little")
    if kind == b"VP8L" and len(data) >= 25 and data[20] == 0x2F:
        bits = int.from_bytes(data[21:25], "little")
        return 1 + (bits & 0x3FFF), 1 + (bits >> 14 & 0x3FFF)
    if kind == b"VP8 " and len(data) >= 30 and data[23:26] == b"\x9d\x01\x2a":
        width, height = struct.unpack("<HH", data[26:30])
        return width & 0x3FFF, height & 0x3FFF
    return None


# Names of tags in ID3 frames and Vorbis comments.
ID3_NAMES = {"TIT2": "title", "TPE1": "artist", "TPE2": "album_artist", "TALB": "album", "TDRC": "year", "TYER": "year", "TCON": "genre", "TCOM": "composer", "TRCK": "track", "TPOS": "disc"}
VORBIS_NAMES = {"TITLE": "title", "ARTIST": "artist", "ALBUMARTIST": "album_artist", "ALBUM": "album", "DATE": "year", "GENRE": "genre", "COMMENT": "comment", "COMPOSER": "composer", "TRACKNUMBER": "track", "DISCNUMBER": "disc"}
_BITRATES = (0, 32, 40, 48, 56, 64, 80, 96, 112, 128, 160, 192, 224, 256, 320)


def _signal(codec: str, rate: int, channels: int, bits: int | None = None, seconds: float = 0) -> Tags:
    label = {1: "1 (mono)", 2: "2 (stereo)"}.get(channels, str(channels))
    out = [("AUDIO:codec", codec), ("AUDIO:sample_rate", f"{rate} Hz"), ("AUDIO:channels", label)]
    out += [("AUDIO:bit_depth", f"{bits} bit")] if bits else []
    return out + ([("AUDIO:duration", f"{int(seconds) // 60}:{int(seconds) % 60:02d}")] if seconds >= 1 else [])


def _synchsafe(raw: bytes) -> int:
    return sum((b & 0x7F) << 7 * i for i, b in enumerate(reversed(raw)))


def mp3(data: bytes) -> Tags:
    """ID3 text frames, and the parameters of the first audio frame."""
    out, at = [], 0
    if data[:3] == b"ID3" and len(data) >= 10:
        end, at, major = 10 + _synchsafe(data[6:10]), 10, data[3]
        while at + 10 <= min(end, len(data)) and data[at] != 0:
            name = data[at : at + 4].decode("latin-1")
            size = _synchsafe(data[at + 4 : at + 8]) if major >= 4 else int.from_bytes(data[at + 4 : at + 8], "big")
            body = data[at + 10 : at + 10 + size]
            if name in ID3_NAMES and body:
                text = body[1:].decode({0: "latin-1", 1: "utf-16", 2: "utf-16-be"}.get(body[0], "utf-8"), "replace").split("\0")[0].strip()
                out += [(f"TAG:{ID3_NAMES[name]}", text)] if text else []
            at += 10 + size
        at = end
    head = int.from_bytes(data[at : at + 4], "big")
    if head >> 21 == 0x7FF and head >> 19 & 3 == 3 and head >> 17 & 3 == 1 and head >> 12 & 15 < 15 and head >> 10 & 3 < 3:
        rate, kbit = (44100, 48000, 32000)[head >> 10 & 3], _BITRATES[head >> 12 & 15]
        out += _signal("MP3", rate, 1 if head >> 6 & 3 == 3 else 2, None, (len(data) - at) * 8 / (kbit * 1000) if kbit else 0)
    return out


def flac(data: bytes) -> Tags:
    """Vorbis comments and stream parameters."""
    out, signal, at, last = [], [], 4, False
    while data[:4] == b"fLaC" and not last and at + 4 <= len(data):
        last, kind, size = data[at] >> 7, data[at] & 0x7F, int.from_bytes(data[at + 1 : at + 4], "big")
        body = data[at + 4 : at + 4 + size]
        if kind == 0 and len(body) >= 18:
            bits = int.from_bytes(body[10:18], "big")
            rate = bits >> 44
            signal = _signal("FLAC", rate, (bits >> 41 & 7) + 1, (bits >> 36 & 31) + 1, (bits & (1 << 36) - 1) / rate if rate else 0)
        elif kind == 4:
            out += _comments(body)
        at += 4 + size
    return out + signal


def _comments(body: bytes) -> Tags:
    out, at = [], 4 + int.from_bytes(body[:4], "little")
    n, at = int.from_bytes(body[at : at + 4], "little"), at + 4
    for _ in range(n):
        size = int.from_bytes(body[at : at + 4], "little")
        if at + 4 > len(body):
            break
        name, _, value = body[at + 4 : at + 4 + size].decode("utf-8", "replace").partition("=")
        if name.upper() in VORBIS_NAMES and value.strip():
            out.append((f"TAG:{VORBIS_NAMES[name.upper()]}", value.strip()))
        at += 4 + size
    return out


def _boxes(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """Name, start and end of the boxes of an MP4 file."""
    while at + 8 <= end:
        size, name = struct.unpack(">I4s", data[at : at + 8])
        head = 8
        if size == 1 and at + 16 <= end:
            size, head = struct.unpack(">Q", data[at + 8 : at + 16])[0], 16
        size = end - at if size == 0 else size
        if size < head:
            return
        yield name, at + head, min(at + size, end)
        at += size


def mp4(data: bytes) -> Tags:
    """Duration and frame size of an MP4 or QuickTime file."""
    out: dict[str, str] = {}
    for name, at, end in _boxes(data, 0, len(data)):
        if name != b"moov":
            continue
        for inner, a, b in _boxes(data, at, end):
            if inner == b"mvhd" and b - a >= 20:
                wide = data[a] == 1
                scale, length = struct.unpack(">IQ" if wide else ">II", data[a + (20 if wide else 12) : a + (32 if wide else 20)])
                if scale:
                    seconds = length // scale
                    out["VIDEO:duration"] = f"{seconds // 60}:{seconds % 60:02d}"
            elif inner == b"trak":
                for part, c, d in _boxes(data, a, b):
                    if part == b"tkhd" and d - c >= 8:
                        width, height = (x >> 16 for x in struct.unpack(">II", data[d - 8 : d]))
                        if width and height:
                            out["VIDEO:resolution"] = f"{width}x{height}"
    return [("VIDEO:format", "MP4"), *out.items()] if data[4:8] == b"ftyp" else list(out.items())


def matroska_or_avi(data: bytes) -> Tags:
    """The container of other video files; the frame size of AVI."""
    if data[:4] == b"\x1aE\xdf\xa3":
        return [("VIDEO:format", "WebM" if b"webm" in data[:64] else "Matroska")]
    if data[:4] == b"RIFF" and data[8:12] == b"AVI ":
        at = data.find(b"avih", 0, 4096)
        size = struct.unpack("<II", data[at + 40 : at + 48]) if 0 < at <= len(data) - 48 else (0, 0)
        return [("VIDEO:format", "AVI"), *([("VIDEO:resolution", f"{size[0]}x{size[1]}")] if size[0] else [])]
    return []


# Names of version strings.
PE_STRINGS = ("ProductName", "FileDescription", "CompanyName", "LegalCopyright", "OriginalFilename", "InternalName", "LegalTrademarks", "Comments", "PrivateBuild", "SpecialBuild")


def pe(data: bytes) -> Tags:
    """Version numbers and strings of a Windows program's version resource."""
    if data[:2] != b"MZ" or len(data) < 0x40:
        return []
    at = data.find("VS_VERSION_INFO".encode("utf-16-le"))
    if at < 6:
        return []
    block = data[at - 6 : at - 6 + struct.unpack("<H", data[at - 6 : at - 4])[0]]
    out = []
    fixed = block.find(b"\xbd\x04\xef\xfe")
    if fixed >= 0 and len(block) >= fixed + 24:
        words = struct.unpack("<IIII", block[fixed + 8 : fixed + 24])
        for name, high, low in (("FileVersion", *words[:2]), ("ProductVersion", *words[2:])):
            out.append((f"PE:{name}", f"{high >> 16}.{high & 0xFFFF}.{low >> 16}.{low & 0xFFFF}"))
    for name in PE_STRINGS:
        key = name.encode("utf-16-le") + b"\0\0"
        found = block.find(key)
        if found >= 6:
            chars = struct.unpack("<H", block[found - 4 : found - 2])[0]
            start = (found + len(key) + 3) // 4 * 4
            value = block[start : start + 2 * chars].decode("utf-16-le", "replace").split("\0")[0].strip()
            out += [(f"PE:{name}", value)] if value else []
    return out


# Numbers of DICOM elements and the labels of their tags.
DICOM_LABELS = {
    (0x0010, 0x0010): "PatientName", (0x0010, 0x0020): "PatientID", (0x0008, 0x0020): "StudyDate", (0x0008, 0x0021): "SeriesDate",
    (0x0008, 0x1030): "StudyDescription", (0x0008, 0x103E): "SeriesDescription", (0x0008, 0x0060): "Modality", (0x0018, 0x0015): "BodyPart",
    (0x0008, 0x0080): "Institution", (0x0008, 0x0070): "Manufacturer",
}
_LONG_VR = {b"OB", b"OW", b"OF", b"OD", b"OL", b"SQ", b"UN", b"UC", b"UR", b"UT"}


def dicom(data: bytes) -> Tags:
    """Patient, study, device and geometry of a DICOM file in a little-endian transfer syntax."""
    if data[128:132] != b"DICM":
        return []
    found: dict[tuple[int, int], bytes] = {}
    at, explicit, syntax = 132, True, ""
    while at + 8 <= len(data):
        group, element = struct.unpack("<HH", data[at : at + 4])
        if group != 2 and syntax == "1.2.840.10008.1.2":
            explicit = False
        if not explicit:
            size, head = struct.unpack("<I", data[at + 4 : at + 8])[0], 8
        elif data[at + 4 : at + 6] in _LONG_VR:
            size, head = struct.unpack("<I", data[at + 8 : at + 12])[0] if at + 12 <= len(data) else 0, 12
        else:
            size, head = struct.unpack("<H", data[at + 6 : at + 8])[0], 8
        if (group, element) >= (0x7FE0, 0x0010) or size == 0xFFFFFFFF:  # pixels, or a sequence without a length
            break
        value = data[at + head : at + head + size]
        found[group, element] = value
        if (group, element) == (0x0002, 0x0010):
            syntax = value.decode("ascii", "replace").strip("\0 ")
        at += head + size
    text = lambda raw: raw.decode("latin-1").strip("\0 ")
    out = [(f"DICOM:{label}", text(found[tag])) for tag, label in DICOM_LABELS.items() if text(found.get(tag, b""))]
    rows, columns = found.get((0x0028, 0x0010), b""), found.get((0x0028, 0x0011), b"")
    if len(rows) >= 2 and len(columns) >= 2:
        out.append(("DICOM:Dimensions", f"{struct.unpack('<H', columns[:2])[0]}x{struct.unpack('<H', rows[:2])[0]}"))
    frames = text(found.get((0x0028, 0x0008), b""))
    if frames.isdigit() and int(frames) > 1:
        out.append(("DICOM:Frames", frames))
    return out + ([("DICOM:TransferSyntax", syntax)] if syntax else [])
