"""Segmenters: sequential walks over one file's bytes, run in Arrow batches inside Python workers.

A walker lists what a file is made of, as ranges, and names the items inside a segment; it decides nothing. Rules and
dictionaries are tables that the plans apply. A file whose structure is in doubt gives an error and no segment at all.
"""

from __future__ import annotations

import struct
import sys

from pyspark import cloudpickle

from .. import dims

#: Chunks, markers, blocks or entries of one file, and the depth of directories.
MOST_ITEMS, MOST_DEPTH = 1_000_000, 64


class Doubt(Exception):
    """error_kind, detail, offset, limit or unsupported kind of a file that is refused."""

    def __init__(self, detail: str | None, offset: int | None = None, kind: str = "malformed", unsupported: str | None = None, limit: str | None = None):
        super().__init__(detail)
        self.row = {"error_kind": kind, "detail": detail, "offset": offset, "limit": limit, "unsupported_kind": unsupported}


def clean(raw: bytes) -> str:
    """Lossy UTF-8 without control characters."""
    if raw.isascii() and (text := raw.decode()).isprintable():
        return text
    return "".join(c for c in raw.decode("utf-8", "replace") if not (c < " " or "\x7f" <= c <= "\x9f"))


class Cursor:
    """Reads that fail with the doubt they were told to."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def take(self, n: int, detail: str = "truncated", offset: int | None = None) -> bytes:
        if n < 0 or self.at + n > len(self.data):
            raise Doubt(detail, offset)
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, fmt: str, detail: str = "truncated", offset: int | None = None) -> int:
        return struct.unpack(fmt, self.take(struct.calcsize(fmt), detail, offset))[0]


class Walk:
    """Collects segments. spend() counts against the limit of items."""

    def __init__(self):
        self.rows, self.left = [], MOST_ITEMS

    def spend(self) -> None:
        if not self.left:
            raise Doubt(None, None, "limit-exceeded", limit="item-count")
        self.left -= 1

    def add(self, key: str, off: int, length: int, size: int | None = None, items=(), location: str | None = None, replace: bytes | None = None, notes=()) -> None:
        self.rows.append({"key": key, "off": off, "len": length, "size": length if size is None else size, "location": location, "replace": replace, "items": list(items), "notes": list(notes)})


def item(scope: str, name: str, location: str, size: int, text: str | None = None, opaque: int | None = None) -> dict:
    return {"scope": scope, "name": name, "location": location, "bytes": size, "text": text, "opaque": opaque}


# --- shared readers ----------------------------------------------------------------------------------------------------

TIFF_SIZES = {**dict.fromkeys((1, 2, 6, 7), 1), **dict.fromkeys((3, 8), 2), **dict.fromkeys((4, 9, 11, 13), 4), **dict.fromkeys((5, 10, 12, 16, 17, 18), 8)}
SUB_DIRECTORIES = {("IFD0", 0x8769): "Exif IFD", ("IFD1 (thumbnail)", 0x8769): "Exif IFD", ("IFD0", 0x8825): "GPS IFD", ("IFD1 (thumbnail)", 0x8825): "GPS IFD", ("Exif IFD", 0xA005): "Interop IFD"}


def exif(tiff: bytes, place: str) -> tuple[list[dict], list[dict]]:
    """Items of every directory that can be reached, and notes. A broken directory ends its own chain, never the file."""
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    if order is None or len(tiff) < 8 or struct.unpack_from(order + "H", tiff, 2)[0] != 42:
        return [], [{"location": place, "bytes": len(tiff)}]
    found, notes, seen, left = [], [], set(), [MOST_ITEMS]

    def directory(start: int, label: str, depth: int) -> int:
        """The offset of the next directory, 0 for none. Raises struct.error where the bytes end."""
        if depth > MOST_DEPTH or start in seen:
            return 0
        seen.add(start)
        count = struct.unpack_from(order + "H", tiff, start)[0]
        for i in range(count):
            at = start + 2 + 12 * i
            if not left[0]:
                notes.append({"location": f"{place} {label}", "bytes": max(0, len(tiff) - at)})
                return 0
            left[0] -= 1
            tag, kind, n = struct.unpack_from(order + "HHI", tiff, at)
            inline = tiff[at + 8 : at + 12]
            if len(inline) < 4:
                raise struct.error
            size = TIFF_SIZES.get(kind, 0) * n
            value = inline[:size]
            if size > 4:
                begin = struct.unpack(order + "I", inline)[0]
                value = tiff[begin : begin + size] if begin + size <= len(tiff) else None
            sub = SUB_DIRECTORIES.get((label, tag))
            if sub:
                pointer = inline if value is None else value
                if len(pointer) >= 4:
                    try:
                        directory(struct.unpack_from(order + "I", pointer)[0], sub, depth + 1)
                    except struct.error:
                        pass
                continue
            if label == "IFD1 (thumbnail)" and tag == 0x0202 and value and kind in (3, 4) and len(value) >= TIFF_SIZES[kind]:
                size = struct.unpack_from(order + ("H" if kind == 3 else "I"), value)[0]
            held = value or b""
            found.append(item(label, f"{tag:04X}", f"{place} {label}", size, clean(held) if kind == 2 else None, None if kind == 2 else len(held)))
        return struct.unpack_from(order + "I", tiff, start + 2 + 12 * count)[0]

    try:
        following, label = struct.unpack_from(order + "I", tiff, 4)[0], "IFD0"
        while following:
            following, label = directory(following, label, 0), "IFD1 (thumbnail)"
    except struct.error:
        pass
    return found, notes


def xmp(packet: bytes, place: str) -> list[dict]:
    """One item for each known property name that occurs; else one for the packet."""
    found = [item("xmp", name, place, 0, None, len(name)) for name in dims.XMP if name.encode() in packet]
    return found or [item("xmp", "Metadata", place, len(packet))]


def riff(data: bytes, form: bytes) -> tuple[list[tuple[str, int, int, bytes]], int]:
    """(id, offset, padded length, payload) of the chunks, and where the form ends."""
    if data[:4] != b"RIFF":
        raise Doubt("missing-marker", 0)
    size = Cursor(data, 4).number("<I", "truncated", 0)
    if size < 4 or size > len(data) - 8:
        raise Doubt("length-out-of-range", 4)
    if data[8:12] != form:
        raise Doubt("missing-marker", 8)
    return riff_chunks(data, 12, 8 + size), 8 + size


def riff_chunks(data: bytes, at: int, end: int) -> list[tuple[str, int, int, bytes]]:
    out = []
    while at < end:
        if len(out) >= MOST_ITEMS:
            raise Doubt(None, None, "limit-exceeded", limit="item-count")
        if at + 4 > len(data):
            raise Doubt("truncated", at)
        kind = data[at : at + 4]
        if not all(0x20 <= b <= 0x7E for b in kind):
            raise Doubt("unexpected-marker", at)
        if at + 8 > len(data):
            raise Doubt("truncated", at)
        n = struct.unpack_from("<I", data, at + 4)[0]
        padded = n + (n & 1)
        if padded > end - at - 8:
            raise Doubt("length-out-of-range", at)
        out.append((kind.decode("ascii"), at, 8 + padded, data[at + 8 : at + 8 + n]))
        at += 8 + padded
    return out


def boxes(data: bytes, base: int = 0) -> tuple[list[tuple[str, int, int, bytes]], int]:
    """(type, offset, size, payload) of boxes in a row, and how many bytes too few for a box are left."""
    out, at = [], 0
    while len(data) - at >= 8:
        if len(out) >= MOST_ITEMS:
            raise Doubt(None, None, "limit-exceeded", limit="item-count")
        declared, kind = struct.unpack_from(">I4s", data, at)
        header, size = 8, declared
        if declared == 1:
            if len(data) - at < 16:
                raise Doubt("truncated")
            header, size = 16, struct.unpack_from(">Q", data, at + 8)[0]
        elif declared == 0:
            size = len(data) - at
        if size < header or size > len(data) - at:
            if declared not in (0, 1):
                break
            raise Doubt("length-out-of-range")
        out.append((kind.decode("latin-1"), base + at, size, data[at + header : at + size]))
        at += size
    return out, len(data) - at


def syncsafe(raw: bytes) -> int | None:
    total = 0
    for b in raw:
        if b & 0x80:
            return None
        total = total * 128 + b
    return total


def tag_text(payload: bytes) -> tuple[str | None, int | None]:
    """A text, without its encoding byte, or how long what is no text is."""
    text = clean(payload[1:] if payload[:1] and payload[0] <= 3 else payload)
    return (text, None) if text.strip() else (None, len(payload))


def head_tags(data: bytes) -> tuple[list[tuple[str, bytes, int]], int]:
    """(location, bytes, offset) of the ID3v2 tags in front, and where they end."""
    out, at = [], 0
    while data[at : at + 3] == b"ID3":
        if len(out) == 16:
            raise Doubt(None, None, "limit-exceeded", limit="item-count")
        if len(data) - at < 10:
            raise Doubt("truncated", at)
        major, flags, size = data[at + 3], data[at + 5], syncsafe(data[at + 6 : at + 10])
        if major not in (2, 3, 4):
            raise Doubt("unsupported-feature", at)
        if size is None or at + 10 + size + (10 if flags & 0x10 and major == 4 else 0) > len(data):
            raise Doubt("length-out-of-range", at)
        end = at + 10 + size + (10 if flags & 0x10 and major == 4 else 0)
        out.append((f"ID3v2.{major}", data[at:end], at))
        at = end
    return out, at


def tail_tags(data: bytes, floor: int) -> tuple[list[tuple[str, bytes, int]], int]:
    """The tags at the end, in file order, and where what stands before them ends."""
    out, end = [], max(len(data), floor)
    while True:
        found = _last_tag(data, floor, end)
        if found is None:
            return out[::-1], end
        if len(out) == 16:
            raise Doubt(None, None, "limit-exceeded", limit="item-count")
        out.append((found[0], data[found[1] : end], found[1]))
        end = found[1]


def _last_tag(data: bytes, floor: int, end: int) -> tuple[str, int] | None:
    room = end - floor
    if room >= 128 and data[end - 128 : end - 125] == b"TAG":
        wide = room - 128 >= 227 and data[end - 355 : end - 351] == b"TAG+"
        return ("ID3v1 (with TAG+)", end - 355) if wide else ("ID3v1", end - 128)
    if room >= 32 and data[end - 32 : end - 24] == b"APETAGEX":
        version, size, _, flags = struct.unpack_from("<IIII", data, end - 24)
        total = size + (32 if flags & 0x80000000 else 0)
        if size < 32 or total > room:
            raise Doubt("length-out-of-range", end - 32)
        if flags & 0x80000000 and data[end - total : end - total + 8] != b"APETAGEX":
            raise Doubt("missing-marker", end - total)
        return f"APE (version {version})", end - total
    if room >= 26 and data[end - 9 : end] == b"LYRICS200":
        digits = data[end - 15 : end - 9]
        if not digits.isdigit() or int(digits) + 15 > room:
            raise Doubt("length-out-of-range", end - 15)
        start = end - int(digits) - 15
        if data[start : start + 11] != b"LYRICSBEGIN":
            raise Doubt("missing-marker", start)
        return "Lyrics3 v2", start
    if room > 9 and data[end - 9 : end] == b"LYRICSEND":
        start = data.rfind(b"LYRICSBEGIN", end - min(room, 5100), end)
        return None if start < 0 else ("Lyrics3 v1", start)
    return None


def tag_items(location: str, raw: bytes) -> list[dict]:
    """What a tag holds; one item for the whole of it where nothing can be told apart."""
    if location.startswith("ID3v2"):
        found = _id3_items(location, raw)
    elif location.startswith("ID3v1"):
        found = [item("tag", "TAG+", location, len(raw) - 128)] if len(raw) > 128 else []
        for at, width, name, _ in dims.FIXED_FIELDS["id3v1"]:
            value = raw[-128:][at : at + width]
            if value.strip(b"\0 "):
                found.append(item("id3v1", name, location, width, *tag_text(value)))
    elif location.startswith("APE"):
        found = _ape_items(location, raw)
    else:
        found = []
    return found or [item("tag", "Tag", location, len(raw), None, len(raw))]


def _id3_items(location: str, raw: bytes) -> list[dict]:
    major, flags = raw[3], raw[5]
    body = raw[:10] + raw[10:].replace(b"\xff\0", b"\xff") if flags & 0x80 else raw
    at = 10
    if flags & 0x40:
        head = body[10:14]
        skip = {3: lambda: int.from_bytes(head) + 4, 4: lambda: syncsafe(head)}.get(major, lambda: None)() if len(head) == 4 else None
        if skip is None:
            return []
        at += skip
    width, flag = (3, 0) if major == 2 else (4, 2)
    found = []
    while len(found) < 512:
        name, size_at = body[at : at + width], at + width
        sized = body[size_at : size_at + width]
        if len(name) < width or not name.isalnum() or not name.isascii() or len(sized) < width:
            break
        size = int.from_bytes(sized)
        if major == 4:
            size = size if (safe := syncsafe(sized)) is None else safe
        start = size_at + width + flag
        if start + size > len(body):
            break
        found.append(item("id3v22" if major == 2 else "id3", clean(name), location, size, *tag_text(body[start : start + size])))
        at = start + size
    return found


def _ape_items(location: str, raw: bytes) -> list[dict]:
    r, found = Cursor(raw[32 if raw[:8] == b"APETAGEX" and len(raw) > 32 else 0 : len(raw) - 32]), []
    try:
        while len(found) < 512:
            size = r.number("<I")
            r.take(4)
            end = r.data.index(b"\0", r.at)
            name = clean(r.take(end - r.at))
            r.take(1)
            found.append(item("ape", name, location, size, *tag_text(r.take(size))))
    except (Doubt, ValueError):
        pass
    return found


def vorbis(payload: bytes, place: str) -> list[dict]:
    """Vendor and comments; one item for the block, after what could be read, where lengths do not fit."""
    r, found = Cursor(payload), []
    try:
        vendor = r.take(r.number("<I"))
        if vendor:
            found.append(item("vendor", "vendor", place, len(vendor), clean(vendor)))
        for _ in range(min(r.number("<I"), 512)):
            entry = r.take(r.number("<I"))
            name, _, value = entry.partition(b"=")
            found.append(item("vorbis", clean(name), place, len(entry), clean(value)))
    except Doubt:
        found.append(item("comments", "Comments", place, len(payload)))
    return found


def fixed_fields(data: bytes, table: str) -> list[dict]:
    found = []
    for at, width, name, _ in dims.FIXED_FIELDS[table]:
        raw = data[at:] if width is None else data[at : at + width]
        text = clean(raw.split(b"\0", 1)[0]).strip()
        if text:
            found.append(item(table, name, table, len(raw), text))
    return found


# --- one walk for each format ------------------------------------------------------------------------------------------


def png(data: bytes, w: Walk) -> None:
    signature = b"\x89PNG\r\n\x1a\n"
    if data[:8] != signature:
        raise Doubt("missing-marker", 0)
    w.add("signature", 0, 8)
    r, kind = Cursor(data, 8), b""
    while kind != b"IEND":
        w.spend()
        start = r.at
        n = r.number(">I", "truncated", start)
        if n > 0x7FFFFFFF:
            raise Doubt("length-out-of-range", start)
        kind = r.take(4, "truncated", start)
        if not (kind.isalpha() and kind.isascii()):
            raise Doubt("unexpected-marker", start)
        body = r.take(n, "length-out-of-range", start)
        r.take(4, "truncated", start)
        if start == 8 and kind != b"IHDR":
            raise Doubt("missing-marker", start)
        key = kind.decode()
        items, notes = _png_items(key, body)
        w.add(key, start, r.at - start, n, items, key, notes=notes)
    if r.at < len(data):
        w.add("trailing:nested" if data[r.at :].startswith(signature) else "trailing", r.at, len(data) - r.at)


def _png_items(key: str, body: bytes) -> tuple[list[dict], list[dict]]:
    word, _, rest = body.partition(b"\0")
    name, packet = clean(word), word == b"XML:com.adobe.xmp"
    if key == "tEXt":
        return (xmp(rest, "tEXt (XMP)"), []) if packet else ([item("png", name, key, len(rest), clean(rest))], [])
    if key == "zTXt":
        return [item("png", name, key, len(body))], []
    if key == "iTXt":
        squeezed = rest[:1] == b"\1"
        value = rest[2:].partition(b"\0")[2].partition(b"\0")[2]
        if packet:
            return ([item("xmp", "Metadata (compressed)", "iTXt (XMP)", len(body))] if squeezed else xmp(value, "iTXt (XMP)")), []
        return [item("png", name, key, len(body), None if squeezed else clean(value))], []
    if key == "tIME":
        stamp = "%04d-%02d-%02dT%02d:%02d:%02dZ" % struct.unpack_from(">HBBBBB", body) if len(body) >= 7 else None
        return [item("time", key, key, len(body), stamp, None if stamp else len(body))], []
    if key == "eXIf":
        return exif(body, key)
    if key == "iCCP":
        return [item("icc", name, key, len(body))], []
    return [], []


#: Prefix of an application segment -> what it is, by marker.
_JPEG_PREFIXES = {
    0xE0: [(b"JFXX\0", "JFXX"), (b"JFIF\0", "JFIF")], 0xE1: [(b"Exif\0\0", "Exif"), (b"http://ns.adobe.com/xap/1.0/\0", "XMP"), (b"http://ns.adobe.com/xmp/extension/\0", "XMP")],
    0xE2: [(b"ICC_PROFILE\0", "ICC"), (b"MPF\0", "MPF"), (b"FPXR", "FPXR")], 0xED: [(b"Photoshop 3.0\0", "Photoshop")], 0xEE: [(b"Adobe", "Adobe")],
}


def jpeg(data: bytes, w: Walk) -> None:
    import re

    if data[:2] != b"\xff\xd8":
        raise Doubt("missing-marker", 0)
    w.add("SOI", 0, 2)
    r, scans = Cursor(data, 2), 0
    while True:
        w.spend()
        start = r.at
        if r.take(1, "truncated", start) != b"\xff":
            raise Doubt("truncated", start)
        marker = 0xFF
        while marker == 0xFF:  # any number of fill bytes may come before the marker; they are not copied
            marker = r.take(1, "truncated", start)[0]
        at = r.at - 2
        if marker == 0:
            raise Doubt("unexpected-marker", start)
        if marker == 0xD9:
            w.add("EOI", at, 2)
            break
        if marker in (1, 0xD8) or 0xD0 <= marker <= 0xD7:
            w.add("standalone", at, 2)
            continue
        n = r.number(">H", "truncated", start)
        if n < 2:
            raise Doubt("length-out-of-range", start)
        _jpeg_segment(w, marker, r.take(n - 2, "length-out-of-range", start), at)
        if marker == 0xDA:
            scans += 1
            # Coded data runs to the first marker that is no stuffing, restart or fill.
            ends = re.compile(rb"\xff(?=[^\x00\xd0-\xd7\xff])", re.S).search(data, r.at)
            end = ends.start() if ends else len(data)
            w.add("entropy", r.at, end - r.at)
            r.at = end
    if not scans:
        raise Doubt("missing-marker")
    if r.at < len(data):
        w.add("trailing:nested" if data[r.at : r.at + 2] == b"\xff\xd8" else "trailing", r.at, len(data) - r.at)


def _jpeg_segment(w: Walk, marker: int, body: bytes, at: int) -> None:
    n = len(body)
    if marker == 0xFE:
        w.add("COM", at, n + 4, n, [item("comment", "", "COM", n, clean(body))])
        return
    if not 0xE0 <= marker <= 0xEF:
        w.add(f"{marker:02X}", at, n + 4, n)
        return
    key = f"APP{marker - 0xE0}"
    prefix, what = next(((p, k) for p, k in _JPEG_PREFIXES.get(marker, ()) if body.startswith(p)), (b"", ""))
    items, notes, replace = [], [], None
    if what == "Exif":
        items, notes = exif(body[len(prefix) :], "APP1 (Exif)")
    elif what == "XMP":
        items = xmp(body[len(prefix) :], "APP1 (XMP)")
    elif what == "JFIF":
        if n < 14:
            what = "JFIF-short"
        elif body[12] * body[13]:
            what, replace = "JFIF-thumbnail", b"\xff\xe0\x00\x10" + body[:12] + b"\0\0"
            items = [item("thumbnail", "", "APP0 (JFIF thumbnail)", 3 * body[12] * body[13])]
    w.add(f"{key}:{what}" if what else key, at, n + 4, n, items, key, replace, notes)


def gif(data: bytes, w: Walk) -> None:
    if len(data) < 6:
        raise Doubt("truncated", 0)
    if data[:6] not in (b"GIF87a", b"GIF89a"):
        raise Doubt("missing-marker", 0)
    r = Cursor(data, 6)
    table = lambda packed: 3 << ((packed & 7) + 1) if packed & 0x80 else 0
    r.take(table(r.take(7, "truncated", 6)[4]), "length-out-of-range", 13)
    w.add("prefix", 0, r.at)

    def sub_blocks(start: int) -> tuple[bytes, bytes]:
        begin, first = r.at, b""
        while True:
            w.spend()
            at = r.at
            n = r.take(1, "truncated", start)[0]
            if not n:
                return first, data[begin:at]
            body = r.take(n, "length-out-of-range", at)
            first = first or body

    while True:
        start = r.at
        intro = r.take(1, "truncated", start)[0]
        if intro == 0x3B:
            w.add("trailer", start, 1)
            break
        w.spend()
        if intro == 0x2C:
            r.take(table(r.take(9, "truncated", start)[8]), "length-out-of-range", start)
            r.take(1, "truncated", start)
            sub_blocks(start)
            w.add("image", start, r.at - start)
        elif intro == 0x21:
            label = r.take(1, "truncated", start)[0]
            head, body = sub_blocks(start)
            key, items, n = {0xF9: "control", 0xFE: "comment", 0x01: "text", 0xFF: "application"}.get(label, "extension"), [], len(body)
            if key == "comment":
                items = [item("comment", "Comment", "Comment Extension", n, clean(body))]
            elif key == "text":
                items = [item("comment", "PlainText", "Plain Text Extension", n)]
            elif key == "application":
                name = head[:11]
                if name in (b"NETSCAPE2.0", b"ANIMEXTS1.0"):
                    key = "application:loop"
                elif name == b"XMP DataXMP":
                    key, items = "application:XMP", xmp(body, "Application Extension (XMP)")
                else:
                    items = [item("gif", clean(name), "Application Extension", n)]
            # A control extension belongs to the block behind it.
            if key == "text" and w.rows[-1]["key"] == "control":
                w.rows[-1]["key"] = "control>text"
            w.add(key, start, r.at - start, n, items, f"Extension 0x{label:02X}")
        else:
            raise Doubt("unexpected-marker", start)
    if r.at < len(data):
        w.add("trailing:nested" if data[r.at : r.at + 6] in (b"GIF87a", b"GIF89a") else "trailing", r.at, len(data) - r.at)


def _riff_chunk(kind: str, payload: bytes) -> bytes:
    return kind.encode() + struct.pack("<I", len(payload)) + payload + b"\0" * (len(payload) & 1)


def webp(data: bytes, w: Walk) -> None:
    chunks, end = riff(data, b"WEBP")
    for kind, at, _, body in chunks:
        if kind == "VP8X" and len(body) != 10:
            raise Doubt("length-out-of-range", at)
    kinds = [c[0] for c in chunks]
    if not kinds or kinds[0] not in ("VP8X", "VP8 ", "VP8L") or not {"VP8 ", "VP8L", "ANMF"} & set(kinds):
        raise Doubt("missing-marker", 8)
    for kind, at, n, body in chunks:
        key, items, notes, replace = kind, [], [], None
        if kind == "VP8X" and body[0] & 0x2C:
            key, replace = "VP8X:flags", _riff_chunk(kind, bytes([body[0] & ~0x2C]) + body[1:])
        elif kind == "EXIF":
            items, notes = exif(body.removeprefix(b"Exif\0\0"), "EXIF")
        elif kind == "XMP ":
            items = xmp(body, "XMP")
        elif kind == "ANMF":
            key, items, replace = _webp_frame(body)
        w.add(key, at, n, len(body), items, clean(kind.encode()).rstrip(), replace, notes)
    if end < len(data):
        w.add("trailing:nested" if data[end : end + 4] == b"RIFF" else "trailing", end, len(data) - end)


def _webp_frame(body: bytes) -> tuple[str, list[dict], bytes | None]:
    try:
        if len(body) < 16:
            raise Doubt("truncated")
        parts = riff_chunks(body[16:], 0, len(body) - 16)
    except Doubt:
        return "ANMF:opaque", [], None
    kept = {"ALPH", "VP8 ", "VP8L"}
    found = [item("frame", "", f"ANMF {clean(k.encode()).rstrip()}", len(p)) for k, _, _, p in parts if k not in kept]
    if not found:
        return "ANMF", [], None
    return "ANMF:filtered", found, _riff_chunk("ANMF", body[:16] + b"".join(body[16 + at : 16 + at + n] for k, at, n, _ in parts if k in kept))


def wav(data: bytes, w: Walk) -> None:
    chunks, end = riff(data, b"WAVE")
    for kind, at, _, body in chunks:
        if kind == "LIST" and body[:4] == b"wavl":
            raise Doubt(None, None, "unsupported-format", "wave-list")
        if kind == "fmt " and len(body) < 16:
            raise Doubt("length-out-of-range", at)
    if not {"fmt ", "data"} <= {c[0] for c in chunks}:
        raise Doubt("missing-marker", 8)
    for kind, at, n, body in chunks:
        key, items, place, replace = kind, [], clean(kind.encode()).rstrip(), None
        if kind in ("JUNK", "PAD ", "FLLR") and body.strip(b"\0"):
            key, replace = f"{kind}:data", _riff_chunk(kind, bytes(len(body)))
            items = [item("pad", "", place, len(body))]
        elif kind == "LIST":
            place, items = _wav_list(body)
        elif kind in ("bext", "cart"):
            items = fixed_fields(body, kind)
        elif kind == "_PMX":
            items = xmp(body, "_PMX")
        w.add(key, at, n, len(body), items, place, replace)
    if end < len(data):
        w.add("trailing", end, len(data) - end)


def _wav_list(body: bytes) -> tuple[str, list[dict]]:
    if len(body) < 4:
        return "LIST", []
    form = clean(body[:4]).rstrip()
    place = f"LIST {form}"
    if body[:4] not in (b"INFO", b"adtl"):
        return place, []
    try:
        parts = riff_chunks(body[4:], 0, len(body) - 4)
    except Doubt:
        return place, []
    scope = "info" if form == "INFO" else "adtl"
    return place, [item(scope, clean(k.encode()).rstrip(), place, len(p), clean(p.split(b"\0", 1)[0]).strip()) for k, _, _, p in parts]


def flac(data: bytes, w: Walk) -> None:
    head, start = head_tags(data)
    tail, end = tail_tags(data, start)
    body = data[start:end]
    if body[:4] != b"fLaC":
        raise Doubt("missing-marker", 0)
    r, found, last = Cursor(body, 4), [], False
    while not last:
        w.spend()
        at = r.at
        first, *length = r.take(4, "truncated", at)
        kind, last = first & 0x7F, bool(first & 0x80)
        if kind == 127 or (kind == 0 and found):
            raise Doubt("unexpected-marker", at)
        if kind != 0 and not found:
            raise Doubt("missing-marker", at)
        payload = r.take(int.from_bytes(bytes(length)), "length-out-of-range", at)
        if kind == 0 and len(payload) != 34:
            raise Doubt("length-out-of-range", at)
        found.append((kind, at, payload))
    if len(body) - r.at < 2 or body[r.at] != 0xFF or body[r.at + 1] & 0xFE != 0xF8:
        raise Doubt("missing-marker", r.at)
    for place, raw, at in (*head, *tail):
        w.add("tag", at, len(raw), len(raw), tag_items(place, raw), place)
    w.add("marker", start, 4)
    final = max(i for i, (kind, _, _) in enumerate(found) if kind in (0, 1, 3))
    for i, (kind, at, payload) in enumerate(found):
        _flac_block(w, kind, start + at, payload, i == final)
    w.add("audio", start + r.at, len(body) - r.at)


def _flac_block(w: Walk, kind: int, at: int, payload: bytes, final: bool) -> None:
    n, names = len(payload), ("STREAMINFO", "PADDING", "APPLICATION", "SEEKTABLE", "VORBIS_COMMENT", "CUESHEET", "PICTURE")
    key, items, replace = names[kind] if kind < 7 else "block", [], None
    if key in ("STREAMINFO", "SEEKTABLE", "PADDING"):
        replace = bytes([kind | (0x80 if final else 0)]) + n.to_bytes(3) + (bytes(n) if key == "PADDING" else payload)
        if key == "PADDING" and payload.strip(b"\0"):
            items = [item("pad", "Padding", key, n, None, n)]
        if key == "STREAMINFO" and payload[18:].strip(b"\0"):
            key = "STREAMINFO:md5"
    elif key == "VORBIS_COMMENT":
        items = vorbis(payload, key)
    elif key == "APPLICATION":
        items = [item("application", clean(payload[:4]), key, n, None, n)]
    elif key == "CUESHEET":
        items = [item("cuesheet", "MediaCatalogNumber" if payload[:128].strip(b"\0") else "", key, n)]
    elif key == "PICTURE":
        items = [_flac_picture(payload)]
    w.add(key, at, n + 4, n, items, f"Metadata block type {kind}" if key == "block" else key, replace)


def _flac_picture(payload: bytes) -> dict:
    r, kind, media, about = Cursor(payload), 0, b"", b""
    try:
        kind = r.number(">I")
        media = r.take(r.number(">I"))
    except Doubt:
        pass
    try:
        about = r.take(r.number(">I"))
    except Doubt:
        pass
    name = f"PictureType {kind} ({clean(media)})" if media else f"PictureType {kind}"
    return item("picture", name, "PICTURE", len(payload), clean(about) if about else None, None if about else len(payload))


def mp3(data: bytes, w: Walk) -> None:
    head, start = head_tags(data)
    tail, end = tail_tags(data, start)
    region = data[start:end]
    zeros = len(region[:4096]) - len(region[:4096].lstrip(b"\0"))
    if zeros and zeros < len(region) and region[zeros] != 0xFF or zeros and zeros == len(region):
        raise Doubt("unexpected-marker", zeros)
    audio = region[zeros:]
    a, b, c, d = (*audio[:4], *[0] * 4)[:4]
    version, layer = b >> 3 & 3, b >> 1 & 3
    if len(audio) < 4 or a != 0xFF or b & 0xE0 != 0xE0 or version == 1 or not layer or c >> 4 == 15 or c >> 2 & 3 == 3:
        raise Doubt("missing-marker", start + zeros)
    if layer != 1:
        raise Doubt(None, None, "unsupported-format", "mpeg-audio-not-layer-three")
    for place, raw, at in (*head, *tail):
        w.add("tag", at, len(raw), len(raw), tag_items(place, raw), place)
    if zeros:
        w.add("padding", start, zeros)
    mono = d >> 6 == 3
    side = 4 + ((17 if mono else 32) if version == 3 else (9 if mono else 17))
    marker = audio[side : side + 4] if audio[side : side + 4] in (b"Xing", b"Info") else b"VBRI" if audio[36:40] == b"VBRI" else b""
    w.add(f"audio:{marker.decode()}" if marker else "audio", start + zeros, len(audio))


def jxl(data: bytes, w: Walk) -> None:
    if data[:2] == b"\xff\x0a":
        w.add("codestream", 0, len(data))
        return
    found, left = boxes(data)
    if not found:
        raise Doubt("truncated")
    kind, _, size, body = found[0]
    if kind != "JXL " or size != 12 or body != b"\r\n\x87\n":
        raise Doubt("missing-marker")
    if len(found) < 2:
        raise Doubt("truncated")
    if found[1][0] != "ftyp" or found[1][3][:4] != b"jxl ":
        raise Doubt("missing-marker")
    for kind, at, size, body in found:
        items = []
        if kind == "Exif" and len(body) >= 4 and (skip := struct.unpack_from(">I", body)[0]) <= len(body) - 4:
            items = exif(body[4 + skip :], "Exif box")[0]
        elif kind == "xml ":
            items = xmp(body, "xml box (XMP)")
        elif kind == "brob":
            items = [item("brob", clean(body[:4]), "brob box (Brotli-compressed metadata)", size, clean(body[:4]))]
        w.add(kind, at, size, size, items, kind)
    known = {k for f, k, *_ in dims.RULES if f == "jxl"}
    if left and all(k in known for k, *_ in found):
        raise Doubt("truncated")
    if all(k in known for k, *_ in found) and not {"jxlc", "jxlp"} & {k for k, *_ in found}:
        raise Doubt("missing-marker")


WALKERS = {"png": png, "jpeg": jpeg, "gif": gif, "webp": webp, "wav": wav, "flac": flac, "mp3": mp3, "jxl": jxl}


def walk(walker, data: bytes | None) -> tuple[list[dict], dict | None]:
    """The segments of one file, or its error."""
    w = Walk()
    try:
        walker(data or b"", w)
        return w.rows, None
    except Doubt as e:
        return [], e.row


cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(dims)
