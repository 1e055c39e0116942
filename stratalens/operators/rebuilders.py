"""Walks of formats whose output is laid out anew: Ogg pages and TIFF directories.

Such a walk gives one segment that holds the whole new file, with the items that are not in it.
"""

from __future__ import annotations

import struct
import sys

from pyspark import cloudpickle

from .. import dims
from .walkers import SUB_DIRECTORIES, TIFF_SIZES, Cursor, Doubt, Walk, clean, item, vorbis

NO_GRANULE = b"\xff" * 8
CONTINUED, FIRST, LAST = 1, 2, 4


# --- Ogg ---------------------------------------------------------------------------------------------------------------


def _crc_table() -> list[int]:
    """The unreflected CRC of polynomial 04C11DB7, by byte."""
    out = []
    for b in range(256):
        r = b << 24
        for _ in range(8):
            r = (r << 1) ^ (0x04C11DB7 if r & 0x80000000 else 0)
        out.append(r & 0xFFFFFFFF)
    return out


_CRC = _crc_table()


def ogg_crc(data: bytes) -> int:
    r = 0
    for b in data:
        r = (r << 8 & 0xFFFFFFFF) ^ _CRC[r >> 24 ^ b]
    return r


def ogg_pages(data: bytes, w: Walk) -> list[tuple[int, bytes, int, bytes, bytes, int]]:
    """(flags, granule, serial, lacing, body, offset) of pages that follow each other without a gap, each with its checksum right."""
    r, out = Cursor(data), []
    while r.at < len(data):
        w.spend()
        at = r.at
        if len(data) - at < 27:
            raise Doubt("truncated", at)
        magic, version, flags, granule, serial, _, crc, n = struct.unpack("<4sBB8sIIIB", r.take(27))
        if magic != b"OggS":
            raise Doubt("missing-marker", at)
        if version:
            raise Doubt("unexpected-marker", at)
        lacing = r.take(n, "truncated", at)
        body = r.take(sum(lacing), "length-out-of-range", at)
        if ogg_crc(data[at : at + 22] + bytes(4) + data[at + 26 : r.at]) != crc:
            raise Doubt("unexpected-marker", at)
        out.append((flags, granule, serial, lacing, body, at))
    if not out:
        raise Doubt("missing-marker", 0)
    return out


def restamped(data: bytes) -> bytes:
    """Pages with their checksums made anew."""
    out, at = [], 0
    while at < len(data):
        n = data[at + 26]
        end = at + 27 + n + sum(data[at + 27 : at + 27 + n])
        bare = data[at : at + 22] + bytes(4) + data[at + 26 : end]
        out.append(bare[:22] + struct.pack("<I", ogg_crc(bare)) + bare[26:])
        at = end
    return b"".join(out)


def ogg_packets(pages) -> list[list]:
    """[bytes, granule, whether its page ends with it] of each packet."""
    out, held = [], []  # held: the pieces of the packet in hand
    for flags, granule, _, lacing, body, at in pages:
        if bool(flags & CONTINUED) != bool(held):
            raise Doubt("unexpected-marker", at)
        done, p = 0, 0
        for n in lacing:
            held.append(body[p : p + n])
            p += n
            if n < 255:
                out.append([b"".join(held), granule, False])
                held, done = [], done + 1
        if done:
            out[-1][2] = True
        elif granule != NO_GRANULE:
            raise Doubt("unexpected-marker", at)
    if held:
        raise Doubt("truncated", pages[-1][5])
    if not out:
        raise Doubt("missing-marker", 0)
    return out


def ogg_file(packets) -> bytes:
    """Pages of serial 0 around packets: a page ends where it did, or when it is full."""
    pages, lacing, body, continued = [], [], [], False

    def flush(granule: bytes) -> None:
        nonlocal lacing, body, continued
        flags = (CONTINUED if continued else 0) | (FIRST if not pages else 0)
        pages.append([flags, granule, bytes(lacing), b"".join(body)])
        lacing, body, continued = [], [], False

    for data, granule, ends in packets:
        for at in range(0, len(data) + 1, 255):
            if len(lacing) == 255:
                flush(NO_GRANULE)
                continued = True
            piece = data[at : at + 255]
            lacing.append(len(piece))
            body.append(piece)
        if ends:
            flush(granule)
    if lacing:
        flush(NO_GRANULE)
    pages[-1][0] |= LAST
    out = []
    for i, (flags, granule, laced, held) in enumerate(pages):
        head = struct.pack("<4sBB8sII", b"OggS", 0, flags, granule, 0, i)
        rest = bytes([len(laced)]) + laced + held
        out.append(head + struct.pack("<I", ogg_crc(head + bytes(4) + rest)) + rest)
    return b"".join(out)


def _expect(packets, i: int, marker: bytes) -> bytes:
    if i >= len(packets):
        raise Doubt("truncated")
    if not packets[i][0].startswith(marker):
        raise Doubt("missing-marker")
    return packets[i][0]


def _ogg(codec: str):
    def walk(data: bytes, w: Walk) -> None:
        pages = ogg_pages(data, w)
        if not pages[0][0] & FIRST:
            raise Doubt("missing-marker", 0)
        for i, (flags, _, serial, *_) in enumerate(pages):
            if serial != pages[0][2] or (i and flags & FIRST) or bool(flags & LAST) != (i == len(pages) - 1):
                raise Doubt(None, None, "unsupported-format", "multiplexed-ogg")
        packets = ogg_packets(pages)
        key, items = "rebuilt", []
        if codec == "ogg-flac":
            headers, key, items = _ogg_flac(packets)
        else:
            head, tags, headers, end = {"ogg": (b"\x01vorbis", b"\x03vorbis", 3, b"\1"), "opus": (b"OpusHead", b"OpusTags", 2, b"")}[codec]
            _expect(packets, 0, head)
            body = _expect(packets, 1, tags)[len(tags) :]
            if codec == "ogg":
                _expect(packets, 2, b"\x05vorbis")
            items = vorbis(body, "VORBIS_COMMENT" if codec == "ogg" else "OpusTags")
            packets[1][0] = tags + bytes(8) + end
        if len(packets) <= headers:
            raise Doubt("truncated")
        w.add(key, 0, len(data), len(data), items, replace=ogg_file(packets))

    return walk


def _flac_header(raw: bytes) -> tuple[int, bool, bytes]:
    if len(raw) < 4:
        raise Doubt("truncated")
    if int.from_bytes(raw[1:4]) != len(raw) - 4:
        raise Doubt("length-out-of-range")
    return raw[0] & 0x7F, bool(raw[0] & 0x80), raw[4:]


def _ogg_flac(packets) -> tuple[int, str, list[dict]]:
    """The number of header packets, the segment's key and items; header packets are replaced in place."""
    mapping = _expect(packets, 0, b"\x7fFLAC")
    if mapping[5:6] != b"\1":
        raise Doubt("unexpected-marker" if len(mapping) > 5 else "unexpected-marker")
    if len(mapping) < 9:
        raise Doubt("truncated")
    if mapping[9:13] != b"fLaC":
        raise Doubt("missing-marker", 9)
    kind, last, info = _flac_header(mapping[13:])
    if kind or len(info) != 34:
        raise Doubt("missing-marker")
    items, i = [], 1
    while not last:
        if i >= len(packets):
            raise Doubt("truncated")
        kind, last, payload = _flac_header(packets[i][0])
        n, made = len(payload), None
        if kind in (0, 127):
            raise Doubt("unexpected-marker")
        if kind == 4:
            items += vorbis(payload, "VORBIS_COMMENT")
            made = (4, bytes(8))
        elif kind == 1 and payload.strip(b"\0"):
            items.append(item("pad", "Padding", "PADDING", n, None, n))
            made = (1, bytes(n))
        elif kind not in (1, 3):
            named = {2: ("application", clean(payload[:4]), "APPLICATION"), 5: ("cuesheet", "MediaCatalogNumber", "CUESHEET"), 6: ("picture", "", "PICTURE")}
            items.append(item(*named.get(kind, ("pad", "", f"Metadata block type {kind}")), n, None, n))
            made = (1, b"")
        if made:
            packets[i][0] = bytes([made[0] | (0x80 if last else 0)]) + len(made[1]).to_bytes(3) + made[1]
        i += 1
    declared = int.from_bytes(mapping[7:9])
    if declared and declared != i - 1:
        raise Doubt("length-out-of-range")
    return i, "rebuilt:md5" if info[18:].strip(b"\0") else "rebuilt", items


# --- TIFF --------------------------------------------------------------------------------------------------------------

#: Tags without which the picture cannot be decoded or shown; strips and tiles are laid out anew.
STRUCTURAL = frozenset(
    (0x00FE, 0x00FF, 0x0100, 0x0101, 0x0102, 0x0103, 0x0106, 0x010A, 0x0112, 0x0115, 0x0116, 0x0118, 0x0119, 0x011A, 0x011B, 0x011C, 0x0128, 0x0129, 0x013D, 0x0140, 0x0142, 0x0143, 0x0152, 0x0153, 0x0154, 0x0155, 0x015B, 0x0211, 0x0212, 0x0213, 0x0214)
)
STRIPS, TILES = (0x0111, 0x0117), (0x0144, 0x0145)


class Tiff:
    def __init__(self, data: bytes, w: Walk):
        self.data, self.w, self.items, self.notes, self.seen = data, w, [], [], set()
        self.order = {b"II": "<", b"MM": ">"}.get(data[:2])
        if self.order is None:
            raise Doubt("missing-marker")
        magic = Cursor(data, 2).number(self.order + "H", "missing-marker")
        if magic != 42:
            raise Doubt("unsupported-feature" if magic == 43 else "missing-marker")

    def entry(self, at: int) -> tuple[int, int, int, bytes, bytes | None]:
        """(tag, type, count, inline bytes, value) of an entry."""
        if at + 12 > len(self.data):
            raise Doubt("truncated")
        tag, kind, n = struct.unpack_from(self.order + "HHI", self.data, at)
        inline, size = self.data[at + 8 : at + 12], TIFF_SIZES.get(kind)
        if size is None:
            return tag, kind, n, inline, None
        if size * n <= 4:
            return tag, kind, n, inline, inline[: size * n]
        start = struct.unpack(self.order + "I", inline)[0]
        return tag, kind, n, inline, self.data[start : start + size * n] if start + size * n <= len(self.data) else None

    def directory(self, start: int) -> tuple[list, int]:
        if start > len(self.data):
            raise Doubt("length-out-of-range")
        count = Cursor(self.data, start).number(self.order + "H")
        entries = []
        for i in range(count):
            self.w.spend()
            entries.append(self.entry(start + 2 + 12 * i))
        return entries, Cursor(self.data, start + 2 + 12 * count).number(self.order + "I")

    def told(self, label: str, entry) -> None:
        tag, kind, _, _, value = entry
        held = value or b""
        self.items.append(item(label, f"{tag:04X}", f"TIFF {label}", len(held), clean(held) if kind == 2 else None, None if kind == 2 else len(held)))

    def sub(self, entry, label: str) -> None:
        """Names what a directory below holds; it goes with its pointer."""
        pointer = entry[3] if entry[4] is None else entry[4]
        if len(pointer) < 4 or (start := struct.unpack_from(self.order + "I", pointer)[0]) in self.seen:
            return
        self.seen.add(start)
        try:
            for i in range(Cursor(self.data, start).number(self.order + "H")):
                if not self.w.left:
                    self.notes.append({"location": f"TIFF {label}", "bytes": max(0, len(self.data) - start - 2 - 12 * i)})
                    return
                self.w.spend()
                below = self.entry(start + 2 + 12 * i)
                deeper = SUB_DIRECTORIES.get((label, below[0]))
                self.sub(below, deeper) if deeper else self.told(label, below)
        except Doubt:
            return

    def page(self, entries) -> tuple[dict, list[bytes], tuple[int, int]]:
        """(kept entries by tag, picture data, the tags of its geometry)."""
        geometry = TILES if any(e[0] == TILES[0] for e in entries) else STRIPS
        kept, numbers = {}, {}
        for e in entries:
            tag, kind, n, _, value = e
            if tag in geometry:
                if value is None:
                    raise Doubt("length-out-of-range")
                if kind not in (3, 4):
                    raise Doubt("unsupported-feature")
                width = TIFF_SIZES[kind]
                numbers[tag] = struct.unpack(f"{self.order}{len(value) // width}{'H' if kind == 3 else 'I'}", value[: len(value) // width * width])
            elif tag in (*STRIPS, *TILES):
                continue
            elif tag in STRUCTURAL:
                if tag not in kept:
                    if value is None:
                        raise Doubt("length-out-of-range")
                    kept[tag] = (kind, n, value)
            elif sub := SUB_DIRECTORIES.get(("IFD0", tag)):
                self.sub(e, sub)
            else:
                self.told("IFD0", e)
        if len(numbers) < 2:
            raise Doubt("missing-marker")
        offsets, counts = (numbers[t] for t in geometry)
        if not offsets or len(offsets) != len(counts):
            raise Doubt("broken-index")
        data = [self.data[a : a + n] for a, n in zip(offsets, counts, strict=True)]
        if any(len(d) != n or a > len(self.data) for d, n, a in zip(data, counts, offsets, strict=True)):
            raise Doubt("length-out-of-range")
        if not {0x0100, 0x0101} <= set(kept):
            raise Doubt("missing-marker")
        return kept, data, geometry

    def reduced(self, entries) -> bool:
        value = next((e for e in entries if e[0] == 0x00FE), None)
        return bool(value and value[4] and len(value[4]) >= 4 and struct.unpack_from(self.order + "I", value[4])[0] & 1)

    def write(self, pages) -> bytes:
        """Each page is its directory, the values that do not fit an entry, and its data, all at even offsets."""
        even = lambda b: b + b"\0" * (len(b) % 2)
        out, at = [self.data[:2] + struct.pack(self.order + "HI", 42, 8)], 8
        for i, (kept, data, geometry) in enumerate(pages):
            tags = sorted([*kept, *geometry])
            long = {t: kept[t][2] if t in kept else bytes(4 * len(data)) for t in tags}
            values_at = at + 6 + 12 * len(tags)
            data_at = values_at + sum(len(even(v)) for v in long.values() if len(v) > 4)
            spots = []
            for d in data:
                spots.append(data_at)
                data_at += len(even(d))
            if data_at >= 2**32:
                raise Doubt("length-out-of-range")
            numbers = {geometry[0]: spots, geometry[1]: [len(d) for d in data]}
            entries, values = [], []
            for t in tags:
                kind, n, value = kept[t] if t in kept else (4, len(data), struct.pack(f"{self.order}{len(data)}I", *numbers[t]))
                entries.append(struct.pack(self.order + "HHI", t, kind, n) + (value.ljust(4, b"\0") if len(value) <= 4 else struct.pack(self.order + "I", values_at)))
                if len(value) > 4:
                    values.append(even(value))
                    values_at += len(values[-1])
            following = data_at if i + 1 < len(pages) else 0
            out += [struct.pack(self.order + "H", len(tags)), *entries, struct.pack(self.order + "I", following), *values, *map(even, data)]
            at = data_at
        return b"".join(out)


def tiff(data: bytes, w: Walk) -> None:
    t = Tiff(data, w)
    start, pages = Cursor(data, 4).number(t.order + "I"), []
    while start:
        if start in t.seen:
            raise Doubt("cyclic-reference")
        t.seen.add(start)
        entries, following = t.directory(start)
        if t.reduced(entries):
            t.items.append(item("thumbnail", "reduced-resolution image", "TIFF reduced-resolution IFD", 0))
        else:
            pages.append(t.page(entries))
        start = following
    if not pages:
        raise Doubt("missing-marker")
    w.add("rebuilt", 0, len(data), len(data), t.items, replace=t.write(pages), notes=t.notes)


WALKERS = {"ogg": _ogg("ogg"), "opus": _ogg("opus"), "ogg-flac": _ogg("ogg-flac"), "tiff": tiff}

cloudpickle.register_pickle_by_value(sys.modules[__name__])
cloudpickle.register_pickle_by_value(dims)
