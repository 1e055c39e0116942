"""Walks of ISO base media files: MP4 and M4A movies, HEIF and AVIF stills.

What a level may hold is a rule table (dims.BOXES); a walk applies it to the tree of boxes and gives the index box, laid out
anew, as one segment, beside the media that is kept as it is. Offsets into the media are moved with it, all at once.
"""

from __future__ import annotations

import struct
import sys

from pyspark import cloudpickle

from .. import dims
from .walkers import MOST_DEPTH, Doubt, Walk, boxes, clean, exif, item, xmp


def box(kind: bytes, body: bytes) -> bytes:
    n = len(body) + 8
    return struct.pack(">I4s", n, kind) + body if n < 1 << 32 else struct.pack(">I4sQ", 1, kind, n + 8) + body


def tiled(w: Walk, payload: bytes, base: int) -> list[tuple[str, int, int, bytes]]:
    """The boxes that a payload consists of, to its last byte."""
    found, left = boxes(payload, base)
    if left:
        raise Doubt("length-out-of-range", base)
    for _ in found:
        w.spend()
    return found


def name_of(kind: str) -> str:
    return clean(kind.encode("latin-1"))


# --- movies ------------------------------------------------------------------------------------------------------------


class Offsets:
    """A table of chunk offsets: its width is fixed, its values are moved when the layout is known."""

    def __init__(self, kind: str, body: bytes):
        import numpy as np

        wide = kind == "co64"
        if len(body) < 8:
            raise Doubt("truncated")
        if len(body) - 8 != struct.unpack_from(">I", body, 4)[0] * (8 if wide else 4):
            raise Doubt("broken-index")
        self.kind, self.head, self.dtype = kind.encode("latin-1"), body[:8], ">u8" if wide else ">u4"
        self.values = np.frombuffer(body, self.dtype, offset=8).astype(np.uint64)

    def __len__(self):
        return 16 + self.values.nbytes // (1 if self.dtype == ">u8" else 2)

    def moved(self, extents) -> bytes:
        """Each value by the extent [old, end) -> new that holds it; a value outside all refuses the file."""
        import numpy as np

        old, end, new = (np.array([e[i] for e in extents], np.uint64) for i in range(3))
        at = np.searchsorted(old, self.values, "right").astype(np.int64) - 1
        if len(self.values) and (not len(old) or (at < 0).any() or (self.values >= end[at]).any()):
            raise Doubt("broken-index")
        values = self.values - old[at] + new[at] if len(self.values) else self.values
        if self.dtype == ">u4" and len(values) and values.max() >= 1 << 32:
            raise Doubt("length-out-of-range")
        return box(self.kind, self.head + values.astype(self.dtype).tobytes())


def _movie_level(w: Walk, parent: str, payload: bytes, base: int, path: str, depth: int, handler: bytes, items: list) -> list:
    """The pieces (bytes or Offsets) of what one level keeps; what it drops goes to items."""
    if depth <= 0:
        raise Doubt(None, None, "limit-exceeded", limit="nesting-depth")
    kids, out = tiled(w, payload, base), []
    if parent == "mdia":
        handler = next((b[8:12] for k, _, _, b in kids if k == "hdlr"), b"")
    for kind, at, size, body in kids:
        refused(kind)
        start = at - base
        if kind not in dims.BOXES[parent]:
            items += dropped(kind, size, body, path, 3)
        elif kind in dims.BOXES:
            inner = _movie_level(w, kind, body, at + size - len(body), f"{path}/{kind}", depth - 1, handler, items)
            out.append(struct.pack(">I4s", 8 + sum(map(len, inner)), kind.encode("latin-1")))
            out += inner
        elif kind in ("stco", "co64"):
            out.append(Offsets(kind, body))
        elif kind in ("mvhd", "tkhd", "mdhd"):
            out.append(_times(kind, body, f"{path}/{kind}", items) or payload[start : start + size])
        elif kind == "hdlr" and len(body) > 24 and body[24:] != b"\0":
            items.append(item("kind:software-fingerprint", "name", f"{path}/hdlr", len(body) - 24, clean(body[24:])))
            out.append(box(b"hdlr", body[:24] + b"\0"))
        elif kind == "stsd":
            out.append(_descriptions(w, body, handler, f"{path}/stsd", items) or payload[start : start + size])
        else:
            if kind == "dinf":
                _own_media(w, body)
            out.append(payload[start : start + size])
    if parent == "moov" and not {"mvhd", "trak"} <= {k for k, *_ in kids}:
        raise Doubt("missing-marker")
    return out


def refused(kind: str) -> None:
    if kind in dims.BOX_REFUSALS:
        raise Doubt(None, None, "unsupported-format", dims.BOX_REFUSALS[kind])


def _times(kind: str, body: bytes, place: str, items: list) -> bytes | None:
    """A header box without its times, language and reserved fields; None where it is too short to hold them."""
    if len(body) < 4:
        raise Doubt("truncated")
    n = 16 if body[0] == 1 else 8
    if len(body) < 4 + n:
        return None
    if body[4 : 4 + n].strip(b"\0"):
        items.append(item("kind:timestamp", "creation_time, modification_time", place, n))
    new = bytearray(body[:4] + bytes(n) + body[4 + n :])
    language, reserved = (32, 84) if body[0] == 1 else (20, 72)
    if kind == "mdhd" and len(new) >= language + 2 and new[language : language + 2] != b"\x55\xc4":
        new[language : language + 2] = b"\x55\xc4"  # undetermined
        items.append(item("kind:other", "language", place, 2))
    if kind == "mvhd" and new[reserved : reserved + 24].strip(b"\0") and len(new) >= reserved + 24:
        new[reserved : reserved + 24] = bytes(24)
        items.append(item("kind:other", "pre_defined", place, 24, "poster, preview and selection times"))
    return box(kind.encode("latin-1"), bytes(new))


def _descriptions(w: Walk, body: bytes, handler: bytes, place: str, items: list) -> bytes | None:
    """Sample descriptions with the encoder's name blanked in video entries; None where nothing changes."""
    if len(body) < 4:
        raise Doubt("truncated")
    new, named = bytearray(body), False
    for kind, at, size, inner in tiled(w, body[8:], 8):
        if kind in dims.PROTECTED_ENTRIES:
            raise Doubt(None, None, "unsupported-format", "protected-media")
        field = at + size - len(inner) + 42
        if handler == b"vide" and len(new) >= field + 32 and new[field : field + 32].strip(b"\0"):
            items.append(item("kind:software-fingerprint", "compressorname", place, 32, clean(bytes(new[field + 1 : field + 1 + min(new[field], 31)]))))
            new[field : field + 32], named = bytes(32), True
    return box(b"stsd", bytes(new)) if named else None


def _own_media(w: Walk, body: bytes) -> None:
    """Refuses a track whose media is in another file."""
    for kind, _, _, inner in tiled(w, body, 0):
        if kind == "dref":
            if len(inner) < 4:
                raise Doubt("truncated")
            if any(len(b) < 4 or not b[3] & 1 for _, _, _, b in tiled(w, inner[8:], 0)):
                raise Doubt("unsupported-feature")


def dropped(kind: str, size: int, body: bytes, path: str, levels: int) -> list[dict]:
    """What a dropped box held: tag boxes are looked into, others are one item."""
    place = f"{path}/{name_of(kind)}".lstrip("/")
    if kind == "uuid":
        found = xmp(body[16:], f"{place} (XMP)") if body[:16] == dims.XMP_UUID else []
        return found or [item("kind:other", "", place, size)]
    if kind in ("free", "skip", "wide"):
        return [item("kind:other", place, "free space", size)]
    if kind in ("udta", "meta", "ilst", "keys") and levels > 0:
        try:
            kids, left = boxes(body[4:] if kind == "meta" else body)
        except Doubt:
            kids, left = [], 1
        if kids and not left:
            return [x for k, _, n, b in kids for x in dropped(k, n, b, place, levels - 1)]
    return [item("mp4", name_of(kind), place, size, atom_text(body))]


def atom_text(body: bytes) -> str | None:
    """The text behind eight bytes of a value's head, or behind four of a tag's; None where neither is plain text."""
    for skip, least in ((8, 9), (4, 4)):
        text = body[skip:]
        if len(body) >= least and all(b >= 0x20 or skip == 8 and b == 10 for b in text):
            try:
                text.decode()
            except UnicodeDecodeError:
                continue
            return clean(text)
    return None


def mp4(data: bytes, w: Walk) -> None:
    top, left = boxes(data)
    for kind, *_ in top:
        w.spend()
        refused(kind)
    brands = next((b for k, _, _, b in top if k == "ftyp"), None)
    if brands is None:
        raise Doubt("missing-marker")
    for i in range(0, len(brands) - 3, 4):
        brand = brands[i : i + 4].decode("latin-1")
        if other := dims.BRAND_REFUSALS.get(brand) or dims.BRAND_REFUSALS.get(brand[:3]):
            raise Doubt(None, None, "unsupported-format", other)
    movies = [t for t in top if t[0] == "moov"]
    if len(movies) != 1:
        raise Doubt("unexpected-marker" if movies else "missing-marker")
    kind, at, size, body = movies[0]
    items: list = []
    pieces = _movie_level(w, "moov", body, at + size - len(body), "moov", MOST_DEPTH, b"", items)
    index, out, extents = 8 + sum(map(len, pieces)), 0, []
    for kind, at, size, body in top:
        if kind == "mdat":
            head = size - len(body)
            extents.append((at + head, at + size, out + head))
        out += index if kind == "moov" else size if kind in ("ftyp", "mdat") else 0
    moved = b"".join(p.moved(extents) if isinstance(p, Offsets) else p for p in pieces)
    for kind, at, size, body in top:
        if kind == "moov":
            w.add("moov", at, size, size, items, "moov", box(b"moov", moved))
            w.add("codec", at + size, 0)
        elif kind in ("ftyp", "mdat"):
            w.add(kind, at, size)
        else:
            w.add("dropped", at, size, size, dropped(kind, size, body, "", 3), name_of(kind))
    if left:
        w.add("trailing", len(data) - left, left)


# --- stills ------------------------------------------------------------------------------------------------------------


def full(body: bytes) -> tuple[int, int, bytes]:
    """Version, flags and the rest of a full box."""
    if len(body) < 4:
        raise Doubt("truncated")
    return body[0], int.from_bytes(body[1:4]), body[4:]


def full_box(kind: bytes, body: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, bytes([version]) + flags.to_bytes(3) + body)


class Fields:
    """Big-endian numbers from a body, one after the other."""

    def __init__(self, body: bytes):
        self.body, self.at = body, 0

    def u(self, width: int) -> int:
        if width not in (0, 1, 2, 4, 8) or self.at + width > len(self.body):
            raise Doubt("truncated")
        self.at += width
        return int.from_bytes(self.body[self.at - width : self.at])


def _infos(w: Walk, body: bytes) -> list[dict]:
    """id, kind, name and type of the items that are listed."""
    version, _, rest = full(body)
    out = []
    if len(rest) < (2 if version == 0 else 4):
        raise Doubt("truncated")
    for kind, _, _, entry in tiled(w, rest[2 if version == 0 else 4 :], 0):
        if kind != "infe":
            continue
        v, _, e = full(entry)
        if v < 2:
            raise Doubt("unsupported-feature")
        f = Fields(e)
        number, protected, code = f.u(2 if v == 2 else 4), f.u(2), f.u(4)
        if protected:
            raise Doubt("unsupported-feature")
        name, _, more = e[f.at :].partition(b"\0")
        code = code.to_bytes(4).decode("latin-1")
        out.append({"id": number, "kind": code, "name": name, "type": more.partition(b"\0")[0] if code == "mime" else b""})
    return out


def _places(body: bytes) -> dict[int, list[tuple[int, int, int]]]:
    """Item -> (method, offset, length) of its extents; the first entry of an item counts."""
    version, _, rest = full(body)
    f, out = Fields(rest), {}
    widths = f.u(2)
    offset, length, base, index = (widths >> s & 15 for s in (12, 8, 4, 0))
    if not {offset, length, base, index if version else 0} <= {0, 4, 8}:
        raise Doubt("truncated")
    for _ in range(f.u(2 if version < 2 else 4)):
        number, method = f.u(2 if version < 2 else 4), f.u(2) & 15 if version else 0
        if f.u(2):
            raise Doubt("unsupported-feature")
        start, extents = f.u(base), []
        for _ in range(f.u(2)):
            f.u(index if version else 0)
            extents.append((method, start + f.u(offset), f.u(length)))
        out.setdefault(number, extents)
    return out


def _references(w: Walk, body: bytes) -> list[tuple[str, int, list[int]]]:
    version, _, rest = full(body)
    width, out = 4 if version else 2, []
    for kind, _, _, entry in tiled(w, rest, 0):
        f = Fields(entry)
        out.append((kind, f.u(width), [f.u(width) for _ in range(f.u(2))]))
    return out


def _properties(w: Walk, body: bytes) -> tuple[list[tuple[str, bytes]], list[tuple[int, list[tuple[int, int]]]]]:
    """(kind, payload) of properties, and (item, [(place, essential)]) of what has them."""
    kids, owned = tiled(w, body, 0), []
    held = next((b for k, _, _, b in kids if k == "ipco"), b"")
    for entry in (b for k, _, _, b in kids if k == "ipma"):
        version, flags, rest = full(entry)
        f, width = Fields(rest), 2 if flags & 1 else 1
        for _ in range(f.u(4)):
            number = f.u(4 if version else 2)
            marks = [f.u(width) for _ in range(f.u(1))]
            owned.append((number, [(m & (1 << 8 * width - 1) - 1, m >> 8 * width - 1) for m in marks]))
    return [(k, b) for k, _, _, b in tiled(w, held, 0)], owned


def _item_found(it: dict, thumbnail: bool) -> list[dict]:
    """What a dropped item is."""
    kind, body, n = name_of(it["kind"]), it["data"], len(it["data"])
    if thumbnail:
        return [item("kind:thumbnail", kind, "item (thmb)", n)]
    if it["kind"] == "Exif":
        skip = int.from_bytes(body[:4].ljust(4, b"\0")) + 4
        return exif(body[skip:], "item (Exif)")[0] or [item("kind:other", "", "item (Exif)", n)]
    if it["kind"] == "mime":
        found = xmp(body, "item (XMP)") if b"rdf+xml" in it["type"] or b"<x:xmpmeta" in body else []
        return found or [item("kind:other", clean(it["type"]), "item (mime)", n)]
    return [item("kind:other", kind, f"item ({kind})", n)]


def property_kept(kind: str, payload: bytes) -> bool:
    return payload[:4] == b"nclx" if kind == "colr" else kind in dims.STILL_PROPERTIES


def heif(data: bytes, w: Walk) -> None:
    top, left = boxes(data)
    for kind, *_ in top:
        w.spend()
        if kind in dims.MOTION_BOXES:
            raise Doubt(None, None, "unsupported-format", "motion-heif")
    head = {k: b for k, _, _, b in reversed(top)}
    if "ftyp" not in head:
        raise Doubt("missing-marker")
    brands = head["ftyp"]
    if {brands[i : i + 4].decode("latin-1") for i in range(8, len(brands) - 3, 4)} & set(dims.SEQUENCE_BRANDS):
        raise Doubt(None, None, "unsupported-format", "motion-heif")
    if "meta" not in head:
        raise Doubt("missing-marker")
    kids = tiled(w, full(head["meta"])[2], 0)
    meta = {k: b for k, _, _, b in reversed(kids)}
    if "ipro" in meta:
        raise Doubt("unsupported-feature")
    if not {"pitm", "iinf", "iloc"} <= set(meta):
        raise Doubt("missing-marker")
    version, _, body = full(meta["pitm"])
    primary = Fields(body).u(4 if version else 2)
    listed, places = _infos(w, meta["iinf"]), _places(meta["iloc"])
    refs = _references(w, meta["iref"]) if "iref" in meta else []
    props, owned = _properties(w, meta["iprp"]) if "iprp" in meta else ([], [])
    for it in listed:
        it["data"] = b"".join(_extent(data, meta.get("idat"), *e) for e in places.get(it["id"], []))

    found: list = []
    for kind, _, size, body in top:
        if kind not in ("ftyp", "meta", "mdat"):
            packet = xmp(body[16:], "uuid (XMP)") if kind == "uuid" and body[:16] == dims.XMP_UUID else None
            found += [item("kind:other", name_of(kind), {"free": "free space", "skip": "free space", "uuid": "uuid"}.get(kind, "box"), size)] if packet is None else packet
    for kind, _, size, _ in kids:
        if kind not in dims.STILL_META and kind != "idat":
            found.append(item("kind:other", name_of(kind), {"xml ": "meta/xml", "bxml": "meta/xml", "uuid": "meta/uuid"}.get(kind, "meta"), size))
    if left:
        found.append(item("kind:other", "", "trailing data", left))
    found += [item("kind:colour-profile" if k == "colr" else "kind:other", name_of(k), "iprp/ipco", len(b)) for k, b in props if not property_kept(k, b)]
    thumbnails, kept = {source for kind, source, _ in refs if kind == "thmb"}, []
    for it in listed:
        if it["kind"] in dims.STILL_ITEMS and it["id"] not in thumbnails:
            kept.append(it)
            found += [item("kind:other", "item_name", "iinf/infe", len(it["name"]), clean(it["name"]))] if it["name"] else []
        else:
            found += _item_found(it, it["id"] in thumbnails)
    if primary not in {it["id"] for it in kept}:
        raise Doubt("missing-marker")
    named = full(meta["hdlr"])[2][20:].partition(b"\0")[0] if "hdlr" in meta and len(meta["hdlr"]) >= 4 else b""
    if named:
        found.append(item("kind:software-fingerprint", "name", "meta/hdlr", len(named), clean(named)))
    notes = [{"location": "grid (tiled image; tiles are moved, never decoded)", "bytes": None}] if any(it["kind"] == "grid" for it in listed) else []
    w.add("rebuilt", 0, len(data), len(data), found, None, _still(brands, primary, kept, refs, props, owned), notes)
    if any(k == "colr" and property_kept(k, b) for k, b in props):
        w.add("colour", len(data), 0)


def _extent(data: bytes, idat: bytes | None, method: int, offset: int, length: int) -> bytes:
    if method > 1:
        raise Doubt("unsupported-feature")
    source = data if method == 0 else idat
    if source is None:
        raise Doubt("missing-marker")
    if offset + length > len(source):
        raise Doubt("length-out-of-range")
    return source[offset : offset + length]


def _still(brands: bytes, primary: int, kept: list[dict], refs: list, props: list, owned: list) -> bytes:
    """The file of the kept items, numbered from 1 in order; one extent each, in one media box behind the index."""
    if len(kept) >= 1 << 16:
        raise Doubt("length-out-of-range")
    number = {}
    for i, it in enumerate(kept):
        number.setdefault(it["id"], i + 1)
    u2 = lambda n: n.to_bytes(2)
    place = {old + 1: new + 1 for new, old in enumerate(i for i, (k, b) in enumerate(props) if property_kept(k, b))}
    head = full_box(b"hdlr", bytes(4) + b"pict" + bytes(13)) + full_box(b"pitm", u2(number[primary]))
    head += box(b"dinf", full_box(b"dref", (1).to_bytes(4) + full_box(b"url ", b"", 0, 1)))
    head += full_box(b"iinf", u2(len(kept)) + b"".join(full_box(b"infe", u2(i + 1) + bytes(2) + it["kind"].encode("latin-1") + b"\0", 2) for i, it in enumerate(kept)))
    tail = b""
    links = [(kind, number[a], [number[t] for t in to if t in number]) for kind, a, to in refs if kind in ("dimg", "auxl") and a in number]
    if links:
        tail += full_box(b"iref", b"".join(box(k.encode(), u2(a) + u2(len(to)) + b"".join(map(u2, to))) for k, a, to in links if to))
    if place:
        wide = len(place) > 0x7F
        rows = [(i + 1, [(place[p], e) for owner, marks in owned if owner == it["id"] for p, e in marks if p in place]) for i, it in enumerate(kept)]
        rows = [(i, marks) for i, marks in rows if marks]
        if any(len(marks) > 255 for _, marks in rows):
            raise Doubt("length-out-of-range")
        mark = (lambda p, e: u2(p | e << 15)) if wide else (lambda p, e: bytes([p | e << 7]))
        table = b"".join(u2(i) + bytes([len(marks)]) + b"".join(mark(p, e) for p, e in marks) for i, marks in rows)
        held = b"".join(box(props[old - 1][0].encode("latin-1"), props[old - 1][1]) for old in place)
        tail += box(b"iprp", box(b"ipco", held) + full_box(b"ipma", len(rows).to_bytes(4) + table, 0, int(wide)))
    start = box(b"ftyp", brands)
    at = len(start) + 12 + len(head) + (12 + 4 + 16 * len(kept)) + len(tail) + 8
    rows = b""
    for i, it in enumerate(kept):
        if at + len(it["data"]) >= 1 << 32:
            raise Doubt("length-out-of-range")
        rows += u2(i + 1) + bytes(4) + u2(1) + at.to_bytes(4) + len(it["data"]).to_bytes(4)
        at += len(it["data"])
    index = full_box(b"meta", head + full_box(b"iloc", b"\x44\x00" + u2(len(kept)) + rows, 1) + tail)
    return start + index + box(b"mdat", b"".join(it["data"] for it in kept))


WALKERS = {"mp4": mp4, "m4a": mp4, "heif": heif, "avif": heif}

cloudpickle.register_pickle_by_value(sys.modules[__name__])
