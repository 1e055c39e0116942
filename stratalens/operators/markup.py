"""The walk of SVG: a scanner over UTF-8 bytes that keeps byte ranges, and the cuts that a drawing can do without.

Elements and attributes of foreign namespaces, metadata, comments and instructions are cut; pictures in data URIs are
stripped by their own format's walk; anything that can run code refuses the file.
"""

from __future__ import annotations

import base64
import re
import sys

from pyspark import cloudpickle

from .. import dims
from .rebuilders import WALKERS as REBUILDERS
from .walkers import WALKERS as SIMPLE
from .walkers import Doubt, Walk, clean, item, walk

# Fixed values.
SCRIPTS, PREFIXES, ACCESSIBLE = ("script", "foreignObject", "handler"), ("xlink", "xml"), ("title", "desc")
REFERENCES = ("href", "xlink:href", "src")
PEOPLE = ("creator", "contributor", "publisher", "docname", "docbase", "export-filename", "absref", "sourcefile")
TIMES, TEXTS = ("modified", "created", "timestamp"), ("title", "description", "subject", "rights", "license")

_OTHER = [(b"<!--", b"-->", "comment"), (b"<![CDATA[", b"]]>", "cdata"), (b"<?", b"?>", "instruction"), (b"<!", b">", "doctype")]
_TAG_END = re.compile(rb"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+>""")  # nothing is given back: there is one way to read a tag
_NAME, _SPACE = re.compile(rb"[^\s/]*"), re.compile(rb"\s")
_ATTRIBUTE = re.compile(rb"""(\s*)([^\s=>/]+)\s*=\s*(?:"([^"]*)"|'([^']*)')""")
_URL = re.compile(r"url\(([^)]*)\)")
_STYLE_COMMENT = re.compile(rb"""("(?:\\.|[^"\\])*"?|'(?:\\.|[^'\\])*'?)|/\*(?:.*?\*/|.*\Z)""", re.S)


class Tag:
    __slots__ = ("name", "kind", "start", "end")

    def __init__(self, name: str, kind: str, start: int, end: int):
        self.name, self.kind, self.start, self.end = name, kind, start, end


def scan(src: bytes) -> tuple[list[Tag], list[tuple[str, int, int]]]:
    """Element tags, and (kind, start, end) of what is no element. What does not end, ends the scan or runs to the end."""
    tags, others, at = [], [], 0
    while (open_ := src.find(b"<", at)) >= 0:
        found = next(((k, p, t) for p, t, k in _OTHER if src.startswith(p, open_)), None) if src.startswith((b"<!", b"<?"), open_) else None
        if found:
            kind, prefix, ends = found
            close = src.find(ends, open_ + len(prefix))
            at = len(src) if close < 0 else close + len(ends)
            others.append((kind, open_, at))
            continue
        m = _TAG_END.match(src, open_ + 1)
        if not m:
            break
        at = m.end()
        inner = src[open_ + 1 : at - 1]
        kind, body = ("close", inner[1:]) if inner[:1] == b"/" else ("empty", inner[:-1]) if inner[-1:] == b"/" else ("open", inner)
        name = _NAME.match(body)[0]
        if name:
            tags.append(Tag(name.decode("utf-8", "replace"), kind, open_, at))
    return tags, others


def attributes(src: bytes, tag: Tag) -> list[tuple[str, str, int, int]]:
    """(name, value, start, end) of a tag's attributes, each with the space before it; the first odd one ends the list."""
    raw, out = src[tag.start : tag.end], []
    space = _SPACE.search(raw)
    at = space.start() if space else len(raw)
    while m := _ATTRIBUTE.match(raw, at):
        value = m[3] if m[3] is not None else m[4]
        out.append((m[2].decode("utf-8", "replace"), value.decode("utf-8", "replace"), tag.start + at, tag.start + m.end()))
        at = m.end()
    return out


def span(tags: list[Tag], i: int) -> tuple[int, int] | None:
    """Start and end of an element, its own name nested or not; None where it is not closed."""
    if tags[i].kind == "empty":
        return tags[i].start, tags[i].end
    depth = 1
    for t in tags[i + 1 :]:
        if t.name == tags[i].name and t.kind != "empty":
            depth += 1 if t.kind == "open" else -1
            if not depth:
                return tags[i].start, t.end
    return None


def leaf(tags: list[Tag], i: int) -> tuple[int, int] | None:
    """The range of an element's text, if its end tag comes next."""
    n = tags[i + 1] if i + 1 < len(tags) else None
    return (tags[i].end, n.start) if n and n.kind == "close" and n.name == tags[i].name else None


def local(name: str) -> str:
    return name.split(":", 1)[-1].lower()


def kind_of(name: str, above: list[str] = ()) -> str:
    part = local(name)
    if part in PEOPLE or any(local(a) in PEOPLE for a in above):
        return "personal-identity"
    if part in TIMES or part.endswith(("date", "time")):
        return "timestamp"
    return "comment" if part in TEXTS else "software-fingerprint"


def foreign(name: str) -> bool:
    return ":" in name and name.split(":", 1)[0] not in PREFIXES


def data_uri(value: str) -> tuple[str, bool, str] | None:
    """(media type, whether base64, payload) of a data URI."""
    m = re.match(r"\s*data:([^,]*),(.*)\Z", value, re.S | re.I)
    if not m:
        return None
    parts = [p.strip() for p in m[1].split(";")]
    return parts[0], any(p.lower() == "base64" for p in parts[1:]), m[2]


def external(value: str) -> bool:
    text = value.strip()
    return bool(text) and not text.startswith("#") and data_uri(text) is None


def picture(data: bytes) -> str | None:
    """The format of a picture that may be in another file."""
    magics = {"jpeg": b"\xff\xd8\xff", "png": b"\x89PNG\r\n\x1a\n", "gif": b"GIF8", "tiff": b"II*\0"}
    if data[:4] == b"RIFF" and data[8:12] == b"WEBP":
        return "webp"
    return "tiff" if data[:4] == b"MM\0*" else next((k for k, m in magics.items() if data.startswith(m)), None)


def stripped_copy(kind: str, data: bytes) -> tuple[bytes, list[dict], list[dict]]:
    """One file's clean bytes, items and notes by the rule tables, inside the worker: for pictures in other files."""
    rows, error = walk({**SIMPLE, **REBUILDERS}[kind], data)
    if error:
        raise Doubt(error["detail"], None, error["error_kind"], error["unsupported_kind"], error["limit"])
    rules = {(f, k): (a, n, p) for f, k, a, n, p in dims.RULES}
    out, items, notes = [], [], []
    for s in rows:
        rule = rules.get((kind, s["key"])) or rules[kind, "*ancillary" if kind == "png" and s["key"][:1].islower() else "*"]
        if rule[0] in ("drop", "rewrite", "zero", "itemised"):
            items += s["items"] or ([item(f"kind:{rule[1]}", "", rule[2] or s["location"] or s["key"], s["size"])] if rule[0] == "drop" else [])
        if rule[0] not in ("drop", "silent", "itemised"):
            out.append(data[s["off"] : s["off"] + s["len"]] if s["replace"] is None else s["replace"])
        notes += s["notes"]
    body = b"".join(out)
    return (b"RIFF" + (len(body) + 4).to_bytes(4, "little") + data[8:12] + body if kind == "webp" else body), items, notes


class Drawing:
    def __init__(self, src: bytes):
        self.src, self.edits, self.held, self.notes, self.outside = src, [], [], [], 0
        self.tags, self.others = scan(src)

    def cut(self, start: int, end: int, *items: dict, replace: bytes | None = None) -> None:
        self.edits.append((start, -end, replace, list(items)))

    def found(self, kind: str, place: str, field: str, size: int, text: str) -> dict:
        return item(f"kind:{kind}", field, place, size, clean(text.encode()).strip())

    def hold(self, place: str) -> None:
        if place not in self.held:
            self.held.append(place)

    def refer(self, element: str, attribute: str) -> None:
        self.outside += 1
        self.hold(f"<{element} {attribute}> (a reference outside this document)")

    def refuse_script(self) -> None:
        raise Doubt(None, None, "unsupported-format", "scripted-svg")

    def run(self) -> None:
        for kind, a, b in self.others:
            text = self.src[a:b].decode()
            if kind == "comment":
                self.cut(a, b, self.found("comment", "<!-- -->", "", b - a, text))
            elif kind == "instruction" and not re.match(r"<\?xml([\s?]|$)", text):
                self.cut(a, b, self.found("software-fingerprint", "<? ?>", "", b - a, text))
            elif kind == "doctype" and "[" in text:
                raise Doubt("unsupported-feature", a)
        past = 0
        for i, t in enumerate(self.tags):
            if t.start < past or t.kind == "close":
                continue
            if t.name in SCRIPTS:
                self.refuse_script()
            whole = span(self.tags, i) if foreign(t.name) or t.name == "metadata" else None
            if whole:
                past, text = whole[1], self.src[slice(*whole)].decode()
                items = self.metadata(*whole) if t.name == "metadata" else [self.found(kind_of(t.name), f"<{t.name}>", "", whole[1] - whole[0], text)]
                self.cut(*whole, *items)
                continue
            if t.name in ACCESSIBLE and (inner := leaf(self.tags, i)) and self.src[slice(*inner)].strip():
                self.hold_text(t.name)
            elif t.name == "style" and (inner := leaf(self.tags, i)):
                self.style(*inner)
            self.attributes(t)
        if self.outside:
            self.notes.append({"location": f"{self.outside} reference(s) to files outside this document", "bytes": None})

    def hold_text(self, name: str) -> None:
        self.held.append(f"<{name}>")
        self.notes.append({"location": f"<{name}> (accessibility text, which can name its author)", "bytes": None})

    def style(self, start: int, end: int) -> None:
        for m in _STYLE_COMMENT.finditer(self.src[start:end]):
            if m[1] is None:
                self.cut(start + m.start(), start + m.end(), self.found("comment", "<style> (/* */)", "", m.end() - m.start(), m[0].decode("utf-8", "replace")))
        for target in _URL.findall(self.src[start:end].decode()):
            if external(target.strip().strip("\"'")):
                self.refer("style", "url()")

    def metadata(self, start: int, end: int) -> list[dict]:
        inner, above, out = self.src[start:end], [], []
        tags, _ = scan(inner)
        for i, t in enumerate(tags):
            if t.kind == "close":
                if above and above[-1] == t.name:
                    above.pop()
                continue
            for name, value, _, _ in attributes(inner, t):
                if not name.startswith("xmlns") and value.strip():
                    out.append(self.found(kind_of(name), "<metadata>", f"{t.name} {name}", len(value.encode()), value))
            text = leaf(tags, i)
            if text and inner[slice(*text)].strip():
                out.append(self.found(kind_of(t.name, above), "<metadata>", t.name, text[1] - text[0], inner[slice(*text)].decode()))
            if t.kind == "open":
                above.append(t.name)
        return out or [self.found("other", "<metadata>", "", end - start, inner.decode())]

    def attributes(self, t: Tag) -> None:
        for name, value, a, b in attributes(self.src, t):
            if re.fullmatch("on[0-9A-Za-z]+", name):
                self.refuse_script()
            if name.startswith("xmlns:"):
                if name[6:] not in PREFIXES:
                    self.cut(a, b, self.found("software-fingerprint", f"<{t.name} {name}>", name, b - a, value))
            elif foreign(name):
                self.cut(a, b, self.found(kind_of(name), f"<{t.name} {name}>", name, b - a, value))
            elif name in REFERENCES:
                self.reference(t, name, value, a, b)
            elif "url(" in value:
                for target in (x.strip().strip("\"'") for x in _URL.findall(value)):
                    if target.lstrip().lower().startswith("javascript:"):
                        self.refuse_script()
                    if external(target):
                        self.refer(t.name, name)

    def reference(self, t: Tag, name: str, value: str, a: int, b: int) -> None:
        if value.lstrip().lower().startswith("javascript:"):
            self.refuse_script()
        uri = data_uri(value)
        if uri is None:
            if external(value):
                self.refer(t.name, name)
            return
        place, (media, coded, payload) = f"<{t.name} {name}> (data: URI)", uri
        try:
            data = base64.b64decode(re.sub(r"\s", "", payload), validate=True) if coded else None
        except ValueError:
            data = None
        kind = picture(data) if data is not None else None
        if kind is None:
            if data is not None and (data.startswith((b"PK\3\4", b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1")) or b"%PDF-" in data[:1024] or data.lstrip().startswith(b"<svg")):
                raise Doubt("unsupported-feature", a)
            self.notes.append({"location": place, "bytes": len(payload.encode()) if data is None else len(data)})
            return
        made, items, notes = stripped_copy(kind, data)
        self.notes += notes
        if made != data or items:
            quote = "'" if self.src[a:b].rstrip().endswith(b"'") else '"'
            self.cut(a, b, *[{**x, "location": f"{place} {x['location']}"} for x in items], replace=f" {name}={quote}data:{media};base64,{base64.b64encode(made).decode()}{quote}".encode())


def svg(data: bytes, w: Walk) -> None:
    try:
        data.decode()
    except UnicodeDecodeError as e:
        raise Doubt("unsupported-feature", e.start) from None
    d = Drawing(data)
    w.left -= len(d.tags)
    if w.left < 0:
        raise Doubt(None, None, "limit-exceeded", limit="item-count")
    d.run()
    at = 0
    for start, end, replace, items in sorted(d.edits, key=lambda e: e[:2]):
        if start < at:  # inside a cut that is made already
            w.rows[-1]["items"] += items
            continue
        if start > at:
            w.add("text", at, start - at)
        at = -end
        w.add("cut" if replace is None else "embedded", start, at - start, at - start, items, replace=replace)
    if at < len(data):
        w.add("text", at, len(data) - at)
    for place in d.held:
        w.add("held", len(data), 0, 0, location=place)
    if d.notes:
        w.add("text", len(data), 0, 0, notes=d.notes)


WALKERS = {"svg": svg}

cloudpickle.register_pickle_by_value(sys.modules[__name__])
