"""Packages: text documents, sheets and presentations of two families, as tables of their parts.

A package is exploded into one row for each part. What a part is comes from the package's own index (a join by file), which
relationships are dead from the relationship parts (a join by file and part), and pictures go through the engine as files of
their own, one level deep. What is left of a package is its parts in order, which one shuffle by file brings together again.
Python opens archives, scrubs one part's markup and lays archives out; every decision between parts is relational.
"""

from __future__ import annotations

import struct
import sys
import zlib

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import dims
from ..functions.detect import detected, fenced, may_be_picture
from ..sources import archives
from ..sources.shared import grown, pieces, released, written
from . import engine, guard, markup
from .walkers import MOST_ITEMS, Doubt, clean, item

#: Bytes that a package may expand to.
MOST_BYTES = 256 << 20
#: Parts that are taken from Arrow at a time when archives are laid out, and the bytes of archives that are passed on together.
PART_ROWS, DONE_BYTES = 100, 4 << 20
PARTS = (
    f"file_id string, format string, part_no int, name string, raw_name binary, method int, flags int, crc bigint, size bigint, "
    f"packed binary, data binary, stamped boolean, host boolean, failure {engine.ERROR}"
)


# --- archives ----------------------------------------------------------------------------------------------------------


def open_parts(data: bytes) -> list[tuple]:
    """(name, raw name, method, flags, crc, size, packed, content, stamped, host) of the entries, by the archive's directory; packed is None where it is the content."""
    read = lambda at, n: data[at : at + n]
    out, left, seen = [], MOST_BYTES, set()
    try:
        for e in archives.listed(read, len(data), MOST_ITEMS):
            if e.raw in seen:
                raise Doubt("duplicate-entry", e.at)
            seen.add(e.raw)
            packed = archives.packed_of(read, len(data), e.at, e.packed)
            content = None if e.raw.endswith(b"/") else archives.expanded(e.method, packed, e.size, e.crc, left)
            left -= len(content or b"")
            same = e.method == 0 and content is not None  # stored: what is packed is the content, which is passed on once
            out.append((e.name, e.raw, e.method, e.flags, e.crc, e.size, None if same else packed, content, e.stamped, e.host))
    except archives.Refused as e:
        raise (Doubt(None, None, "limit-exceeded", limit=e.limit) if e.limit else Doubt(e.detail, e.offset)) from None
    return out


def archive(entries: list[tuple[bytes, int, int, int, int, bytes]]) -> bytes:
    """(name, method, flags, crc, size, packed) -> an archive without times, extra fields or comments."""
    body, directory = b"", b""
    chunks, at = [], 0
    for name, method, flags, crc, size, packed in entries:
        facts = struct.pack("<HHHHIIIHH", flags, method, 0, 33, crc, len(packed), size, len(name), 0)
        local = b"PK\3\4" + struct.pack("<H", 20) + facts + name
        directory += b"PK\1\2" + struct.pack("<HH", 20, 20) + facts + struct.pack("<HHHII", 0, 0, 0, 0, at) + name
        chunks += [local, packed]
        at += len(local) + len(packed)
    body = b"".join(chunks)
    return body + directory + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, len(entries), len(entries), len(directory), len(body), 0)


def _open(batches):
    import pyarrow as pa

    for b in guard.lots(batches):
        rows = []
        for file_id, form, content in zip(*(b.column(c).to_pylist() for c in ("file_id", "format", "content")), strict=True):
            try:
                rows += [(file_id, form, i, *p, None) for i, p in enumerate(open_parts(content or b""))]
            except Doubt as e:
                rows.append((file_id, form, 0, *[None] * 10, e.row))
        columns = zip(*rows, strict=True) if rows else [[]] * len(_NAMES)
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for f, c in zip(_arrow(), columns, strict=True)], schema=_arrow())


_NAMES = [c.strip().split()[0] for c in PARTS.split("failure")[0].rstrip(" ,").split(",")] + ["failure"]


def _arrow():
    import pyarrow as pa

    text = pa.string()
    error = pa.struct([("error_kind", text), ("detail", text), ("offset", pa.int64()), ("limit", text), ("unsupported_kind", text)])
    kinds = [text, text, pa.int32(), text, pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.bool_(), pa.bool_(), error]
    return pa.schema(list(zip(_NAMES, kinds, strict=True)))


def parts(files: DataFrame) -> DataFrame:
    """files (file_id, format, content) of package formats -> PARTS: one row for each part, or one with the failure of the archive."""
    return files.where(F.col("format").isin(*dims.PACKAGES)).select("file_id", "format", "content").mapInArrow(_open, PARTS)


# --- what the index says -------------------------------------------------------------------------------------------------


def text_of(data: Column) -> Column:
    """A part as text, null where it is not UTF-8."""
    return F.try_validate_utf8(data.cast("string"))


def tags(text: Column, name: str) -> Column:
    """The start tags of an element."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(rf"""<{name}\b(?:[^<>"']|"[^"]*"|'[^']*')*>"""), F.lit(0)), F.array().cast("array<string>"))


def attribute(tag: Column, name: str) -> Column:
    """An attribute's value in a tag, empty where it has none."""
    return F.regexp_extract(tag, rf"""\s{name}\s*=\s*["']([^"']*)["']""", 1)


def plain(name: Column) -> Column:
    return F.regexp_replace(name, "^/", "")


#: Parts that say what a package is.
INDEXES = ("[Content_Types].xml", "_rels/.rels", "META-INF/manifest.xml", "mimetype")


def indexed(rows: DataFrame, n: int) -> DataFrame:
    """(file_id, format, failure, types, rels): each package's index and, if any, why it is refused.

    The rows that are sorted by file hold the text of index parts only, in n pieces.
    """
    data, name = F.col("data"), F.col("name")
    nested = F.startswith(data, F.unhex(F.lit("D0CF11E0A1B11AE1"))) | F.startswith(data, F.unhex(F.lit("504B0304"))) | (F.locate("%PDF-", F.substring(data, 1, 1024).cast("string")) > 0)
    text = F.when(name.isin(*INDEXES), F.coalesce(text_of(data), F.lit("\0")))  # NUL: it is there, but is no text
    each = fenced(rows, __nested=F.coalesce(nested, F.lit(False)), __text=text).select("file_id", "format", "part_no", "name", "failure", "__nested", "__text")
    each = each.where("part_no = 0 OR failure IS NOT NULL OR __nested OR __text IS NOT NULL")  # the others say nothing of their package
    held = lambda part: F.max(F.when(name == part, F.col("__text")))
    per = each.repartition(n, "file_id").groupBy("file_id", "format").agg(
        F.first("failure", ignorenulls=True).alias("broken"), F.bool_or("__nested").alias("nested"), *[held(part).alias(c) for part, c in zip(INDEXES, ("types", "rels", "manifest"), strict=False)], F.trim(held("mimetype")).alias("media"),
    )
    root = F.get(F.filter(tags(F.col("manifest"), "manifest:file-entry"), lambda t: attribute(t, "manifest:full-path") == "/"), F.lit(0))
    per = fenced(per, root=F.nullif(attribute(root, "manifest:media-type"), F.lit("")), declared=F.transform(tags(F.col("types"), "Override"), lambda t: attribute(t, "ContentType")))
    main = F.create_map(*[F.lit(x) for kv in dims.OFFICE_MAIN.items() for x in kv])
    media = F.create_map(*[F.lit(x) for kv in dims.ODF_MEDIA.items() for x in kv])
    odf = F.col("format").isin(*dims.ODF_MEDIA.values())
    declared = F.get(F.filter(F.transform("declared", lambda t: F.try_element_at(main, t)), lambda x: x.isNotNull()), F.lit(0))
    index = F.when(odf, F.col("manifest")).otherwise(F.col("types"))
    detail = (
        F.when(index.isNull(), "missing-marker").when(index == "\0", "broken-index")
        .when(odf & (F.size(tags(F.col("manifest"), "manifest:encryption-data")) > 0), "unsupported-feature").when(odf & (F.col("media") != F.col("root")), "broken-index")
        .when(~F.coalesce(F.when(odf, F.try_element_at(media, F.coalesce("media", "root"))).otherwise(declared) == F.col("format"), F.lit(False)), "missing-marker").when(F.col("nested"), "unsupported-feature")
    )
    none = F.lit(None).cast("string")
    failed = F.struct(F.lit("malformed").alias("error_kind"), detail.alias("detail"), F.lit(None).cast("bigint").alias("offset"), none.alias("limit"), none.alias("unsupported_kind"))
    per = fenced(per, failure=F.coalesce("broken", F.when(detail.isNotNull(), failed)))
    return per.select("file_id", "format", "failure", "types", "rels")


def named_types(per: DataFrame, tag: str, key: str, clean_key, n: int) -> DataFrame:
    """(file_id, k, type): what an index says of each part name or extension, the first where it says so twice."""
    each = per.select("file_id", F.posexplode(tags(F.col("types"), tag)).alias("i", "t"))
    each = each.select("file_id", "i", clean_key(attribute(F.col("t"), key)).alias("k"), attribute(F.col("t"), "ContentType").alias("type"))
    return each.repartition(n, "file_id", "k").groupBy("file_id", "k").agg(F.min_by("type", "i").alias("type"))


def dead_relations(rows: DataFrame) -> DataFrame:
    """(file_id, name, dead): ids of relationships to a local path, for the part that owns them and for the part that lists them."""
    rels = rows.where(F.lower("name").endswith(".rels")).select("file_id", "name", F.explode(tags(text_of(F.col("data")), "Relationship")).alias("t"))
    target = attribute(F.col("t"), "Target")
    local = target.startswith("file:") | target.startswith("\\\\") | (F.substring(target, 2, 1) == ":")
    rels = rels.where((attribute(F.col("t"), "TargetMode") == "External") & local).select("file_id", "name", attribute(F.col("t"), "Id").alias("id"))
    owner = F.regexp_extract("name", r"^(.*?)_rels/([^/]+)\.rels$", 1)
    owned = rels.where(F.rlike("name", F.lit(r"(^|/)_rels/[^/]+\.rels$"))).select("file_id", F.concat(owner, F.regexp_extract("name", r"_rels/([^/]+)\.rels$", 1)).alias("name"), "id")
    return rels.unionByName(owned).groupBy("file_id", "name").agg(F.collect_set("id").alias("dead"))


def judged(rows: DataFrame, indexes: DataFrame, n: int) -> DataFrame:
    """Parts of packages that are not refused, with role, type and the ids of dead relationships; only ids and names are joined, then bytes once.

    role: folder, index, drop, image, xml, opaque, first (the part that names the format, stored and in front). Both sides of a join lie in
    n pieces, which the planner does not put together: what they take on disk says little of what a task then sorts.
    """
    per = indexes.where("failure IS NULL")
    keys = rows.select("file_id", "part_no", "name", F.lower(F.regexp_extract("name", r"\.([^.]*)$", 1)).alias("extension"))
    by_name = named_types(per, "Override", "PartName", plain, n).withColumnRenamed("k", "name")
    by_extension = named_types(per, "Default", "Extension", F.lower, n).withColumnsRenamed({"k": "extension", "type": "otherwise"})
    shown = per.select("file_id", F.explode(tags(F.col("rels"), "Relationship")).alias("t")).where(attribute(F.col("t"), "Type") == dims.THUMBNAIL_RELATION)
    shown = shown.select("file_id", plain(attribute(F.col("t"), "Target")).alias("name"), F.lit(True).alias("thumbnail")).distinct()
    keys = keys.repartition(n, "file_id", "name")
    for facts in (by_name, shown, dead_relations(rows)):
        keys = keys.join(grown(facts), ["file_id", "name"], "left")
    keys = keys.repartition(n, "file_id", "extension").join(grown(by_extension), ["file_id", "extension"], "left")
    keys = keys.repartition(n, "file_id").join(grown(per.select("file_id")), "file_id")
    keys = keys.select("file_id", "part_no", F.coalesce("type", "otherwise").alias("type"), F.coalesce("thumbnail", F.lit(False)).alias("thumbnail"), "dead")
    named = rows.repartition(n, "file_id", "part_no").join(grown(keys), ["file_id", "part_no"])
    odf = F.col("format").isin(*dims.ODF_MEDIA.values())
    whole = F.lit(None).cast("string")
    leaf = F.regexp_extract("name", "([^/]*)$", 1)
    for test, kind in [(F.startswith("name", F.lit(p)), k) for p, k in dims.ODF_FOLDERS.items()] + [(leaf == n, k) for n, k in dims.ODF_PARTS.items()]:
        whole = F.coalesce(whole, F.when(test, kind))
    properties = F.try_element_at(F.create_map(*[F.lit(x) for kv in dims.OFFICE_PROPERTIES.items() for x in kv]), F.col("type"))
    properties = F.coalesce(properties, F.when(F.col("thumbnail"), F.lit("")))
    gone = F.when(odf, whole).otherwise(properties)
    named = fenced(named, gone=F.when(F.col("name").isin("[Content_Types].xml", "_rels/.rels") & ~odf, None).otherwise(gone))
    index = F.when(odf, F.col("name") == "META-INF/manifest.xml").otherwise(F.col("name").isin("[Content_Types].xml", "_rels/.rels"))
    named = fenced(named, __picture=F.when(may_be_picture(F.col("data")), F.col("data")))  # most parts are markup, which no other test need look at
    seen = detected(named.withColumnRenamed("format", "__package_format"), "__picture").withColumnRenamed("format", "picture").drop("unsupported_kind", "error_kind", "__picture")
    seen = seen.withColumnRenamed("__package_format", "format")
    role = (
        F.when(odf & (F.col("name") == "mimetype"), "first").when(index, "index").when(F.col("gone").isNotNull(), "drop").when(F.col("data").isNull(), "folder")
        .when(F.col("picture").isin(*dims.EMBEDDED), "image").when(F.col("name").isNotNull() & text_of(F.col("data")).isNotNull(), "xml").otherwise("opaque")
    )
    return fenced(seen, role=role).drop("thumbnail")


# --- one part's markup ---------------------------------------------------------------------------------------------------


def cut(src: bytes, cuts: list[tuple[int, int]]) -> bytes | None:
    """src without these ranges, overlapping or not; None where there are none."""
    out, at = [], 0
    for a, b in sorted(cuts):
        out.append(src[at : max(a, at)])
        at = max(at, b)
    return b"".join(out) + src[at:] if cuts else None


class Removed:
    """Bytes by name, in order of first occurrence, as items of one part."""

    def __init__(self, part: str):
        self.part, self.found = part, {}

    def add(self, name: str, kind: str, start: int, end: int, text: str | None) -> tuple[int, int]:
        old = self.found.setdefault(name, [kind, 0, text])
        old[1] += end - start
        return start, end

    def items(self) -> list[dict]:
        return [item(f"kind:{k}", name, self.part, n, t) for name, (k, n, t) in self.found.items()]


def office_part(src: bytes, part: str, dead: set[str]) -> tuple[bytes | None, list[dict], list[str]]:
    """Revision ids, authorship and dead relationships of an office part: what is left, what was there, and notes."""
    found, _ = markup.scan(src)
    removed, cuts = Removed(part), []
    value = lambda a, b: clean(src[a:b])
    for i, t in enumerate(found):
        if t.name == "w:rsids" and t.kind != "close":
            if span := markup.span(found, i):
                cuts.append(removed.add("w:rsids", "editing-history", *span, None))
            continue
        if t.name == "author" and t.kind == "open" and "comments" in part:
            if (leaf := markup.leaf(found, i)) and leaf[0] < leaf[1]:
                cuts.append(removed.add("author", "personal-identity", *leaf, value(*leaf)))
            continue
        if t.kind == "close":
            continue
        named = markup.attributes(src, t)
        for name, text, a, b in named:
            kind = dims.OFFICE_ATTRIBUTES.get(name) or dims.OFFICE_ATTRIBUTES.get(f"{t.name} {name}")
            if kind:
                cuts.append(removed.add(name, kind, a, b, text))
        values = {n: (v, a, b) for n, v, a, b in reversed(named)}
        if t.name == "Relationship" and values.get("Id", ("",))[0] in dead:
            cuts.append(removed.add("Relationship (external local path)", "personal-identity", t.start, t.end, values.get("Target", ("",))[0]))
        elif "r:id" in values and values["r:id"][0] in dead:
            cuts.append((t.start, t.end) if t.kind == "empty" else values["r:id"][1:])
            removed.add("r:id (to an external local path)", "personal-identity", t.start, t.end, None)
    notes = [f"{part} (tracked changes; their authors and dates were removed)"] if b"<w:ins " in src or b"<w:del " in src else []
    notes += [f"{part} (comment text; its authors and dates were removed)"] if part.endswith("comments.xml") else []
    return cut(src, cuts), removed.items(), notes


def open_part(src: bytes, part: str) -> tuple[bytes | None, list[dict], list[str] | None]:
    """Attributions inside annotations and changes, and cached fields; notes None: the markup does not nest."""
    found, _ = markup.scan(src)
    removed, cuts, above = Removed(part), [], []
    for i, t in enumerate(found):
        if t.kind == "open":
            kind = dims.ODF_ATTRIBUTION.get(t.name) if {"office:annotation", "office:change-info"} & set(above) else None
            kind = kind or dims.ODF_FIELDS.get(t.name)
            range_ = (markup.leaf(found, i) or markup.span(found, i)) if kind else None
            if range_ and range_[0] < range_[1]:
                cuts.append(removed.add(t.name, kind, *range_, clean(src[range_[0] : range_[1]])))
            above.append(t.name)
        elif t.kind == "close" and (not above or above.pop() != t.name):
            return None, [], None
    notes = [f"{part} (tracked changes; their authors and dates were removed)"] if b"<text:tracked-changes" in src or b"<table:tracked-changes" in src else []
    notes += [f"{part} (comment text; its authors and dates were removed)"] if b"<office:annotation" in src else []
    notes += [f"{part} (a date or time field the document displays)"] if any(f"<text:{f}".encode() in src for f in dims.ODF_DISPLAYED) else []
    return cut(src, cuts), removed.items(), notes


def without_entries(src: bytes, tag: str, key: str, dropped: set[str]) -> bytes | None:
    """An index without its tags for dropped parts."""
    found, _ = markup.scan(src)
    return cut(src, [(t.start, t.end) for t in found if t.name == tag and {n: v for n, v, *_ in markup.attributes(src, t)}.get(key, "\0").removeprefix("/") in dropped])


def dropped_items(src: bytes | None, part: str, kind: str, odf: bool) -> list[dict]:
    """What a dropped part told, element by element; else one item for the part."""
    out, leafname = [], part.rsplit("/", 1)[-1]
    try:
        src.decode()
        found, _ = markup.scan(src)
    except (UnicodeDecodeError, AttributeError):
        return [item("kind:thumbnail" if not odf else f"kind:{kind}", "", part, len(src or b""), None, len(src or b"") if odf else None)]
    if odf and leafname == "settings.xml":
        return _settings(src, found, part)
    if odf and leafname != "meta.xml":
        return [item(f"kind:{kind}", "", part, len(src), None, len(src))]
    for i, t in enumerate(found):
        if t.kind == "close":
            continue
        own = {n: v for n, v, *_ in markup.attributes(src, t)}
        range_ = markup.leaf(found, i)
        text = clean(src[range_[0] : range_[1]]) if range_ else ""
        n = range_[1] - range_[0] if range_ else 0
        if odf and t.name == "meta:document-statistic":
            out += [item("kind:other", name, part, len(v.encode()), v) for name, v in own.items()]
        elif odf and t.name == "meta:template":
            out += [item("kind:personal-identity", "meta:template xlink:href", part, len(own["xlink:href"].encode()), own["xlink:href"])] if "xlink:href" in own else []
        elif odf and t.name == "meta:user-defined":
            out.append(item("kind:personal-identity", f"meta:user-defined ({own.get('meta:name', 'meta:user-defined')})", part, n, text))
        elif text.strip() and (t.name in dims.ODF_META or not odf):
            out.append(item(f"kind:{dims.ODF_META[t.name] if odf else dims.OFFICE_ELEMENTS.get(t.name, kind or 'other')}", t.name, part, n, text))
    return out or [item(f"kind:{kind or 'other'}", "", part, len(src), None, len(src) if odf else None)]


def _settings(src: bytes, found: list, part: str) -> list[dict]:
    out, n = [], 0
    for i, t in enumerate(found):
        if t.name == "config:config-item" and t.kind != "close":
            n += 1
            name = {k: v for k, v, *_ in markup.attributes(src, t)}.get("config:name")
            if name in dims.ODF_SETTINGS:
                a, b = markup.leaf(found, i) or (0, 0)
                out.append(item(f"kind:{dims.ODF_SETTINGS[name]}", f"config:config-item ({name})", part, b - a, clean(src[a:b])))
    return [*out, item("kind:software-fingerprint", "config:config-item", part, n)]


SCRUBBED = f"file_id string, part_no int, new binary, items array<{engine.ITEM}>, notes array<{engine.NOTE}>"


def scrubbed_part(form: str, role: str, name: str | None, data: bytes | None, kind: str, dead: set, dropped: set) -> tuple:
    """(new content or None, items, notes) of one part."""
    odf = form in dims.ODF_MEDIA.values()
    if role == "drop":
        return None, [] if data is None else dropped_items(data, name, kind, odf), []
    if role == "opaque":
        place = name if name is not None else "an entry whose name is not valid UTF-8"
        return None, [], [{"location": place, "bytes": len(data)}]
    if role == "index" and odf:
        return without_entries(data, "manifest:file-entry", "manifest:full-path", dropped), [], []
    if role == "index":
        base = without_entries(data, "Override", "PartName", dropped) or data
        base = without_entries(base, "Relationship", "Target", dropped) or base
        new, items, notes = office_part(base, name, dead)
        return new or (base if base is not data else None), items, [{"location": n, "bytes": None} for n in notes]
    new, items, notes = open_part(data, name) if odf else office_part(data, name, dead)
    if notes is None:
        return None, [], [{"location": f"{name} (markup the scanner could not follow)", "bytes": len(data)}]
    return new, items, [{"location": n, "bytes": None} for n in notes]


def _scrub(items_type, notes_type):
    def scrub(batches):
        import pyarrow as pa

        for b in guard.lots(batches):
            columns = {c: b.column(c).to_pylist() for c in ("format", "role", "name", "data", "gone", "dead", "dropped")}
            for c in ("dead", "dropped"):
                columns[c] = [frozenset(x or ()) for x in columns[c]]
            first: dict = {}  # equal parts are looked into once
            places = [first.setdefault(part, len(first)) for part in zip(*columns.values(), strict=True)]
            rows = [scrubbed_part(*part) for part in first]
            made = [pa.array([r[i] for r in rows], k) for i, k in enumerate((pa.binary(), items_type, notes_type))]
            if len(first) < len(places):
                made = [m.take(pa.array(places, pa.int32())) for m in made]
            yield pa.RecordBatch.from_arrays([b.column("file_id"), b.column("part_no"), *made], names=["file_id", "part_no", "new", "items", "notes"])

    return scrub


def scrubbed(rows: DataFrame) -> DataFrame:
    """judged parts -> SCRUBBED of those that are looked into as markup, dropped, or passed over."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(T._parse_datatype_string(f"array<{t}>")) for t in (engine.ITEM, engine.NOTE)]
    none = F.array().cast("array<string>")
    gone = rows.where("role = 'drop'").groupBy("file_id").agg(F.collect_set("name").alias("dropped"))
    indexes = rows.where("role = 'index'").join(grown(gone), "file_id", "left")
    others = rows.where("role IN ('drop', 'opaque', 'xml')").withColumn("dropped", none)
    # Empty arrays, not nulls: before each row Spark asks for a batch's size, and Arrow then goes over all rows since the last that has an array.
    lists = [F.coalesce(c, none).alias(c) for c in ("dead", "dropped")]
    each = [x.select("file_id", "part_no", "format", "role", "name", "data", "gone", *lists) for x in (others, indexes)]
    return each[0].unionByName(each[1]).mapInArrow(_scrub(*kinds), SCRUBBED)


# --- reports and output --------------------------------------------------------------------------------------------------


class Package:
    """The tables of a batch of packages: findings, notes, errors and stripped, shaped like the engine's.

    Archives are opened once, and each part is looked into once: both results are written to the shared folder, and
    release() removes them.
    """

    def __init__(self, files: DataFrame):
        self.files, self.parts = files, written(parts(files), "parts")
        held = self.parts.agg(F.count("*"), F.sum("size")).first()
        self.pieces = pieces(files.sparkSession, held[0], held[1] or 0)
        self.indexes = written(indexed(self.parts, self.pieces), "package-indexes")
        self.rows = written(judged(self.parts, self.indexes, self.pieces), "judged-parts")
        self.scrubbed = written(scrubbed(self.rows), "scrubbed-parts")
        images = self.rows.where("role = 'image'").select(F.concat_ws("\1", "file_id", F.col("part_no").cast("string")).alias("file_id"), F.col("name").alias("path"), F.octet_length("data").cast("long").alias("length"), F.col("data").alias("content"))
        self.images = written(engine.decided(images), "pictures")

    def release(self) -> None:
        released(self.parts, self.indexes, self.rows, self.scrubbed, self.images)

    @staticmethod
    def _inner(rows: DataFrame) -> DataFrame:
        """file_id of an inner picture -> that of its package, and the number of its part."""
        return rows.withColumns({"part_no": F.split_part("file_id", F.lit("\1"), F.lit(2)).cast("int"), "file_id": F.split_part("file_id", F.lit("\1"), F.lit(1))})

    def errors(self) -> DataFrame:
        refused = self.indexes.where("failure IS NOT NULL").select("file_id", "format", "failure")
        inner = self._inner(self.images.where("error IS NOT NULL").select("file_id", "error")).groupBy("file_id").agg(F.min_by("error", "part_no").alias("failure"))
        inner = inner.join(grown(self.indexes.select("file_id", "format")), "file_id").select("file_id", "format", "failure")
        return refused.unionByName(inner).select("file_id", "failure.error_kind", "format", "failure.detail", "failure.offset", "failure.limit", "failure.unsupported_kind")

    def _sound(self, rows: DataFrame) -> DataFrame:
        return rows.join(grown(self.errors().select("file_id").distinct()), "file_id", "left_anti")

    def findings(self, values: bool = False) -> DataFrame:
        own = self.scrubbed.select("file_id", "part_no", F.posexplode("items").alias("i", "x"))
        none = F.lit(None)
        own = own.select("file_id", "part_no", "i", F.substr("x.scope", F.lit(6)).alias("kind"), "x.location", F.nullif("x.name", F.lit("")).alias("field"), "x.bytes", F.col("x.text").alias("value_text"), F.col("x.opaque").alias("value_opaque_bytes"))
        names = self.rows.where("role = 'image'").select("file_id", "part_no", "name")
        inner = self._inner(engine.findings(self.images, True)).join(grown(names), ["file_id", "part_no"])
        inner = inner.select("file_id", "part_no", F.col("seq").alias("i"), "kind", F.concat("name", F.lit(" → "), "location").alias("location"), "field", "bytes", "value_text", "value_opaque_bytes")
        counts = self.rows.groupBy("file_id").agg(F.count_if("stamped").alias("a"), F.count_if("host").alias("b"))
        last = F.array(*[F.struct(F.lit(k).alias("kind"), F.lit(p).alias("location"), F.col(c).alias("bytes")) for k, p, c in (("timestamp", "ZIP entry headers", "a"), ("device-identity", "ZIP entry extra fields", "b"))])
        last = counts.select("file_id", F.posexplode(F.filter(last, lambda x: x["bytes"] > 0)).alias("i", "x"))
        last = last.select("file_id", F.lit(1 << 30).alias("part_no"), "i", "x.kind", "x.location", none.cast("string").alias("field"), "x.bytes", none.cast("string").alias("value_text"), none.cast("bigint").alias("value_opaque_bytes"))
        every = self._sound(own.unionByName(inner).unionByName(last).repartition(self.pieces, "file_id")).join(grown(self.indexes.select("file_id", "format")), "file_id")
        from pyspark.sql import Window

        seq = (F.row_number().over(Window.partitionBy("file_id").orderBy("part_no", "i")) - 1).alias("seq")
        return every.select("file_id", "format", seq, "kind", "location", "field", "bytes", *(["value_text", "value_opaque_bytes"] if values else []))

    def notes(self) -> DataFrame:
        own = self.scrubbed.select("file_id", F.explode("notes").alias("n"))
        own = own.select("file_id", F.when(F.col("n.bytes").isNull(), "out-of-scope-content").otherwise("unparsed-region").alias("note"), "n.location", "n.bytes", F.lit(None).cast("string").alias("capability"))
        changed = engine.findings(self.images).select("file_id").distinct()
        inner = self._inner(engine.notes(self.images.join(grown(changed), "file_id", "left_semi"))).drop("part_no")
        return self._sound(own.unionByName(inner))

    def stripped(self) -> DataFrame:
        changed = engine.findings(self.images).select("file_id").distinct()
        pictures = self._inner(engine.stripped(self.images.join(grown(changed), "file_id", "left_semi")).select("file_id", "content")).withColumnRenamed("content", "new")
        new = self.scrubbed.where("new IS NOT NULL").select("file_id", "part_no", "new").unionByName(pictures.select("file_id", "part_no", "new"))
        kept = self._sound(self.rows.where("role <> 'drop'").repartition(self.pieces, "file_id")).repartition(self.pieces, "file_id", "part_no").join(grown(new), ["file_id", "part_no"], "left")
        kept = kept.withColumn("new", F.when((F.col("role") == "first") & (F.col("method") != 0), F.col("data")).otherwise(F.col("new")))
        kept = kept.select("file_id", (F.col("role") != "first").alias("later"), "part_no", "raw_name", "method", "flags", "crc", "size", F.when(F.col("new").isNull(), F.coalesce("packed", "data")).alias("packed"), "new")
        made = by_file(kept, "later", "part_no").mapInArrow(_assemble, "file_id string, content binary")
        facts = self.files.select("file_id", "path", "format", F.octet_length("content").cast("long").alias("input_bytes"))
        return made.join(grown(facts), "file_id").select("file_id", "path", "format", "content", "input_bytes", F.octet_length("content").cast("long").alias("output_bytes"))


def by_file(rows: DataFrame, *order: str) -> DataFrame:
    """rows with those of one file in one partition, next to each other and in order.

    They are dealt by a hash of the file. A repartition by the file itself is left out by the planner where a join below has dealt by it
    already; if that join then becomes a broadcast at run time, its side is read where it lies, and a file's rows are in several tasks.
    """
    return rows.repartition(F.xxhash64("file_id")).sortWithinPartitions("file_id", *order)


def assembled(rows: DataFrame) -> DataFrame:
    """rows (file_id, part_no, raw_name, new) -> (file_id, content): archives of stored entries, in order of part."""
    none = F.lit(None)
    facts = [F.lit(False).alias("later"), *[none.cast("int").alias(c) for c in ("method",)], F.lit(2048).alias("flags"), *[none.cast("bigint").alias(c) for c in ("crc", "size")], none.cast("binary").alias("packed")]
    rows = rows.select("file_id", "part_no", "raw_name", *facts, "new")
    return by_file(rows, "part_no").mapInArrow(_assemble, "file_id string, content binary")


def _assemble(batches):
    """Parts in order of file -> one archive for each file, when its last part has come."""
    import pyarrow as pa

    def batch(done):
        return pa.RecordBatch.from_arrays([pa.array([k for k, _ in done], pa.string()), pa.array([c for _, c in done], pa.binary())], names=["file_id", "content"])

    file_id, entries, done, held = None, [], [], 0
    for b in batches:
        for start in range(0, b.num_rows, PART_ROWS):  # of a batch's bytes, few are in Python at a time
            some = b.slice(start, PART_ROWS)
            for key, raw, method, flags, crc, size, packed, new in zip(*(some.column(c).to_pylist() for c in ("file_id", "raw_name", "method", "flags", "crc", "size", "packed", "new")), strict=True):
                if key != file_id:
                    done += [(file_id, archive(entries))] if entries else []
                    held += len(done[-1][1]) if entries else 0
                    file_id, entries = key, []
                    if held >= DONE_BYTES:
                        yield batch(done)
                        done, held = [], 0
                entries.append((raw, method, flags, crc, size, packed) if new is None else (raw, 0, flags, zlib.crc32(new), len(new), new))
    done += [(file_id, archive(entries))] if entries else []
    yield batch(done)


def verified(done: DataFrame) -> DataFrame:
    """(file_id, format, residual, verified): the output opened and inspected again, without a finding."""
    again = Package(done.select("file_id", "path", "format", "content"))
    left = again.findings().groupBy("file_id").agg(F.count("*").alias("n"))
    bad = again.errors().select("file_id").distinct().withColumn("bad", F.lit(True))
    rows = done.select("file_id", "format").join(grown(left), "file_id", "left").join(grown(bad), "file_id", "left")
    return rows.select("file_id", "format", F.coalesce("n", F.lit(0)).cast("int").alias("residual"), (F.col("n").isNull() & F.col("bad").isNull()).alias("verified"))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
