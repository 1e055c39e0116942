"""Movies laid out as tables: boxes are rows, positions are running sums, chunk offsets are joined to the media that holds them.

One narrow pass lists the boxes of a file in order (a nested set: `no` to `last`), with the few small bodies that rules look into and
the values of its offset tables; media is not touched. What stays, what each box is rewritten to, where it comes to lie, where each chunk
moves and why a movie is refused are expressions. As a table (`scanned`, `layout`, `moved`) boxes are rows, and windows and joins bring
those of a file together. Files that are laid out anew (`relaid`) have their boxes as an array beside their bytes, which the same
expressions go over: nothing is shuffled.

Null and empty contents and files that are no movies are refused with a row; a file's boxes meet in one window or array, which holds at
most walkers.MOST_ITEMS of them. An offset that no media holds refuses its file as 'broken-index'.
"""

from __future__ import annotations

import struct
import sys

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..functions.detect import fenced
from . import guard, relational, walkers
from .walkers import Doubt

#: Level -> the boxes that it keeps; the file itself is the level ''.
KEPT = {"": ("ftyp", "moov", "mdat"), **dims.BOXES}
TABLES = {"stco": 4, "co64": 8}
#: Boxes whose bodies are looked into; of offset tables, what stands before their values.
READ = ("mvhd", "tkhd", "mdhd", "hdlr", "stsd")
BOX = (
    "file_id string, no int, last int, level string, path string, kind string, off bigint, header int, size bigint, body binary, "
    "names array<int>, brands array<string>, offsets array<bigint>, failure struct<error_kind:string,detail:string,unsupported_kind:string>"
)
_LAST, _BODY, _NAMES, _BRANDS, _OFFSETS = 1, 8, 9, 10, 11
ROWS = 10_000


def headers(data: bytes, at: int, end: int, top: bool):
    """(kind, offset, header, size) of the boxes of a range. What is left behind the boxes of a file has the kind ''; elsewhere it is a doubt."""
    while at < end:
        size, kind = struct.unpack_from(">I4s", data, at) if end - at >= 8 else (-1, b"")
        header, told = 8, size not in (0, 1)
        if size == 1:
            if end - at < 16:
                raise Doubt("truncated")
            header, size = 16, struct.unpack_from(">Q", data, at + 8)[0]
        elif size == 0:
            size = end - at
        if not header <= size <= end - at:
            if not (top and told):
                raise Doubt("length-out-of-range", at)
            yield "", at, 0, end - at
            return
        yield kind.decode("latin-1"), at, header, size
        at += size


def _offsets(data: bytes, kind: str, at: int, end: int) -> list[int]:
    width = TABLES[kind]
    if end - at < 8:
        raise Doubt("truncated")
    count = struct.unpack_from(">I", data, at + 4)[0]
    if end - at - 8 != count * width:
        raise Doubt("broken-index")
    return list(struct.unpack_from(f">{count}{'I' if width == 4 else 'q'}", data, at + 8))  # beyond 2^63: negative, in no media


def _names(body: bytes, handler: bytes) -> list[int]:
    """Where the encoder's name stands in the video entries of a body of sample descriptions."""
    if len(body) < 4:
        raise Doubt("truncated")
    out = []
    for kind, at, header, _ in headers(body, 8, len(body), False):
        if kind in dims.PROTECTED_ENTRIES:
            raise Doubt(None, None, "unsupported-format", "protected-media")
        field = at + header + 42
        if handler == b"vide" and body[field : field + 32].strip(b"\0") and len(body) >= field + 32:
            out.append(field)
    return out


def _own_media(data: bytes, at: int, end: int) -> None:
    """Refuses references to media in another file."""
    for kind, off, header, size in headers(data, at, end, False):
        if kind != "dref":
            continue
        if size - header < 4:
            raise Doubt("truncated")
        for _, entry, head, n in headers(data, off + header + 8, off + size, False):
            if n - head < 4 or not data[entry + head + 3] & 1:
                raise Doubt("unsupported-feature")


def listed(data: bytes) -> list[list]:
    """The boxes of one movie in order, levels before what they hold: the columns of BOX behind the file's, and whether the box stays."""
    rows = []

    def level(name: str, path: str, start: int, stop: int, handler: bytes) -> None:
        kids = list(headers(data, start, stop, not name))
        if name == "mdia":
            handler = next((data[at + head + 8 : at + min(head + 12, n)] for k, at, head, n in kids if k == "hdlr"), b"")
        for kind, at, head, size in kids:
            if len(rows) >= walkers.MOST_ITEMS:
                raise Doubt(None, None, "limit-exceeded", limit="item-count")
            no, end, stays = len(rows), at + size, kind in KEPT[name]
            place = f"{path}/{walkers.clean(kind.encode('latin-1'))}".lstrip("/")
            row = [no, no, name, place, kind, at, head, size, None, None, None, None, stays]
            rows.append(row)
            if stays and kind in READ:
                row[_BODY] = data[at + head : end]
                row[_NAMES] = _names(row[_BODY], handler) if kind == "stsd" else None
            elif stays and kind == "ftyp":
                row[_BRANDS] = [data[i : i + 4].decode("latin-1") for i in range(at + head, end - 3, 4)]
            elif stays and kind in TABLES:
                row[_OFFSETS], row[_BODY] = _offsets(data, kind, at + head, end), data[at + head : at + head + 8]
            elif stays and kind == "dinf":
                _own_media(data, at + head, end)
            elif stays and kind in dims.BOXES:
                level(kind, place, at + head, end, handler)
            row[_LAST] = len(rows) - 1

    level("", "", 0, len(data), b"")
    return rows


def tried(data: bytes | None) -> tuple[list[list], dict | None]:
    """The boxes of a file, or why they cannot be listed."""
    try:
        return listed(data or b""), None
    except Doubt as e:
        return [], {k: e.row[k] for k in ("error_kind", "detail", "unsupported_kind")}


def _scan(schema):
    def scan(batches):
        import pyarrow as pa

        def made(ids, rows):
            columns = zip(schema, (ids, *zip(*rows, strict=True)), strict=True)
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for f, c in columns], schema=schema)

        for batch in guard.lots(batches):
            ids, out = [], []
            for file, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, failure = tried(data)
                ids += [file] * max(1, len(found))
                out += [[*row[:-1], None] for row in found] or [[0, 0, "", *[None] * 9, failure]]
                if len(out) >= ROWS:
                    yield from (made(ids[i : i + ROWS], out[i : i + ROWS]) for i in range(0, len(out), ROWS))
                    ids, out = [], []
            if out:
                yield made(ids, out)

    return scan


def scanned(files: DataFrame) -> DataFrame:
    """A row for each box of each file (file_id, content); a file without a box, or one that cannot be read, has one row without a kind."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    schema = to_arrow_schema(_parse_datatype_string(BOX))
    return files.select(F.col("file_id").cast("string").alias("file_id"), "content").mapInArrow(_scan(schema), BOX)


def _nest(names: list[str], content: int, boxes, failure):
    def nest(batches):
        import pyarrow as pa

        def made(batch, first, places):
            found, why = zip(*first.values(), strict=True)
            ends = [0]
            for rows in found:
                ends.append(ends[-1] + len(rows))
            columns = list(zip(*(row for rows in found for row in rows), strict=True)) or [()] * len(fields)
            inner = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(columns, fields, strict=True)], fields=fields)
            out = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), inner, type=boxes), pa.array(why, failure)]
            out = out if len(first) == len(places) else [m.take(pa.array(places, pa.int32())) for m in out]
            return pa.RecordBatch.from_arrays([*batch.columns, *out], names=names)

        fields = list(boxes.value_type)
        for batch in guard.lots(batches):
            start, held, first, places = 0, 0, {}, []  # files of equal bytes are listed once
            for i, data in enumerate(batch.column(content)):
                data, n = data.as_py(), len(first)
                rows = first.setdefault(data, (n, *tried(data)) if data not in first else None)
                places.append(rows[0])
                held += len(rows[1])
                if held >= ROWS:  # many boxes are passed on a few files at a time
                    yield made(batch.slice(start, i + 1 - start), {k: r[1:] for k, r in first.items()}, places)
                    start, held, first, places = i + 1, 0, {}, []
            if places:
                yield made(batch.slice(start), {k: r[1:] for k, r in first.items()}, places)

    return nest


def nested(files: DataFrame) -> DataFrame:
    """files (content, ...) with __boxes (the columns of BOX and kept, in order) and __failure: a row for each file."""
    from pyspark.sql.pandas.types import to_arrow_type
    from pyspark.sql.types import ArrayType, StructType, _parse_datatype_string

    *box, why = _parse_datatype_string(BOX).fields[1:]
    schema = StructType([*files.schema.fields]).add("__boxes", ArrayType(StructType(box).add("kept", "boolean"))).add("__failure", why.dataType)
    kinds = [to_arrow_type(schema[c].dataType) for c in ("__boxes", "__failure")]
    return files.mapInArrow(_nest(schema.names, files.columns.index("content"), *kinds), schema)


# --- decisions ---------------------------------------------------------------------------------------------------------


def _zeros(n: int) -> Column:
    return F.unhex(F.lit("00" * n))


def kept() -> Column:
    return F.concat_ws("/", "level", "kind").isin(*[f"{level}/{k}" for level, kinds in KEPT.items() for k in kinds])


def held(stays: Column, of=F.col) -> Column:
    """Whether a box is a level that stays. of: a box's column by its name."""
    return stays & of("kind").isin(*dims.BOXES)


def rewritten(of=F.col) -> Column:
    """The new body of a box that is rewritten, else null: no times, no language, no names of encoders or of who handles the media."""
    b = of("body")
    n = F.octet_length(b)
    late = F.hex(F.substring(b, 1, 1)) == "01"  # version 1 has 64-bit times

    def header(width: int) -> Column:
        language, selection = (32, 84) if width == 16 else (20, 72)
        out = F.overlay(b, _zeros(width), 5)
        spoken = F.when(of("kind").isin("mdhd") & (n >= language + 2), F.overlay(out, F.unhex(F.lit("55C4")), language + 1))
        shown = F.when(of("kind").isin("mvhd") & (n >= selection + 24), F.overlay(out, _zeros(24), selection + 1))
        return F.when(n >= 4 + width, F.coalesce(spoken, shown, out))

    named = F.when((n > 24) & (F.hex(F.substring(b, 25, 2)) != "00"), F.concat(F.substring(b, 1, 24), _zeros(1)))
    blank = F.when(F.size(of("names")) > 0, F.aggregate(of("names"), b, lambda acc, at: F.overlay(acc, _zeros(32), at + 1)))
    times = F.when(late, header(16)).otherwise(header(8))
    return F.when(of("kind").isin("mvhd", "tkhd", "mdhd"), times).when(of("kind") == "hdlr", named).when(of("kind") == "stsd", blank)


def emitted(new: Column, stays: Column, of=F.col) -> Column:
    """Bytes that a box itself emits; new: what it is rewritten to."""
    table = F.when(of("kind") == "stco", 4).when(of("kind") == "co64", 8)
    out = F.when(~stays, 0).when(held(stays, of), 8).when(table.isNotNull(), 16 + table * F.size(of("offsets")))
    return out.otherwise(F.coalesce(8 + F.octet_length(new), of("size"))).cast("bigint")


def layout(boxes: DataFrame) -> DataFrame:
    """(file_id, no, last, level, path, kind, off, header, size, kept, emitted, new_off, new_size) of boxes.

    A level emits its own header, any other box that stays all its bytes; so where a box comes to lie is a running sum in order, and how long
    a level becomes is where its last box ends less where it begins. Dropped boxes have a place of no length.

    Behind a level's last box stands a mark of the level, so that the running sum tells both, and a window over the box and its mark
    brings them together: a file's boxes are dealt once, by the file.
    """
    rows = boxes.where("kind IS NOT NULL").select("file_id", "no", "last", "level", "path", "kind", "off", "header", "size", kept().alias("kept"), held(kept()).alias("held"), emitted(rewritten(), kept()).alias("emitted"))
    place = lambda at, mark, n: F.struct(F.col(at).alias("at"), F.lit(mark).alias("mark"), n.cast("bigint").alias("n"))
    places = F.when(F.col("held"), F.array(place("no", 0, F.col("emitted")), place("last", 1, F.lit(0)))).otherwise(F.array(place("no", 0, F.col("emitted"))))
    rows = rows.select("*", F.inline(places))
    rows = rows.withColumn("hash", F.xxhash64("file_id"))  # sorted by first: ids that begin alike are slow to compare
    w = Window.partitionBy("hash", "file_id").orderBy("at", "mark").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("new_off", F.coalesce(F.sum("n").over(w), F.lit(0)))
    rows = rows.withColumn("end", F.max(F.when(F.col("mark") == 1, F.col("new_off"))).over(Window.partitionBy("hash", "file_id", "no"))).where("mark = 0")
    length = F.when(F.col("held"), F.col("end") - F.col("new_off")).otherwise(F.col("emitted"))
    return rows.withColumn("new_size", length).drop("held", "end", "at", "mark", "n", "hash")


def media(laid: DataFrame) -> DataFrame:
    """(file_id, lo, hi, new_lo): the payloads of a file's media, before and after."""
    own = laid.where("level = '' AND kind = 'mdat'")
    return own.select("file_id", (F.col("off") + F.col("header")).alias("lo"), (F.col("off") + F.col("size")).alias("hi"), (F.col("new_off") + F.col("header")).alias("new_lo"))


def chunks(boxes: DataFrame) -> DataFrame:
    """(file_id, no, kind, chunk, offset): each value of each offset table."""
    return boxes.where("offsets IS NOT NULL").select("file_id", "no", "kind", F.posexplode("offsets").alias("chunk", "offset"))


def moved(boxes: DataFrame, laid: DataFrame) -> DataFrame:
    """chunks with relocated and status: 'moved', 'broken-index' where no media holds it, 'length-out-of-range' where the table is too narrow for it."""
    rows = relational.relocate(chunks(boxes), media(laid))
    far = (F.col("kind") == "stco") & (F.col("relocated") >= 1 << 32)
    return rows.withColumn("status", F.when(far, "length-out-of-range").otherwise(F.col("status")))


# --- files with their boxes beside them --------------------------------------------------------------------------------


def _powers(n: Column) -> Column:
    """1, 2, 4 and so on, up to n; 1 at least."""
    return F.transform(F.sequence(F.lit(1), F.length(F.bin(F.greatest(n, F.lit(1))))), lambda k: F.pow(F.lit(2), k - 1).cast("int"))


def running(numbers: str) -> Column:
    """Sums of an array up to each element, itself included: each round adds what stands 1, 2, 4 and so on places before, so that the work is n log n."""
    return F.aggregate(_powers(F.size(numbers)), F.col(numbers), lambda sums, k: F.transform(sums, lambda v, i: v + F.coalesce(F.get(sums, i - k), F.lit(0))))


def placed(files: DataFrame) -> DataFrame:
    """nested files with, box by box, __new (what it is rewritten to), __n (the bytes it emits) and __to (new_off, new_size), with __media in order."""
    rows = fenced(nested(files), __new=F.transform("__boxes", lambda x: rewritten(x.getField)))
    rows = fenced(rows, __n=F.transform("__boxes", lambda x, i: emitted(F.get("__new", i), x["kept"], x.getField)))
    rows = fenced(rows, __sums=running("__n"))
    start = lambda i: F.get("__sums", i) - F.get("__n", i)
    rows = fenced(rows, __to=F.transform("__boxes", lambda x, i: F.struct(start(i).alias("new_off"), (F.get("__sums", x["last"]) - start(i)).alias("new_size"))))

    def medium(x: Column, i: Column) -> Column:
        lo = x["off"] + x["header"]
        return F.when((x["level"] == "") & (x["kind"] == "mdat"), F.struct(lo.alias("lo"), (x["off"] + x["size"]).alias("hi"), (F.get("__to", i)["new_off"] + x["header"]).alias("new_lo")))

    rows = fenced(rows, __media=F.filter(F.transform("__boxes", medium), lambda m: m["hi"] > m["lo"]))
    return rows.drop("__n", "__sums")


def relocated(rows: DataFrame) -> DataFrame:
    """placed files with, for each box, __moved: the values of its offset table, each moved with the media that holds it; null where none does.

    Media lie in order and do not overlap, so the one that may hold an offset is found by halving.
    """
    rows = fenced(rows, __lo=F.transform("__media", lambda m: m["lo"]), __halves=F.reverse(_powers(F.size("__media"))))

    def moved_to(offset: Column) -> Column:
        before = F.aggregate("__halves", F.lit(0), lambda n, k: F.when(F.get("__lo", n + k - 1) <= offset, n + k).otherwise(n))  # media that begin at or before it
        move = lambda m: F.when(offset < m["hi"], offset - m["lo"] + m["new_lo"])
        return move(F.get("__media", before - 1))

    return fenced(rows, __moved=F.transform("__boxes", lambda x: F.transform(x["offsets"], moved_to))).drop("__lo", "__halves")


def refusal() -> Column:
    """(error_kind, detail, unsupported_kind) of a file that is no movie that can be laid out anew, the first reason; else null."""
    words = F.create_map(*[F.lit(x) for kv in dims.BOX_REFUSALS.items() for x in kv])
    brands = F.create_map(*[F.lit(x) for kv in dims.BRAND_REFUSALS.items() for x in kv])
    word = lambda b: F.coalesce(F.try_element_at(brands, b), F.try_element_at(brands, F.substring(b, 1, 3)))
    first = lambda array, test: F.get(F.filter(array, test), 0)
    kind = F.try_element_at(words, first("__boxes", lambda x: x["kind"].isin(*dims.BOX_REFUSALS))["kind"])
    told = F.flatten(F.transform(F.filter("__boxes", lambda x: x["brands"].isNotNull()), lambda x: x["brands"]))
    brand = first(F.transform(told, word), lambda w: w.isNotNull())
    count = lambda level, k: F.size(F.filter("__boxes", lambda x: (x["level"] == level) & (x["kind"] == k)))
    far = lambda x, at: (x["kind"] == "stco") & (at >= 1 << 32)
    status = lambda x, i: F.transform(F.get("__moved", i), lambda at: F.when(at.isNull(), "broken-index").when(far(x, at), "length-out-of-range"))
    tables = F.filter(F.transform("__boxes", status), lambda s: s.isNotNull())
    lost = first(F.flatten(tables), lambda s: s.isNotNull())
    none = F.lit(None).cast("string")
    why = lambda kind, detail, other: F.struct(F.lit(kind).alias("error_kind"), detail.alias("detail"), other.alias("unsupported_kind"))
    malformed = lambda detail: why("malformed", F.lit(detail), none)
    reason = F.when(F.col("__failure").isNotNull(), F.col("__failure")).when(kind.isNotNull(), why("unsupported-format", none, kind)).when(count("", "ftyp") == 0, malformed("missing-marker"))
    reason = reason.when(brand.isNotNull(), why("unsupported-format", none, brand)).when(count("", "moov") > 1, malformed("unexpected-marker"))
    reason = reason.when((count("", "moov") == 0) | (count("moov", "mvhd") == 0) | (count("moov", "trak") == 0), malformed("missing-marker"))
    return reason.when(lost.isNotNull(), why("malformed", lost, none))


def piece(x: Column, i: Column) -> Column:
    """What a box emits: new bytes, or a range of the file, as a string; neither cast of bytes to strings and back looks at them."""
    number = lambda c: F.unhex(F.lpad(F.hex(c), 8, "0"))
    head = F.concat(number(F.get("__to", i)["new_size"]), F.substring(F.col("content"), (x["off"] + 5).cast("int"), F.lit(4)))
    width = F.when(x["kind"] == "co64", 16).otherwise(8)
    values = F.unhex(F.array_join(F.transform(F.get("__moved", i), lambda at: F.lpad(F.hex(at), width, F.lit("0"))), ""))
    made = F.when(held(x["kept"], x.getField), head).when(x["offsets"].isNotNull(), F.concat(head, x["body"], values)).when(F.get("__new", i).isNotNull(), F.concat(head, F.get("__new", i)))
    return F.when(x["kept"], F.coalesce(made, F.substring(F.col("content"), (x["off"] + 1).cast("int"), x["size"].cast("int"))).cast("string"))


def relaid(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """files (content, ...) that are movies, laid out anew, and the others with error_kind, detail and unsupported_kind instead of content.

    Both are narrow: a file's boxes, bytes and reasons are in its row.
    """
    beside = [c for c in files.columns if c != "content"]
    rows = fenced(relocated(placed(files)), __refusal=refusal())
    made = F.array_join(F.transform("__boxes", piece), "").cast("binary")
    return rows.where("__refusal IS NULL").select(*beside, made.alias("content")), rows.where("__refusal IS NOT NULL").select(*beside, "__refusal.*")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
