"""Carrier files built from table rows with native expressions: inputs whose findings are known from the rows."""

from __future__ import annotations

import zlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.detect import fenced


def raw(text: str) -> Column:
    """Bytes given in hex, spaces ignored."""
    return F.unhex(F.lit(text.replace(" ", "")))


def utf8(c: Column) -> Column:
    return F.encode(c, "UTF-8")


def be(n: Column, width: int) -> Column:
    return F.unhex(F.lpad(F.hex(n.cast("long")), 2 * width, "0"))


def le(n: Column, width: int) -> Column:
    digits = F.lpad(F.hex(n.cast("long")), 16, "0")
    return F.unhex(F.concat(*[F.substring(digits, 15 - 2 * i, 2) for i in range(width)]))


def size(c: Column) -> Column:
    return F.octet_length(c).cast("long")


# The smallest files of each format that are accepted, in hex.
PNG_HEAD = "89504E470D0A1A0A 0000000D 49484452 00000001000000010800000000 3A7E9B55"
PNG_TAIL = "0000000A 49444154 789C63000100000500 01 0D0A2DB4 00000000 49454E44 AE426082"
JPEG_TAIL = "FFDA 0004 0100 1234 FFD9"
GIF_HEAD, GIF_TAIL = "474946383961 01000100000000", "2C 00000000 01000100 00 02 02 4401 00 3B"
WAV_FMT, WAV_DATA = "666D7420 10000000 0100 0100 401F0000 401F0000 0100 0800", "64617461 04000000 80808080"
FLAC_INFO = "1000100000000000000000000AC442F000000000 0000000000000000000000000000"
FLAC_AUDIO, MP3_AUDIO = "FFF8C91800", "FFFB9000 0000000000000000"
JXL_HEAD, JXL_TAIL = "0000000C4A584C200D0A870A 00000014 66747970 6A786C20 00000000 6A786C20", "0000000C 6A786C63 FF0A1234"
SVG_HEAD, SVG_TAIL = '<svg xmlns="http://www.w3.org/2000/svg">', "<rect/></svg>"
WEBP_CODE = "5650384C 06000000 2F0000000000"


def png_text(c: Column) -> Column:
    return F.concat(raw(PNG_HEAD), be(size(c) + 7, 4), raw("74455874"), utf8(F.lit("Author")), raw("00"), utf8(c), raw("00000000"), raw(PNG_TAIL))


def jpeg_com(c: Column) -> Column:
    return F.concat(raw("FFD8 FFFE"), be(size(c) + 2, 2), utf8(c), raw(JPEG_TAIL))


def jpeg_exif(c: Column) -> Column:
    """c: 19 characters of date and time."""
    tiff = F.concat(raw("49492A0008000000 0100 3201 0200 14000000 1A000000 00000000"), utf8(c), raw("00"))
    body = F.concat(utf8(F.lit("Exif")), raw("0000"), tiff)
    return F.concat(raw("FFD8 FFE1"), be(size(body) + 2, 2), body, raw(JPEG_TAIL))


def gif_comment(c: Column) -> Column:
    return F.concat(raw(GIF_HEAD), raw("21FE"), be(size(c), 1), utf8(c), raw("00"), raw(GIF_TAIL))


def _riff(form: str, body: Column) -> Column:
    return F.concat(utf8(F.lit("RIFF")), le(size(body) + 4, 4), utf8(F.lit(form)), body)


def wav_info(c: Column) -> Column:
    pad = F.when(size(c) % 2 == 1, raw("00")).otherwise(raw(""))
    entry = F.concat(utf8(F.lit("INFOIART")), le(size(c), 4), utf8(c), pad)
    return _riff("WAVE", F.concat(raw(WAV_FMT), utf8(F.lit("LIST")), le(size(entry), 4), entry, raw(WAV_DATA)))


def flac_vorbis(c: Column) -> Column:
    entry = F.concat(utf8(F.lit("ARTIST=")), utf8(c))
    block = F.concat(le(F.lit(0), 4), le(F.lit(1), 4), le(size(entry), 4), entry)
    return F.concat(utf8(F.lit("fLaC")), raw("00000022"), raw(FLAC_INFO), raw("84"), be(size(block), 3), block, raw(FLAC_AUDIO))


def mp3_id3(c: Column) -> Column:
    """c: fewer than 100 bytes, so that lengths fit one seven-bit byte."""
    return F.concat(raw("494433 0300 00 000000"), be(size(c) + 11, 1), utf8(F.lit("TPE1")), be(size(c) + 1, 4), raw("0000 00"), utf8(c), raw(MP3_AUDIO))


def jxl_xmp(c: Column) -> Column:
    packet = F.concat(utf8(F.lit("<x><dc:creator>")), utf8(c), utf8(F.lit("</dc:creator></x>")))
    return F.concat(raw(JXL_HEAD), be(size(packet) + 8, 4), utf8(F.lit("xml ")), packet, raw(JXL_TAIL))


def webp_flags(c: Column) -> Column:
    """Every row the same picture with three metadata flags set and no metadata chunk."""
    return F.concat(_riff("WEBP", F.concat(raw("56503858 0A000000 2C000000 000000 000000"), raw(WEBP_CODE))), F.when(c.isNull(), raw("")).otherwise(raw("")))


def svg_meta(c: Column) -> Column:
    return F.concat(utf8(F.lit(SVG_HEAD + "<metadata><dc:creator>")), utf8(c), utf8(F.lit("</dc:creator></metadata>" + SVG_TAIL)))


class Made:
    """Bytes in the making: constants as they are, columns with their lengths beside them, so that sizes never repeat contents."""

    def __init__(self, *parts):
        self.parts, self.fixed, self.open = [], 0, []
        for p in parts:
            more = p if isinstance(p, Made) else None
            self.parts += more.parts if more else [p]
            self.fixed += more.fixed if more else len(p) if isinstance(p, bytes) else p[1] if isinstance(p[1], int) else 0
            self.open += more.open if more else [] if isinstance(p, bytes) or isinstance(p[1], int) else [p[1]]

    def size(self, more: int = 0) -> Column:
        return sum(self.open, F.lit(self.fixed + more).cast("long"))

    def column(self) -> Column:
        out, run = [], b""
        for p in [*self.parts, None]:
            if isinstance(p, bytes):
                run += p
                continue
            out += [raw(run.hex())] if run else []
            run, out = b"", out + ([p[0]] if p else [])
        return F.concat(*out)


def text(c: Column) -> Made:
    return Made((utf8(c), size(utf8(c))))


def number(n, width: int) -> Made:
    return Made(n.to_bytes(width) if isinstance(n, int) else (be(n, width), width))


def hexed(digits: str) -> bytes:
    return bytes.fromhex(digits)


def box(kind: str, *parts, full: bool = False) -> Made:
    """An ISO box of these parts; full: with version and flags of zero."""
    body = Made(*([bytes(4)] if full else []), *parts)
    length = number(body.size(8), 4) if body.open else (body.fixed + 8).to_bytes(4)
    return Made(length, kind.encode(), body)


MP4_FTYP = "00000014 66747970 69736F6D 00000000 6D703432"
MP4_DATA = "0000001C 6D646174 50524553 45525645 442D6D65 6469612D 64617461"
HEIF_FTYP = "00000018 66747970 68656963 00000000 6D696631 68656963"
HEIF_DATA = "PRESERVED-picture-data"


def mp4_index(*more, wide: bool = False, at=0, times: str = "00000000") -> Made:
    """moov of one video track whose two chunks lie at `at` and eight bytes on; more: boxes that follow the track."""
    header = lambda kind, tail: box(kind, hexed(times + times), hexed(tail), full=True)
    width = 8 if wide else 4
    chunks = box("co64" if wide else "stco", hexed("00000002"), number(at, width), number(at + 8, width), full=True)
    entry = box("avc1", bytes(74), hexed("0018FFFF"))
    table = box("stbl", box("stsd", hexed("00000001"), entry, full=True), box("stsz", bytes(8), full=True), chunks)
    own = box("dinf", box("dref", hexed("00000001 0000000C"), b"url ", hexed("00000001"), full=True))
    handler = box("hdlr", bytes(4), b"vide", bytes(13), full=True)
    media = box("mdia", header("mdhd", "000003E8 00000000 55C40000"), handler, box("minf", box("vmhd", bytes(8), full=True), own, table))
    return box("moov", header("mvhd", "000003E8 00000000 00010000 0100" + "00" * 70), box("trak", header("tkhd", "00000001 00000000" + "00" * 60), media), *more)


def mp4_file(*more, start: bool = True, **kw) -> Made:
    """A movie whose index comes before its media; its chunk offsets point into the media, or where `at` says."""
    if start:
        kw["at"] = mp4_index(*more, **kw).size(28)
    return Made(hexed(MP4_FTYP), mp4_index(*more, **kw), hexed(MP4_DATA))


def mp4_tags(c: Column, wide: bool = False, times: str = "00000000") -> Column:
    """A movie with an artist tag of c in its index."""
    return mp4_file(box("udta", box("aART", bytes(8), text(c))), wide=wide, times=times).column()


def heif_items(c: Column) -> Column:
    """A still of two pictures, the second a thumbnail of the first, and an XMP item that names c as the creator; the first's name is c."""
    packet, first = Made(b"<x:xmpmeta><dc:creator>", text(c), b"</dc:creator></x:xmpmeta>"), len(HEIF_DATA)

    infe = lambda n, kind, *rest: box("infe", hexed("02000000"), n.to_bytes(2), bytes(2), kind, *rest)
    infos = box("iinf", hexed("0003"), infe(1, b"hvc1", text(c), b"\0"), infe(2, b"hvc1", b"\0"), infe(3, b"mime", b"\0application/rdf+xml\0"), full=True)
    refs = box("iref", box("thmb", hexed("0002 0001 0001")), full=True)
    props = box("iprp", box("ipco", box("ispe", hexed("00000010 00000010"), full=True), box("colr", b"prof", bytes(8))), box("ipma", hexed("00000001 0001 02 81 02"), full=True))

    def index(at) -> Made:
        place = lambda n, off, length: Made(hexed(f"{n:04X} 0000 0001"), number(off, 4), number(length, 4))
        rows = Made(place(1, at, first), place(2, at + first, 4), place(3, at + first + 4, packet.size()))
        return box("meta", box("hdlr", bytes(4), b"pict", bytes(13), full=True), box("pitm", hexed("0001"), full=True), infos, box("iloc", hexed("4400 0003"), rows, full=True), refs, props, full=True)

    return Made(hexed(HEIF_FTYP), index(index(0).size(24 + 8)), box("mdat", HEIF_DATA.encode(), hexed("DEADBEEF"), packet)).column()


def heif_clean() -> bytes:
    """What is left of heif_items: the first picture, with its size, in a file laid out anew."""

    def b(kind, body):
        return (len(body) + 8).to_bytes(4) + kind + body

    def full(kind, body, version=0, flags=0):
        return b(kind, bytes([version]) + flags.to_bytes(3) + body)

    data = HEIF_DATA.encode()
    head = full(b"hdlr", bytes(4) + b"pict" + bytes(13)) + full(b"pitm", b"\0\1") + b(b"dinf", full(b"dref", b"\0\0\0\1" + full(b"url ", b"", 0, 1)))
    head += full(b"iinf", b"\0\1" + full(b"infe", b"\0\1\0\0hvc1\0", 2))
    tail = b(b"iprp", b(b"ipco", b(b"ispe", bytes.fromhex("00000000 00000010 00000010"))) + full(b"ipma", bytes.fromhex("00000001 0001 01 81")))
    ftyp = bytes.fromhex(HEIF_FTYP.replace(" ", ""))
    at = len(ftyp) + 12 + len(head) + 32 + len(tail) + 8
    places = full(b"iloc", bytes.fromhex("4400 0001 0001 0000 0000 0001") + at.to_bytes(4) + len(data).to_bytes(4), 1)
    return ftyp + full(b"meta", head + places + tail) + b(b"mdat", data)


def zipped(parts: list[tuple[str, object]], time: str = "0000 2100", sums: dict[str, Column] | None = None) -> Column:
    """An archive of stored parts, each bytes or Made; time: that of all entries, as it stands in the headers. sums: check sum and both lengths of parts, where a column has them."""
    out, directory, at = [], [], Made()
    for name, content in parts:
        made = Made(content)
        if made.open and name in (sums or {}):
            lengths = Made((sums[name], 12))
        elif made.open:
            c = made.column()
            lengths = Made((le(F.crc32(c), 4), 4), (le(made.size(), 4), 4), (le(made.size(), 4), 4))
        else:
            data = b"".join(made.parts)
            lengths = Made(zlib.crc32(data).to_bytes(4, "little") + len(data).to_bytes(4, "little") * 2)
        facts = Made(bytes(4), hexed(time), lengths, len(name.encode()).to_bytes(2, "little"), bytes(2))
        place = Made((le(at.size(), 4), 4)) if at.open else Made(at.fixed.to_bytes(4, "little"))
        directory += [b"PK\1\2\x14\0\x14\0", facts, bytes(10), place, name.encode()]
        local = Made(b"PK\3\4\x14\0", facts, name.encode(), made)
        out.append(local)
        at = Made(*out)
    tail = Made(*directory)
    n = len(parts).to_bytes(2, "little")
    start = Made((le(at.size(), 4), 4)) if at.open else at.fixed.to_bytes(4, "little")
    return Made(at, tail, b"PK\5\6", bytes(4), n, n, tail.fixed.to_bytes(4, "little"), start, bytes(2)).column()


# The smallest packages of each family. NAME stands for the value.
_TYPE, _RELATION = "application/vnd.openxmlformats-", "http://schemas.openxmlformats.org/"
DOCX = {
    "[Content_Types].xml": f'<Types><Default Extension="rels" ContentType="{_TYPE}package.relationships+xml"/><Override PartName="/word/document.xml" ContentType="{_TYPE}officedocument.wordprocessingml.document.main+xml"/>'
    f'<Override PartName="/docProps/core.xml" ContentType="{_TYPE}package.core-properties+xml"/></Types>',
    "_rels/.rels": f'<Relationships><Relationship Id="rId1" Type="{_RELATION}officeDocument/2006/relationships/officeDocument" Target="word/document.xml"/>'
    f'<Relationship Id="rId2" Type="{_RELATION}package/2006/relationships/metadata/core-properties" Target="docProps/core.xml"/></Relationships>',
    "word/document.xml": '<w:document><w:p w:rsidR="00AB12CD" w:rsidP="00AB12CE"><w:r><w:t>PRESERVED-text</w:t></w:r></w:p><w:attachedTemplate r:id="rId9"/></w:document>',
    "word/_rels/document.xml.rels": '<Relationships><Relationship Id="rId9" Type="t" Target="file:///C:/Users/NAME/a.dotm" TargetMode="External"/><Relationship Id="rId3" Type="i" Target="media/image1.png"/></Relationships>',
    "docProps/core.xml": "<cp:coreProperties><dc:creator>NAME</dc:creator><cp:revision>7</cp:revision></cp:coreProperties>",
    "word/media/image1.png": None,
}
DOCX_CLEAN = {
    "[Content_Types].xml": DOCX["[Content_Types].xml"].replace(f'<Override PartName="/docProps/core.xml" ContentType="{_TYPE}package.core-properties+xml"/>', ""),
    "_rels/.rels": DOCX["_rels/.rels"].replace(f'<Relationship Id="rId2" Type="{_RELATION}package/2006/relationships/metadata/core-properties" Target="docProps/core.xml"/>', ""),
    "word/document.xml": "<w:document><w:p><w:r><w:t>PRESERVED-text</w:t></w:r></w:p></w:document>",
    "word/_rels/document.xml.rels": '<Relationships><Relationship Id="rId3" Type="i" Target="media/image1.png"/></Relationships>',
    "word/media/image1.png": None,
}
_ODF = "application/vnd.oasis.opendocument.text"
ODT = {
    "mimetype": _ODF,
    "META-INF/manifest.xml": f'<manifest:manifest><manifest:file-entry manifest:full-path="/" manifest:media-type="{_ODF}"/><manifest:file-entry manifest:full-path="content.xml" manifest:media-type="text/xml"/>'
    '<manifest:file-entry manifest:full-path="meta.xml" manifest:media-type="text/xml"/><manifest:file-entry manifest:full-path="settings.xml" manifest:media-type="text/xml"/></manifest:manifest>',
    "content.xml": "<office:body><text:p>PRESERVED-text<office:annotation><dc:creator>NAME</dc:creator><dc:date>2020-01-01</dc:date><text:p>KEPT</text:p></office:annotation><text:author-name>NAME</text:author-name></text:p></office:body>",
    "meta.xml": "<office:meta><meta:initial-creator>NAME</meta:initial-creator><meta:generator>Writer/1</meta:generator></office:meta>",
    "settings.xml": '<office:settings><config:config-item config:name="PrinterName">NAME</config:config-item><config:config-item config:name="Zoom">1</config:config-item></office:settings>',
}
ODT_CLEAN = {
    "mimetype": _ODF,
    "META-INF/manifest.xml": f'<manifest:manifest><manifest:file-entry manifest:full-path="/" manifest:media-type="{_ODF}"/><manifest:file-entry manifest:full-path="content.xml" manifest:media-type="text/xml"/></manifest:manifest>',
    "content.xml": "<office:body><text:p>PRESERVED-text<office:annotation><dc:creator></dc:creator><dc:date></dc:date><text:p>KEPT</text:p></office:annotation><text:author-name></text:author-name></text:p></office:body>",
}


def _office(main: str, kind: str, **parts: str) -> dict:
    """An office package whose main part is of a kind, with authorship in its properties."""
    overrides = [(main, f"officedocument.{kind}.main+xml"), ("docProps/core.xml", "package.core-properties+xml"), ("docProps/app.xml", "officedocument.extended-properties+xml")]
    types = "".join(f'<Override PartName="/{n}" ContentType="{_TYPE}{t}"/>' for n, t in overrides)
    return {
        "[Content_Types].xml": f"<Types>{types}</Types>", "_rels/.rels": f'<Relationships><Relationship Id="rId1" Type="{_RELATION}officeDocument/2006/relationships/officeDocument" Target="{main}"/></Relationships>',
        main: "<main>PRESERVED</main>", **parts, "docProps/core.xml": "<cp:coreProperties><dc:creator>NAME</dc:creator></cp:coreProperties>", "docProps/app.xml": "<Properties><Company>NAME</Company></Properties>",
    }


XLSX = _office("xl/workbook.xml", "spreadsheetml.sheet", **{"xl/comments1.xml": "<comments><authors><author>NAME</author></authors><commentList/></comments>"})
PPTX = _office("ppt/presentation.xml", "presentationml.presentation", **{"ppt/media/image1.png": None})
ODS, ODP = ({n: t and t.replace(_ODF, _ODF.replace("text", kind)) for n, t in ODT.items()} for kind in ("spreadsheet", "presentation"))


def _filled(parts: dict, value: Made, picture: Column | None) -> list[tuple[str, Made]]:
    each = []
    for name, content in parts.items():
        pieces = [] if content is None else content.split("NAME")
        made = Made((picture, size(picture))) if content is None else Made(pieces[0].encode(), *[x for p in pieces[1:] for x in (value, p.encode())])
        each.append((name, made))
    return each


def package(parts: dict, c: Column, picture: Column | None = None, time: str = "0000 2100") -> Column:
    """A package whose parts name c; picture: the bytes of the part that has none."""
    return zipped(_filled(parts, text(c), picture), time)


def packaged(rows: DataFrame, parts: dict, c: Column, picture: Column | None = None, time: str = "0000 2100") -> tuple[DataFrame, Column]:
    """rows with columns of what their packages are made of, and the package from them.

    The same as package(), whose one expression becomes a generated method of more than 8,000 bytes, which the JVM does not compile.
    """
    rows = fenced(rows, __name=utf8(c), __size=size(utf8(c)), **({} if picture is None else {"__picture": picture}))
    each = _filled(parts, Made((F.col("__name"), F.col("__size"))), None if picture is None else F.col("__picture"))
    own = {name: f"__part{i}" for i, (name, made) in enumerate(each) if made.open}
    rows = fenced(rows, **{own[name]: made.column() for name, made in each if name in own})
    rows = fenced(rows, **{f"{p}s": size(F.col(p)) for p in own.values()})
    rows = fenced(rows, **{f"{p}f": F.concat(le(F.crc32(F.col(p)), 4), *[le(F.col(f"{p}s"), 4)] * 2) for p in own.values()})
    each = [(name, Made((F.col(own[name]), F.col(f"{own[name]}s"))) if name in own else made) for name, made in each]
    return rows, zipped(each, time, {name: F.col(f"{p}f") for name, p in own.items()})


def plain_archive(parts: dict, picture: bytes = b"") -> bytes:
    """The archive of these parts as Python's own writer lays it out."""
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in parts.items():
            entry = zipfile.ZipInfo(name)
            entry.create_system = 0
            z.writestr(entry, picture if content is None else content)
            entry.external_attr = 0
    return out.getvalue()


def dealt(rows: DataFrame, key: str) -> DataFrame:
    """rows (narrow: keys and small values) dealt to all cores by a unique key, before they are made into files.

    A table of millions of narrow rows is a file of a few megabytes, which one or two tasks read; what is made of its rows is a hundred times that.
    """
    spark = rows.sparkSession
    return rows.repartition(max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), key)


def files(rows: DataFrame, key: str, content: Column, prefix: str) -> DataFrame:
    """(file_id, path, length, content) of a table's carriers."""
    out = fenced(rows.withColumn("file_id", F.concat(F.lit(f"{prefix}-"), F.col(key).cast("string"))), content=content)
    return out.select("file_id", F.concat("file_id", F.lit(".bin")).alias("path"), F.octet_length("content").cast("long").alias("length"), "content")
