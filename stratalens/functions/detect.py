"""Format detection from content: one native CASE expression over bounded windows of the bytes. The name of a file never counts.

ZIP packages need their directory read; `zip_packages` does that, for rows that begin like a ZIP only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Magic numbers and brands.
STILL = {"avif": ("avif", "avio"), "heif": ("heic", "heix", "heim", "heis", "mif1")}
SEQUENCE = ("msf1", "avis", "hevc")
FRAGMENT = ("dash", "msdh", "msix", "cmfc", "cmfl")
MOVIE = {"m4a": ("M4A ", "M4B "), "mp4": ("isom", "iso2", "iso4", "iso5", "iso6", "mp41", "mp42", "mmp4", "avc1", "M4V ")}
#: Brands of the third generation partnership, which differ in their last character.
MOBILE = ("3gp", "3g2")
BRANDS = (*STILL["avif"], *STILL["heif"], *SEQUENCE, *FRAGMENT, *MOVIE["m4a"], *MOVIE["mp4"], "M4P ", "qt  ", *MOBILE)
#: Bytes that most tests look at. A row gives its whole content to each expression that names it, so these are taken from it once.
HEAD = 32
OGG = {"ogg": "\x01vorbis", "opus": "OpusHead", "ogg-flac": "\x7fFLAC"}


def at(content: Column, offset: int, n: int) -> Column:
    """n bytes from an offset, as latin-1 text."""
    return F.decode(F.substring(content, offset + 1, n), "ISO-8859-1")


def begins(content: Column, *magics: str) -> Column:
    """Whether the content begins with one of these byte strings, given in hex."""
    return reduce(lambda a, b: a | b, [F.startswith(content, F.unhex(F.lit(m))) for m in magics])


def brands(content: Column) -> Column:
    """The brands that have a meaning here, within the first 256 bytes of a file with an ftyp box: the major one at 8, the others from 16, four characters each.

    One pattern goes over the brands. Each of up to 61 as an array's element, searched for every name, costs many times that.
    """
    first = "".join(sorted({b[0] for b in BRANDS}))  # most places begin with none of these
    text = F.concat(F.rpad(at(content, 8, 4), 4, "\u0100"), at(content, 16, 240))  # a character that no byte is, so that a short brand is no other
    return F.regexp_extract_all(text, F.lit(rf"(?s)\G(?:.{{4}})*?(?=[{first}])(?=({'|'.join(BRANDS)})).{{4}}"), F.lit(1))


def _has(found: Column, names) -> Column:
    """Whether one of these is found. As a lambda: without one the whole CASE becomes a single generated method, too long for the JVM to compile."""
    return F.exists(found, lambda b: b.isin(*names))


def _byte(content: Column, offset: int) -> Column:
    return F.conv(F.hex(F.substring(content, offset + 1, 1)), 16, 10).cast("int")


def mpeg_frame(content: Column) -> Column:
    """Whether an MPEG audio frame header, with no reserved value, comes first."""
    b, c = (_byte(content, i) for i in (1, 2))
    bits = lambda x, shift, mask: F.shiftright(x, shift).bitwiseAND(mask)
    sync = (F.octet_length(content) >= 4) & (b.bitwiseAND(0xE0) == 0xE0)
    header = F.coalesce(sync & (bits(b, 3, 3) != 1) & (bits(b, 1, 3) != 0) & (bits(c, 4, 15) != 15) & (bits(c, 2, 3) != 3), F.lit(False))
    return F.when(begins(content, "FF"), header).otherwise(False)


def id3_then(content: Column, head: Column, marker: str) -> Column:
    """Whether a marker follows an ID3v2 tag, whose length has seven bits to a byte."""
    told = F.conv(F.hex(F.substring(head, 6, 5)), 16, 10).cast("long")  # the flags and the length, read as one number
    size = reduce(lambda t, i: t * 128 + F.shiftright(told, 8 * (3 - i)).bitwiseAND(0x7F), range(4), F.lit(0)).cast("int")
    start = size + 10 + F.when(F.shiftright(told, 32).bitwiseAND(0x10) != 0, 10).otherwise(0)
    return F.coalesce(F.decode(F.substring(content, start + 1, F.lit(len(marker))), "ISO-8859-1") == marker, F.lit(False))


def _ogg_body(content: Column, offset) -> tuple[Column, Column, Column]:
    """(flags, start of the body, end) of the page at an offset."""
    n = F.conv(F.hex(F.substring(content, offset + 27, F.lit(1))), 16, 10).cast("int")
    lacing = F.substring(content, offset + 28, n)
    sizes = F.when(n > 0, F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda t, i: t + F.conv(F.hex(F.substring(lacing, i, F.lit(1))), 16, 10).cast("int"))).otherwise(0)
    flags = F.conv(F.hex(F.substring(content, offset + 6, F.lit(1))), 16, 10).cast("int")
    return flags, offset + 27 + n, offset + 27 + n + sizes


def ogg_class(content: Column, first: Column) -> Column:
    """The codec of the first page's packet, or the refusal; null without a first page."""
    flags, body, end = _ogg_body(content, F.lit(0))
    second = F.substring(content, end + 1, F.lit(4))
    second_bos = F.coalesce((second == F.unhex(F.lit("4F676753"))) & (_ogg_body(content, end)[0].bitwiseAND(2) != 0), F.lit(False))
    head = F.decode(F.substring(content, body + 1, F.lit(8)), "ISO-8859-1")
    out = F.when(flags.bitwiseAND(2) == 0, "other-ogg-codec").when(second_bos, "multiplexed-ogg")
    for name, magic in OGG.items():
        out = out.when(head.startswith(magic), name)
    return F.when(begins(first, "4F676753"), out.when(head.startswith("\x80theora"), "ogg-theora").otherwise("other-ogg-codec"))


def may_be_picture(content: Column) -> Column:
    """Whether the first bytes are those of a picture that packages hold; others are of none of dims.EMBEDDED."""
    head = F.substring(content, 1, HEAD)
    return F.coalesce(begins(head, "FFD8FF", "89504E470D0A1A0A", "52494646", "49492A00", "4D4D002A", "474946383761", "474946383961") | (at(head, 4, 4) == "ftyp"), F.lit(False))


def is_svg(content: Column) -> Column:
    """Whether the first element is svg, after at most 64 declarations, comments, instructions or doctypes in 8,192 bytes."""
    window = F.substring(content, 1, 8192)
    text = F.when(F.is_valid_utf8(window.cast("string")), window.cast("string")).otherwise("")
    bare = F.regexp_replace(text, r"^﻿*\s*((<!--[\s\S]*?-->|<\?[\s\S]*?\?>|<!(?!--)[^>]*>)\s*){0,64}", "")
    return F.rlike(bare, F.lit(r"^<svg([ \t\r\n>/]|$)"))


def _xml(content: Column) -> Column:
    return F.rlike(at(content, 0, 128), F.lit(r"^(ï»¿)?[ \t\r\n]{0,64}(<\?xml|<svg|<!DOCTYPE)"))


def supported(content: Column, package: Column | None = None) -> Column:
    """The format that has a handler, else null, beside __head, __ftyp, __brands and __ogg. The order of the tests is part of the meaning."""
    head, found, ftyp, ogg = F.col("__head"), F.col("__brands"), F.col("__ftyp"), F.col("__ogg")
    movie, still = ~_has(found, (*FRAGMENT, "M4P ", "qt  ", *MOBILE)), ~_has(found, SEQUENCE)
    out = (
        F.when(begins(head, "FFD8FF"), "jpeg").when(begins(head, "89504E470D0A1A0A"), "png")
        .when(begins(head, "52494646") & (at(head, 8, 4) == "WEBP"), "webp").when(begins(head, "52494646") & (at(head, 8, 4) == "WAVE"), "wav")
        .when(begins(head, "49492A00", "4D4D002A"), "tiff").when(begins(head, "474946383761", "474946383961"), "gif")
        .when(begins(head, "0000000C4A584C200D0A870A", "FF0A"), "jxl")
        .when(begins(head, "664C6143") | id3_then(content, head, "fLaC"), "flac").when(begins(head, "494433") | mpeg_frame(head), "mp3")
        .when(ogg.isin(*OGG), ogg)
    )
    for name, names in STILL.items():
        out = out.when(ftyp & still & _has(found, names), name)
    for name, names in MOVIE.items():
        out = out.when(ftyp & movie & _has(found, names), name)
    out = out.when(F.locate("%PDF-", at(content, 0, 1024)) > 0, "pdf")
    if package is not None:
        out = out.when(package.isin("docx", "xlsx", "pptx", "odt", "ods", "odp"), package)
    return out.when(is_svg(content), "svg")


def unsupported(content: Column, package: Column | None = None) -> Column:
    """What an unsupported file is, if that is known, beside __head, __ftyp, __brands and __ogg."""
    head, found, ftyp, ogg = F.col("__head"), F.col("__brands"), F.col("__ftyp"), F.col("__ogg")
    zipped = begins(head, "504B0304", "504B0506", "504B0708")
    named = F.lit("zip-container") if package is None else F.when(package.isin("macro-enabled-office", "other-open-document"), package).otherwise("zip-container")
    return (
        F.when(zipped, named).when(begins(head, "49492B00", "4D4D002B"), "big-tiff")
        .when(ftyp & _has(found, FRAGMENT), "fragmented-mp4").when(ftyp & _has(found, ("M4P ",)), "protected-media").when(ftyp & _has(found, ("qt  ",)), "quicktime-movie")
        .when(ftyp & _has(found, MOBILE), "third-generation-partnership").when(ftyp, "iso-base-media")
        .when(ogg.isNotNull(), ogg).when(begins(head, "4F676753"), "other-ogg-codec").when(begins(head, "52463634", "42573634"), "rf64")
        .when(begins(head, "52494646"), "other-riff").when(begins(head, "1F8B"), "gzip").when(_xml(content), "xml")
    )


def fenced(rows, **columns: Column):
    """rows with these columns, made once: a one-row generator keeps the optimizer from writing them out again wherever they are used."""
    return rows.select("*", F.inline(F.array(F.struct(*[c.alias(n) for n, c in columns.items()]))))


def detected(files, content: str = "content"):
    """files with format, unsupported_kind and error_kind: exactly one of format and error_kind is set. A null content is unrecognised."""
    c = F.coalesce(F.col(content), F.unhex(F.lit("")))
    package = F.col("__package") if "__package" in files.columns else None
    facts = fenced(files, __head=F.substring(c, 1, HEAD))
    head, there = F.col("__head"), F.col(content).isNotNull()
    named = F.when(at(head, 4, 4) == "ftyp", brands(c))  # read once, and of files with such a box only
    facts = fenced(facts, __ftyp=at(head, 4, 4) == "ftyp", __brands=named, __ogg=ogg_class(c, head))
    out = fenced(facts, format=F.when(there, supported(c, package)))
    out = fenced(out, __other=F.when(there & F.col("format").isNull(), unsupported(c, package))).drop("__head", "__ftyp", "__brands", "__ogg")
    kind = F.when(F.col("format").isNull(), F.when(F.col("__other").isNotNull(), "unsupported-format").otherwise("unrecognised-format"))
    return out.withColumns({"unsupported_kind": F.when(F.col("format").isNull(), F.col("__other")), "error_kind": kind}).drop("__other")
