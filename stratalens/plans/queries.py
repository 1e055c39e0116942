"""Queries over carrier files and tables, each with the SQL that states the expected rows from the tables themselves."""

from __future__ import annotations

import hashlib
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions.detect import detected
from ..functions.packages import with_packages
from ..operators import engine, packages, relational, report
from ..sources.shared import grown, written
from . import carriers as C
from . import samples as S

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: name -> table, key, expression of the value, carrier
CARRIERS = {
    "png_text": ("customer", "c_custkey", "c_name", C.png_text),
    "jpeg_comment": ("orders", "o_orderkey", "o_orderpriority", C.jpeg_com),
    "jpeg_exif": ("orders", "o_orderkey", "date_format(o_orderdate, 'yyyy:MM:dd HH:mm:ss')", C.jpeg_exif),
    "gif_comment": ("part", "p_partkey", "p_name", C.gif_comment),
    "wav_info": ("supplier", "s_suppkey", "s_name", C.wav_info),
    "flac_vorbis": ("customer", "c_custkey", "c_name", C.flac_vorbis),
    "mp3_id3": ("customer", "c_custkey", "c_name", C.mp3_id3),
    "jxl_xmp": ("documents", "doc_id", "text", C.jxl_xmp),
    "webp_flags": ("nation", "n_nationkey", "n_name", C.webp_flags),
    "svg_meta": ("part", "p_partkey", "p_name", C.svg_meta),
}


def narrow(spark: SparkSession, sf_dir: str, name: str, *columns) -> DataFrame:
    """A table's key, which comes first, and small values, dealt to all cores."""
    rows = table(spark, sf_dir, name).select(*columns)
    return C.dealt(rows, rows.columns[0])


def files_of(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    source, key, value, carrier = CARRIERS[name]
    columns = F.col(key), F.expr(value).alias("v")
    rows = table(spark, sf_dir, source).select(*columns) if source == "documents" else narrow(spark, sf_dir, source, *columns)  # texts are not shuffled
    return C.files(rows, key, carrier(F.coalesce("v", F.lit(""))), name)


def _len(v: str) -> str:
    return f"octet_length(encode({v}))"


#: What inspection must find: table, key, kind, location, field, bytes.
EXPECTED = {
    "png_text": ("customer", "c_custkey", "personal-identity", "tEXt", "'Author'", _len("c_name")),
    "jpeg_comment": ("orders", "o_orderkey", "comment", "COM", "NULL::VARCHAR", _len("o_orderpriority")),
    "jpeg_exif": ("orders", "o_orderkey", "timestamp", "APP1 (Exif) IFD0", "'DateTime'", "20"),
    "gif_comment": ("part", "p_partkey", "comment", "Comment Extension", "'Comment'", "1 + " + _len("p_name")),
    "wav_info": ("supplier", "s_suppkey", "personal-identity", "LIST INFO", "'Artist'", _len("s_name")),
    "flac_vorbis": ("customer", "c_custkey", "personal-identity", "VORBIS_COMMENT", "'ARTIST'", "7 + " + _len("c_name")),
    "mp3_id3": ("customer", "c_custkey", "personal-identity", "ID3v2.3", "'TPE1'", "1 + " + _len("c_name")),
    "jxl_xmp": ("documents", "doc_id", "personal-identity", "xml box (XMP)", "'dc:creator'", "0"),
    "svg_meta": ("part", "p_partkey", "personal-identity", "<metadata>", "'dc:creator'", _len("p_name")),
}


def expected_sql(name: str) -> str:
    source, key, kind, place, field, size = EXPECTED[name]
    return f"SELECT '{name}-' || {key} AS file_id, 0 AS seq, '{kind}' AS kind, '{place}' AS location, {field} AS field, ({size})::BIGINT AS bytes FROM {source}"


def _hex(*parts: str) -> bytes:
    return bytes.fromhex("".join(parts).replace(" ", ""))


def _riff(form: bytes, body: bytes) -> bytes:
    return b"RIFF" + (len(body) + 4).to_bytes(4, "little") + form + body


#: The carrier without its metadata.
CLEAN = {
    "png_text": _hex(C.PNG_HEAD, C.PNG_TAIL), "jpeg_comment": _hex("FFD8", C.JPEG_TAIL), "jpeg_exif": _hex("FFD8", C.JPEG_TAIL), "gif_comment": _hex(C.GIF_HEAD, C.GIF_TAIL),
    "wav_info": _riff(b"WAVE", _hex(C.WAV_FMT, C.WAV_DATA)), "flac_vorbis": b"fLaC" + _hex("80000022", C.FLAC_INFO, C.FLAC_AUDIO), "mp3_id3": _hex(C.MP3_AUDIO),
    "jxl_xmp": _hex(C.JXL_HEAD, C.JXL_TAIL), "svg_meta": (C.SVG_HEAD + C.SVG_TAIL).encode(), "webp_flags": _riff(b"WEBP", _hex("56503858 0A000000 00000000 000000 000000", C.WEBP_CODE)),
}


def _add_carriers() -> None:
    for name in CARRIERS:

        def inspect(spark, sf_dir, name=name):
            return engine.findings(engine.decided(files_of(spark, sf_dir, name))).select("file_id", "seq", "kind", "location", "field", "bytes")

        def strip(spark, sf_dir, name=name):
            return engine.stripped(engine.decided(files_of(spark, sf_dir, name))).select("file_id", "format", F.md5("content").alias("md5"), "output_bytes")

        if name in EXPECTED:
            query(f"inspect_{name}", expected_sql(name))(inspect)
        source, key = CARRIERS[name][:2]
        form = name.split("_")[0]
        query(f"strip_{name}", f"SELECT '{name}-' || {key} AS file_id, '{form}' AS format, '{hashlib.md5(CLEAN[name]).hexdigest()}' AS md5, {len(CLEAN[name])}::BIGINT AS output_bytes FROM {source}")(strip)


_add_carriers()


@query("inspect_webp_flags", "SELECT '' AS file_id, 0 AS seq, '' AS kind, '' AS location, '' AS field, 0::BIGINT AS bytes WHERE false")
def inspect_webp_flags(spark, sf_dir):
    """A flag is no finding; its removal shows in the output only."""
    return engine.findings(engine.decided(files_of(spark, sf_dir, "webp_flags"))).select("file_id", "seq", "kind", "location", "field", "bytes")


@query("detect_pages", r"""SELECT page_id, NULL::VARCHAR AS format, CASE WHEN regexp_matches(html, '^[ \t\r\n]{0,64}(<\?xml|<svg|<!DOCTYPE)') THEN 'xml' END AS unsupported_kind,
  CASE WHEN regexp_matches(html, '^[ \t\r\n]{0,64}(<\?xml|<svg|<!DOCTYPE)') THEN 'unsupported-format' ELSE 'unrecognised-format' END AS error_kind FROM pages""")  # fmt: skip
def detect_pages(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", C.utf8(F.coalesce("html", F.lit(""))).alias("content"))
    return detected(rows).select("page_id", "format", "unsupported_kind", "error_kind")


#: First bytes in hex -> format, or refusal after '!'.
MAGICS = {
    "FFD8FFE0": "jpeg", "89504E470D0A1A0A": "png", "52494646000000005745425056503858": "webp", "524946460000000057415645": "wav", "52494646000000004156492020": "!other-riff",
    "49492A0008000000": "tiff", "4D4D002A00000008": "tiff", "49492B0008000000": "!big-tiff", "474946383961": "gif", "FF0A1234": "jxl", "0000000C4A584C200D0A870A": "jxl",
    "664C6143": "flac", "49443303000000000000664C6143": "flac", "49443303000000000000FFFB9000": "mp3", "FFFB9000": "mp3", "FFFBF000": "!", "1F8B0800": "!gzip", "52463634": "!rf64",
    "0000001466747970686569630000000068656963": "heif", "0000001466747970617669660000000061766966": "avif", "00000014667479706D736631000000006D736631": "!iso-base-media",
    "00000014667479706D703432000000006D703432": "mp4", "00000018667479704D344120000000004D3441206D703432": "m4a", "00000014667479707174202000000000": "!quicktime-movie",
    "000000146674797033677034000000006D703432": "!third-generation-partnership", "00000014667479706D703432000000006461736800": "!fragmented-mp4",
    "00000014667479704D34502000000000": "!protected-media", "0A0A255044462D312E34": "pdf", "504B0304": "!zip-container", "3C73766720786D6C6E733D22223E": "svg",
    "3C3F786D6C2076657273696F6E3D22312E30223F3E3C7376673E": "svg", "3C3F786D6C2076657273696F6E3D22312E30223F3E3C613E": "!xml", "00010203": "!",
    "4F6767530002000000000000000001000000000000000000000001" + "07" + "01766F72626973": "ogg", "4F6767530002000000000000000001000000000000000000000001" + "08" + "4F70757348656164": "opus",
    "4F6767530002000000000000000001000000000000000000000001" + "07" + "807468656F7261": "!ogg-theora",
}


@query("detect_carriers", "SELECT c_custkey, m.magic AS magic, m.format AS format, m.other AS unsupported_kind FROM customer, (VALUES " + ", ".join(f"('{k}', {repr(v) if v[0] != '!' else 'NULL::VARCHAR'}, {repr(v[1:]) if v[0] == '!' and v[1:] else 'NULL::VARCHAR'})" for k, v in MAGICS.items()) + ") m(magic, format, other)")
def detect_carriers(spark, sf_dir):
    """Every magic number, with each customer's name behind it."""
    rows = narrow(spark, sf_dir, "customer", "c_custkey", "c_name").select("c_custkey", "c_name", F.explode(F.array(*[F.lit(m) for m in MAGICS])).alias("magic"))
    rows = rows.withColumn("content", F.concat(F.unhex("magic"), C.utf8(F.coalesce("c_name", F.lit("")))))
    return detected(rows).select("c_custkey", "magic", "format", "unsupported_kind")


ALL = list(CARRIERS)


def all_files(spark, sf_dir) -> DataFrame:
    out = files_of(spark, sf_dir, ALL[0])
    for n in ALL[1:]:
        out = out.unionByName(files_of(spark, sf_dir, n))
    return out


@query("removed_groups", "SELECT CASE kind WHEN 'personal-identity' THEN 'direct' ELSE 'correlating' END AS sensitivity, CASE kind WHEN 'personal-identity' THEN 0 ELSE 1 END AS rank, kind, count(*) AS n, sum(bytes)::BIGINT AS bytes FROM (" + " UNION ALL ".join(expected_sql(n) for n in ALL if n in EXPECTED) + ") GROUP BY kind")
def removed_groups(spark, sf_dir):
    return relational.removed_groups(engine.findings(engine.decided(all_files(spark, sf_dir))), dims.dim_kind(spark))


@query("verify_residual", " UNION ALL ".join(f"SELECT '{n.split('_')[0]}' AS format, '{n}' AS carrier, count(*) AS files, count(*) AS verified, 0::BIGINT AS residual FROM {CARRIERS[n][0]}" for n in ALL))
def verify_residual(spark, sf_dir):
    checked = engine.verified(engine.stripped(engine.decided(all_files(spark, sf_dir))))
    return checked.groupBy("format", F.regexp_extract("file_id", "^(.*)-", 1).alias("carrier")).agg(F.count("*").alias("files"), F.count_if("verified").alias("verified"), F.sum("residual").alias("residual"))


@query("strip_idempotent", " UNION ALL ".join(f"SELECT '{n}-' || {CARRIERS[n][1]} AS file_id, true AS same FROM {CARRIERS[n][0]}" for n in ALL))
def strip_idempotent(spark, sf_dir):
    """Stripped carriers of every kind, stripped again: the same bytes."""
    once = written(engine.stripped(engine.decided(all_files(spark, sf_dir))).select("file_id", "path", "content"), "stripped")
    twice = engine.stripped(engine.decided(once.select("file_id", "path", "content", F.md5("content").alias("first"))))
    return twice.join(grown(once.select("file_id", F.md5("content").alias("first"))), "file_id").select("file_id", (F.md5("content") == F.col("first")).alias("same"))


_BROKEN = {
    "png_text": ("malformed", "png", "truncated", f"({len(_hex(C.PNG_HEAD)) + len(_hex(C.PNG_TAIL)) - 12 + 19} + {_len('c_name')})"), "jpeg_comment": ("malformed", "jpeg", "truncated", f"({len(_hex(C.JPEG_TAIL)) + 5} + {_len('o_orderpriority')})"),
    "gif_comment": ("malformed", "gif", "truncated", f"({len(_hex(C.GIF_HEAD)) + len(_hex(C.GIF_TAIL)) + 3} + {_len('p_name')})"),
    "wav_info": ("malformed", "wav", "length-out-of-range", "4"),
}


@query("error_rows", " UNION ALL ".join(f"SELECT '{n}-' || {CARRIERS[n][1]} AS file_id, '{k}' AS error_kind, '{f}' AS format, '{d}' AS detail, ({o})::BIGINT AS \"offset\" FROM {CARRIERS[n][0]}" for n, (k, f, d, o) in _BROKEN.items()))
def error_rows(spark, sf_dir):
    """Carriers without their last byte: each is one error, none stops the others."""
    out = None
    for n in _BROKEN:
        cut = files_of(spark, sf_dir, n).withColumn("content", F.expr("substring(content, 1, octet_length(content) - 1)"))
        out = cut if out is None else out.unionByName(cut)
    return engine.errors(out).select("file_id", "error_kind", "format", "detail", "offset")


@query("exit_code", "SELECT 'clean' AS batch, 0 AS exit_code UNION ALL SELECT 'found', 1 UNION ALL SELECT 'mixed', 3 UNION ALL SELECT 'broken', 1")
def exit_code(spark, sf_dir):
    """Batches that are clean, with findings, with findings and an unsupported file, and with a broken file."""
    png, page = files_of(spark, sf_dir, "png_text"), table(spark, sf_dir, "pages").select(F.concat(F.lit("page-"), "page_id").alias("file_id"), F.lit("p").alias("path"), F.lit(0).cast("long").alias("length"), C.utf8(F.col("html")).alias("content"))
    cut = png.withColumn("content", F.expr("substring(content, 1, octet_length(content) - 1)"))

    def outcomes(batch, files):
        rows = engine.decided(files)
        found = engine.findings(rows).select("file_id").distinct().withColumn("found", F.lit(True))
        bad = engine.errors(files).select("file_id", "error_kind")
        return files.select("file_id").join(grown(found), "file_id", "left").join(grown(bad), "file_id", "left").select(F.lit(batch).alias("batch"), "error_kind", F.coalesce("found", F.lit(False)).alias("found"))

    clean = engine.stripped(engine.decided(png)).select("file_id", "path", F.col("output_bytes").alias("length"), "content")
    rows = outcomes("clean", clean).unionByName(outcomes("found", png)).unionByName(outcomes("mixed", png.unionByName(page))).unionByName(outcomes("broken", cut))
    return relational.exit_code(rows, ["batch"])


@query("show_json", """SELECT 'wav_info-' || s_suppkey AS file_id, '{"path":"wav_info-' || s_suppkey || '.bin","format":"wav","status":"inspected","findings":[{"kind":"personal-identity","sensitivity":"direct","location":"LIST INFO","field":"Artist","bytes":' || octet_length(encode(s_name)) || ',"value":' || to_json(s_name) || '}],"notes":[{"note":"out-of-scope-content","location":"audio samples, which are copied without being decoded"}]}' AS json FROM supplier""")
def show_json(spark, sf_dir):
    files = files_of(spark, sf_dir, "wav_info")
    rows = engine.decided(files)
    return report.show_json(detected(files).select("file_id", "path", "format"), engine.findings(rows, True), engine.notes(rows), engine.errors(files))


@query("notes_wav", "SELECT 'wav_info-' || s_suppkey AS file_id, 'out-of-scope-content' AS note, 'audio samples, which are copied without being decoded' AS location FROM supplier")
def notes_wav(spark, sf_dir):
    return engine.notes(engine.decided(files_of(spark, sf_dir, "wav_info"))).select("file_id", "note", "location")


@query("mp4_relocate", """SELECT l.l_orderkey, l.l_linenumber, CASE WHEN o.o_orderkey IS NOT NULL AND (l.l_linenumber * 13) < 60 THEN l.l_linenumber * 13 + o.o_orderkey * 70 END::BIGINT AS relocated,
  CASE WHEN o.o_orderkey IS NOT NULL AND (l.l_linenumber * 13) < 60 THEN 'moved' ELSE 'broken-index' END AS status FROM lineitem l LEFT JOIN orders o ON l.l_orderkey = o.o_orderkey""")  # fmt: skip
def mp4_relocate(spark, sf_dir):
    """Chunk offsets from lineitem, media extents from orders."""
    offsets = table(spark, sf_dir, "lineitem").select(F.lit("f").alias("file_id"), "l_orderkey", "l_linenumber", (F.col("l_orderkey") * 100 + F.col("l_linenumber") * 13).alias("offset"))
    extents = table(spark, sf_dir, "orders").select(F.lit("f").alias("file_id"), (F.col("o_orderkey") * 100).alias("lo"), (F.col("o_orderkey") * 100 + 60).alias("hi"), (F.col("o_orderkey") * 70).alias("new_lo"))
    return relational.relocate(offsets, extents, 4096).select("l_orderkey", "l_linenumber", "relocated", "status")


@query("heif_thumb_antijoin", """WITH r AS (SELECT DISTINCT l_orderkey FROM lineitem WHERE l_linenumber = 1 AND l_returnflag = 'R'),
  k AS (SELECT o_custkey AS file_id, o_orderkey AS item_id, o_orderkey % 97 + 1 AS length FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM r))
  SELECT file_id, item_id, length, row_number() OVER (PARTITION BY file_id ORDER BY item_id)::INT AS new_id, coalesce(sum(length) OVER (PARTITION BY file_id ORDER BY item_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset" FROM k""")  # fmt: skip
def heif_thumb_antijoin(spark, sf_dir):
    items = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("item_id"), (F.col("o_orderkey") % 97 + 1).alias("length"))
    refs = table(spark, sf_dir, "lineitem").where("l_linenumber = 1 AND l_returnflag = 'R'").join(items.select(F.col("item_id").alias("l_orderkey"), "file_id"), "l_orderkey")
    return relational.rebuild_items(items, refs.select("file_id", F.lit("thmb").alias("kind"), F.col("l_orderkey").alias("from_id")))


@query("ogg_packets", """WITH l AS (SELECT l_suppkey AS file_id, l_orderkey * 10 + l_linenumber AS pos, CASE WHEN l_quantity > 25 THEN 255 ELSE l_quantity::INT END AS value FROM lineitem),
  n AS (SELECT *, coalesce(sum((value < 255)::INT) OVER (PARTITION BY file_id ORDER BY pos, value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS packet FROM l)
  SELECT file_id, packet::BIGINT AS packet, count(*) AS pieces, sum(value)::BIGINT AS length, bool_or(value < 255) AS complete FROM n GROUP BY file_id, packet""")  # fmt: skip
def ogg_packets(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("file_id"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("pos"), F.when(F.col("l_quantity") > 25, 255).otherwise(F.col("l_quantity").cast("int")).alias("value"))
    return relational.packets(rows)


# --- movies and stills -----------------------------------------------------------------------------------------------


def movies(spark, sf_dir, **kw) -> DataFrame:
    """A movie for each order: every second with 64-bit chunk offsets."""
    orders = narrow(spark, sf_dir, "orders", "o_orderkey", "o_orderpriority")
    short, wide = (C.mp4_tags(F.coalesce("o_orderpriority", F.lit("")), wide=w, **kw) for w in (False, True))
    return C.files(orders, "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, short).otherwise(wide), "mp4_tags")


_ATOM = "16 + octet_length(encode(o_orderpriority))"


@query("inspect_mp4", f"""SELECT 'mp4_tags-' || o_orderkey AS file_id, s AS seq, CASE s WHEN 3 THEN 'personal-identity' ELSE 'timestamp' END AS kind,
  ['moov/mvhd', 'moov/trak/tkhd', 'moov/trak/mdia/mdhd', 'moov/udta/aART'][s + 1] AS location, CASE s WHEN 3 THEN 'aART' ELSE 'creation_time, modification_time' END AS field,
  CASE s WHEN 3 THEN {_ATOM} ELSE 8 END::BIGINT AS bytes FROM orders, (VALUES (0), (1), (2), (3)) t(s)""")  # fmt: skip
def inspect_mp4(spark, sf_dir):
    """Movies with times set and an artist tag."""
    rows = engine.decided(movies(spark, sf_dir, times="00000001"))
    return engine.findings(rows).select("file_id", "seq", "kind", "location", "field", "bytes")


#: The index of a movie without tags has a fixed size by the width of its chunk offsets.
@query("strip_mp4", f"""WITH o AS (SELECT *, {C.mp4_index().fixed} + CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 8 END AS n FROM orders)
  SELECT 'mp4_tags-' || o_orderkey AS file_id, 'mp4' AS format, (20 + n + 28)::BIGINT AS output_bytes, (20 + n + 8)::BIGINT AS chunk_1, (20 + n + 16)::BIGINT AS chunk_2, 'PRESERVED-media-data' AS media, true AS same_index FROM o""")  # fmt: skip
def strip_mp4(spark, sf_dir):
    """Stripped movies: chunk offsets, read back from the output, still point at the media; the index is that of a movie without tags."""
    done = engine.stripped(engine.decided(movies(spark, sf_dir, times="00000001")))
    bare = F.when(F.col("o_orderkey") % 2 == 0, C.mp4_file().column()).otherwise(C.mp4_file(wide=True).column())
    bare = narrow(spark, sf_dir, "orders", "o_orderkey").select(F.concat(F.lit("mp4_tags-"), "o_orderkey").alias("file_id"), F.md5(bare).alias("bare"))
    wide = F.regexp_extract("file_id", "([0-9]+)$", 1).cast("long") % 2 != 0
    number = lambda back, width: F.conv(F.hex(F.substring("content", F.octet_length("content") - 27 - back, width)), 16, 10).cast("long")
    first, second = F.when(wide, number(16, 8)).otherwise(number(8, 4)), F.when(wide, number(8, 8)).otherwise(number(4, 4))
    rows = done.select("file_id", "format", "output_bytes", first.alias("chunk_1"), second.alias("chunk_2"), F.decode(F.substring("content", F.octet_length("content") - 19, 20), "UTF-8").alias("media"), F.md5("content").alias("md5"))
    return rows.join(grown(bare), "file_id").select("file_id", "format", "output_bytes", "chunk_1", "chunk_2", "media", (F.col("md5") == F.col("bare")).alias("same_index"))


def refused_movies(spark, sf_dir) -> DataFrame:
    """Five broken movies for each customer; file_id is customer/defect."""
    c = F.coalesce("c_name", F.lit(""))
    ftyp, media, c = C.hexed(C.MP4_FTYP), C.hexed(C.MP4_DATA), C.text(c)
    made = {
        "moof": C.Made(C.mp4_file(), C.box("moof", c)), "pssh": C.mp4_file(C.box("pssh", c)), "moov": C.Made(C.mp4_file(C.box("udta", c)), C.mp4_index()),
        "index": C.Made(ftyp, C.box("free", c), media), "far": C.mp4_file(C.box("free", c), start=False, at=4),
    }
    made = {k: v.column() for k, v in made.items()}
    rows = narrow(spark, sf_dir, "customer", "c_custkey", "c_name").select("c_custkey", F.explode(F.array(*[F.struct(F.lit(k).alias("defect"), v.alias("content")) for k, v in made.items()])).alias("m")).select("c_custkey", "m.*")
    return rows.select(F.concat_ws("/", F.col("c_custkey").cast("string"), "defect").alias("file_id"), F.lit("p").alias("path"), F.octet_length("content").cast("long").alias("length"), "content")


@query("mp4_refusals", "SELECT c_custkey, c.defect AS defect, c.error_kind AS error_kind, c.detail AS detail, c.other AS unsupported_kind FROM customer, (VALUES ('moof', 'unsupported-format', NULL::VARCHAR, 'fragmented-mp4'), ('pssh', 'unsupported-format', NULL, 'protected-media'), ('moov', 'malformed', 'unexpected-marker', NULL), ('index', 'malformed', 'missing-marker', NULL), ('far', 'malformed', 'broken-index', NULL)) c(defect, error_kind, detail, other)")
def mp4_refusals(spark, sf_dir):
    """Movies that are refused: fragmented, encrypted, with two indexes or none, with chunks outside the media."""
    out = engine.errors(refused_movies(spark, sf_dir))
    return out.select(F.split_part("file_id", F.lit("/"), F.lit(1)).cast("long").alias("c_custkey"), F.split_part("file_id", F.lit("/"), F.lit(2)).alias("defect"), "error_kind", "detail", "unsupported_kind")


def stills(spark, sf_dir) -> DataFrame:
    return C.files(narrow(spark, sf_dir, "part", "p_partkey", F.coalesce("p_name", F.lit("")).alias("v")), "p_partkey", C.heif_items(F.col("v")), "heif_items")


@query("inspect_heif", """SELECT 'heif_items-' || p_partkey AS file_id, s AS seq, ['colour-profile', 'other', 'thumbnail', 'personal-identity'][s + 1] AS kind,
  ['iprp/ipco', 'iinf/infe', 'item (thmb)', 'item (XMP)'][s + 1] AS location, ['colr', 'item_name', 'hvc1', 'dc:creator'][s + 1] AS field,
  CASE s WHEN 0 THEN 12 WHEN 1 THEN octet_length(encode(p_name)) WHEN 2 THEN 4 ELSE 0 END::BIGINT AS bytes FROM part, (VALUES (0), (1), (2), (3)) t(s)""")  # fmt: skip
def inspect_heif(spark, sf_dir):
    return engine.findings(engine.decided(stills(spark, sf_dir))).select("file_id", "seq", "kind", "location", "field", "bytes")


@query("strip_heif", f"SELECT 'heif_items-' || p_partkey AS file_id, 'heif' AS format, '{hashlib.md5(C.heif_clean()).hexdigest()}' AS md5, {len(C.heif_clean())}::BIGINT AS output_bytes, true AS verified FROM part")
def strip_heif(spark, sf_dir):
    """Stripped stills, each inspected again: the thumbnail, the packet, the name and the profile are gone, the picture's offset is new."""
    done = written(engine.stripped(engine.decided(stills(spark, sf_dir))), "stripped")
    return done.select("file_id", "format", F.md5("content").alias("md5"), "output_bytes").join(grown(engine.verified(done).select("file_id", "verified")), "file_id")


# --- packages --------------------------------------------------------------------------------------------------------


def documents_of(spark, sf_dir, parts: dict, name: str, picture: bool = False) -> DataFrame:
    """A package for each customer, detected by what it declares; its entries have times."""
    c = F.coalesce("c_name", F.lit(""))
    rows, content = C.packaged(narrow(spark, sf_dir, "customer", "c_custkey", "c_name"), parts, c, C.png_text(c) if picture else None, "6180 2157")
    return detected(with_packages(C.files(rows, "c_custkey", content, name), zips=True)).drop("__package")


_C = "octet_length(encode(c_name))"


def _package_sql(name: str, rows: list[tuple]) -> str:
    values = " UNION ALL ".join(f"SELECT c_custkey, c_name, {i} AS seq, '{k}' AS kind, '{p}' AS location, {repr(f) if f else 'NULL::VARCHAR'} AS field, ({b})::BIGINT AS bytes FROM customer" for i, (k, p, f, b) in enumerate(rows))
    return f"SELECT '{name}-' || c_custkey AS file_id, seq, kind, location, field, bytes FROM ({values})"


@query("inspect_docx", _package_sql("docx", [
    ("editing-history", "word/document.xml", "w:rsidR", "19"), ("editing-history", "word/document.xml", "w:rsidP", "19"), ("personal-identity", "word/document.xml", "r:id (to an external local path)", "33"),
    ("personal-identity", "word/_rels/document.xml.rels", "Relationship (external local path)", "90 + " + _C), ("personal-identity", "docProps/core.xml", "dc:creator", _C), ("editing-history", "docProps/core.xml", "cp:revision", "1"),
    ("personal-identity", "word/media/image1.png → tEXt", "Author", _C), ("timestamp", "ZIP entry headers", None, "6"),
]))
def inspect_docx(spark, sf_dir):
    """Documents with an author, revision ids, a template under somebody's home folder and a signed picture."""
    return packages.Package(documents_of(spark, sf_dir, C.DOCX, "docx", True)).findings().select("file_id", "seq", "kind", "location", "field", "bytes")


@query("strip_docx", f"SELECT 'docx-' || c_custkey AS file_id, 'docx' AS format, '{hashlib.md5(C.plain_archive(C.DOCX_CLEAN, CLEAN['png_text'])).hexdigest()}' AS md5, {len(C.plain_archive(C.DOCX_CLEAN, CLEAN['png_text']))}::BIGINT AS output_bytes FROM customer")
def strip_docx(spark, sf_dir):
    done = packages.Package(documents_of(spark, sf_dir, C.DOCX, "docx", True)).stripped()
    return done.select("file_id", "format", F.md5("content").alias("md5"), "output_bytes")


_ODT_ROWS = [
    ("personal-identity", "content.xml", "dc:creator", _C), ("timestamp", "content.xml", "dc:date", "10"), ("personal-identity", "content.xml", "text:author-name", _C),
    ("personal-identity", "meta.xml", "meta:initial-creator", _C), ("software-fingerprint", "meta.xml", "meta:generator", "8"),
    ("device-identity", "settings.xml", "config:config-item (PrinterName)", _C), ("software-fingerprint", "settings.xml", "config:config-item", "2"), ("timestamp", "ZIP entry headers", None, "5"),
]
_PROPERTIES = [("personal-identity", "docProps/core.xml", "dc:creator", _C), ("personal-identity", "docProps/app.xml", "Company", _C), ("timestamp", "ZIP entry headers", None, "6")]


@query("inspect_sheets_and_slides", " UNION ALL ".join([
    _package_sql("xlsx", [("personal-identity", "xl/comments1.xml", "author", _C), *_PROPERTIES]), _package_sql("pptx", [("personal-identity", "ppt/media/image1.png → tEXt", "Author", _C), *_PROPERTIES]),
    _package_sql("ods", _ODT_ROWS), _package_sql("odp", _ODT_ROWS),
]))
def inspect_sheets_and_slides(spark, sf_dir):
    """The other packages of both families, in one batch."""
    made = [documents_of(spark, sf_dir, parts, name, name == "pptx") for name, parts in (("xlsx", C.XLSX), ("pptx", C.PPTX), ("ods", C.ODS), ("odp", C.ODP))]
    return packages.Package(reduce(DataFrame.unionByName, made)).findings().select("file_id", "seq", "kind", "location", "field", "bytes")


@query("inspect_odt", _package_sql("odt", _ODT_ROWS))
def inspect_odt(spark, sf_dir):
    return packages.Package(documents_of(spark, sf_dir, C.ODT, "odt")).findings().select("file_id", "seq", "kind", "location", "field", "bytes")


@query("strip_odt", f"SELECT 'odt-' || c_custkey AS file_id, 'odt' AS format, '{hashlib.md5(C.plain_archive(C.ODT_CLEAN)).hexdigest()}' AS md5, {len(C.plain_archive(C.ODT_CLEAN))}::BIGINT AS output_bytes, true AS verified FROM customer")
def strip_odt(spark, sf_dir):
    """Stripped text documents, each opened and inspected again."""
    done = written(packages.Package(documents_of(spark, sf_dir, C.ODT, "odt")).stripped(), "stripped")
    return done.join(grown(packages.verified(done).select("file_id", "verified")), "file_id").select("file_id", "format", F.md5("content").alias("md5"), "output_bytes", "verified")


@query("package_notes", "SELECT 'odt-' || c_custkey AS file_id, 'out-of-scope-content' AS note, 'content.xml (comment text; its authors and dates were removed)' AS location FROM customer")
def package_notes(spark, sf_dir):
    return packages.Package(documents_of(spark, sf_dir, C.ODT, "odt")).notes().select("file_id", "note", "location")


_MANIFEST = C.ODT["META-INF/manifest.xml"]
#: Defect -> format, parts, detail.
_DEFECTS = {
    "encrypted": ("odt", {**C.ODT, "META-INF/manifest.xml": _MANIFEST.replace("</manifest:manifest>", "<manifest:encryption-data/></manifest:manifest>")}, "unsupported-feature"),
    "mismatch": ("odt", {**C.ODT, "META-INF/manifest.xml": _MANIFEST.replace("opendocument.text", "opendocument.spreadsheet")}, "broken-index"),
    "no-manifest": ("odt", {k: v for k, v in C.ODT.items() if k != "META-INF/manifest.xml"}, "missing-marker"),
    "no-main": ("docx", {**C.DOCX_CLEAN, "[Content_Types].xml": "<Types/>", "word/media/image1.png": "x"}, "missing-marker"),
    "nested": ("docx", {**C.DOCX_CLEAN, "word/media/image1.png": "PK\x03\x04NAME"}, "unsupported-feature"),
    "unsafe": ("docx", {**C.DOCX_CLEAN, "word/media/image1.png": "x", "../x": "NAME"}, "unexpected-marker"),
}


@query("package_refusals", " UNION ALL ".join(f"SELECT '{k}-' || s_suppkey AS file_id, 'malformed' AS error_kind, '{f}' AS format, '{d}' AS detail FROM supplier" for k, (f, _, d) in _DEFECTS.items()))
def package_refusals(spark, sf_dir):
    """Packages that are refused: encrypted, of two minds, without an index or a main part, with an archive inside or an unsafe name."""
    rows, out = narrow(spark, sf_dir, "supplier", "s_suppkey", F.coalesce("s_name", F.lit("")).alias("v")), None
    for name, (form, parts, _) in _DEFECTS.items():
        made = C.files(rows, "s_suppkey", C.package(parts, F.col("v")), name).withColumn("format", F.lit(form))
        out = made if out is None else out.unionByName(made)
    return packages.Package(out).errors().select("file_id", "error_kind", "format", "detail")


# --- samples of every format -----------------------------------------------------------------------------------------


def sample_files(spark, sf_dir) -> DataFrame:
    return S.files(narrow(spark, sf_dir, "supplier", "s_suppkey", "s_name"), "s_suppkey", F.col("s_name"))


def _values(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join("NULL" if v is None else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'" for v in r) + ")" for r in rows)


_FOUND = _values([(name, i, *row) for name, rows in S.FOUND.items() for i, row in enumerate(rows)])


@query("inspect_samples", f"SELECT t.sample || '/' || s_suppkey AS file_id, t.seq AS seq, t.kind AS kind, t.location AS location, t.field AS field, t.bytes::BIGINT AS bytes FROM supplier, (VALUES {_FOUND}) t(sample, seq, kind, location, field, bytes)")
def inspect_samples(spark, sf_dir):
    """A file of each format with most kinds of metadata that it can hold, for each supplier."""
    return engine.findings(engine.decided(sample_files(spark, sf_dir))).select("file_id", "seq", "kind", "location", "field", "bytes")


@query("strip_samples", f"SELECT t.sample || '/' || s_suppkey AS file_id, t.sample AS format, true AS survives, false AS leaks, 0 AS residual, true AS verified FROM supplier, (VALUES {_values([(s,) for s in S.SAMPLES])}) t(sample)")
def strip_samples(spark, sf_dir):
    """Stripped samples: the supplier's name is in none, what must survive is in all, and each is inspected again without a finding."""
    done = written(engine.stripped(engine.decided(sample_files(spark, sf_dir))), "stripped")
    name = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.rpad("s_name", 18, " ").alias("name"))
    text = F.decode("content", "ISO-8859-1")
    rows = done.withColumn("k", F.split_part("file_id", F.lit("/"), F.lit(2)).cast("long")).join(grown(name), "k")
    rows = rows.select("file_id", "format", F.contains(text, F.lit("PRESERVED")).alias("survives"), F.contains(text, F.col("name")).alias("leaks"))
    return rows.join(grown(engine.verified(done).select("file_id", "residual", "verified")), "file_id")


@query("retained_samples", f"SELECT t.sample || '/' || s_suppkey AS file_id, t.location AS location, t.reason AS reason FROM supplier, (VALUES {_values(S.KEPT)}) t(sample, location, reason)")
def retained_samples(spark, sf_dir):
    return engine.retained(engine.decided(sample_files(spark, sf_dir)))


@query("notes_samples", f"SELECT t.sample || '/' || s_suppkey AS file_id, t.note AS note, t.location AS location FROM supplier, (VALUES {_values(S.NOTED)}) t(sample, note, location)")
def notes_samples(spark, sf_dir):
    return engine.notes(engine.decided(sample_files(spark, sf_dir))).select("file_id", "note", "location")


@query("removed_by_file", f"""SELECT file_id, sensitivity, mark, kind, label, count(*) AS fields FROM (SELECT t.sample || '/' || s_suppkey AS file_id, k.sensitivity, k.mark, t.kind, k.label
  FROM supplier, (VALUES {_FOUND}) t(sample, seq, kind, location, field, bytes) JOIN (VALUES {_values([(k, s, dims.MARKS[s], dims.PLAIN_LABELS[k]) for k, s, _ in dims.KINDS])}) k(kind, sensitivity, mark, label) ON k.kind = t.kind) GROUP BY ALL""")  # fmt: skip
def removed_by_file(spark, sf_dir):
    """What was removed from each sample, by kind, in plain words."""
    return report.groups(engine.findings(engine.decided(sample_files(spark, sf_dir))))


@query("strip_summary", f"""WITH f AS (SELECT sample, count(*) AS n FROM (VALUES {_FOUND}) t(sample, seq, kind, location, field, bytes) GROUP BY sample), k AS (SELECT sample, count(*) AS n FROM (VALUES {_values(S.KEPT)}) t(sample, location, reason) GROUP BY sample)
  SELECT f.sample || '/' || s_suppkey AS file_id, f.n AS found, f.n AS removed, coalesce(k.n, 0) AS kept, 'Found ' || f.n || CASE f.n WHEN 1 THEN ' item' ELSE ' items' END || ', removed ' || f.n || CASE f.n WHEN 1 THEN ' item' ELSE ' items' END || ', kept ' || coalesce(k.n, 0) || CASE k.n WHEN 1 THEN ' item' ELSE ' items' END AS summary
  FROM supplier, f LEFT JOIN k ON f.sample = k.sample""")  # fmt: skip
def strip_summary(spark, sf_dir):
    rows = engine.decided(sample_files(spark, sf_dir))
    return report.summary(engine.findings(rows), engine.retained(rows), rows)


@query("strip_json", f"""SELECT 'wav_info-' || s_suppkey AS file_id, '{{"path":"wav_info-' || s_suppkey || '.bin","output":"/out/wav_info-' || s_suppkey || '.stripped.bin","format":"wav","status":"stripped","removed":[{{"kind":"personal-identity","sensitivity":"direct","location":"LIST INFO","field":"Artist","bytes":' || octet_length(encode(s_name)) || ',"value":' || to_json(s_name) || '}}],"notes":[{{"note":"out-of-scope-content","location":"audio samples, which are copied without being decoded"}}],"input_bytes":' || ({len(CLEAN['wav_info'])} + 20 + octet_length(encode(s_name)) + octet_length(encode(s_name)) % 2) || ',"output_bytes":{len(CLEAN['wav_info'])}}}' AS json,
  'wav_info-' || s_suppkey || '.bin -> /out/wav_info-' || s_suppkey || '.stripped.bin  [wav]' || chr(10) || '  removed !! personal identity — LIST INFO /Artist = ' || s_name || chr(10) || '  note: contains audio samples, which are copied without being decoded, which is not opened: check it by itself' AS text FROM supplier""")  # fmt: skip
def strip_json(spark, sf_dir):
    """The reports of stripped files, with values, in JSON and as text."""
    rows = engine.decided(files_of(spark, sf_dir, "wav_info"))
    done = engine.stripped(rows)
    named = relational.output_names(done.select("file_id", "path"), "/out").select("file_id", "output_path")
    facts = done.select("file_id", "path", "format", "input_bytes", "output_bytes", F.lit(None).cast("string").alias("error_kind")).join(named, "file_id")
    return report.strip_reports(facts, engine.findings(rows, True), engine.retained(rows), engine.notes(rows))


@query("cut_merge", """WITH c AS (SELECT l_suppkey AS file_id, l_orderkey AS s, l_orderkey + l_quantity::BIGINT * 20 AS e FROM lineitem),
  m AS (SELECT *, max(e) OVER (PARTITION BY file_id ORDER BY s, e ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM c),
  i AS (SELECT *, sum(CASE WHEN r IS NULL OR s > r THEN 1 ELSE 0 END) OVER (PARTITION BY file_id ORDER BY s, e ROWS UNBOUNDED PRECEDING) AS g FROM m)
  SELECT file_id, min(s) AS start, max(e) AS "end", count(*) AS n FROM i GROUP BY file_id, g""")  # fmt: skip
def cut_merge(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("file_id"), F.col("l_orderkey").alias("start"), (F.col("l_orderkey") + F.col("l_quantity").cast("long") * 20).alias("end"))
    return relational.merge_cuts(rows)


@query("xml_comments", "SELECT page_id, len(regexp_extract_all(html, '(?s)<!--.*?-->'))::INT AS n, coalesce(list_sum(list_transform(regexp_extract_all(html, '(?s)<!--.*?-->'), lambda x: octet_length(encode(x)))), 0)::BIGINT AS bytes FROM pages")
def xml_comments(spark, sf_dir):
    found = F.regexp_extract_all("html", F.lit("(?s)<!--.*?-->"), F.lit(0))
    rows = table(spark, sf_dir, "pages").select("page_id", found.alias("c"))
    return rows.select("page_id", F.size("c").alias("n"), F.aggregate(F.transform("c", lambda x: F.octet_length(x).cast("long")), F.lit(0).cast("long"), lambda a, b: a + b).alias("bytes"))


@query("html_tag_histogram", "SELECT tag, count(*) AS n FROM (SELECT unnest(regexp_extract_all(lower(html), '<(/?[a-z][a-z0-9]*)', 1)) AS tag FROM pages) GROUP BY tag")
def html_tag_histogram(spark, sf_dir):
    return table(spark, sf_dir, "pages").select(F.explode(F.regexp_extract_all(F.lower("html"), F.lit("<(/?[a-z][a-z0-9]*)"), F.lit(1))).alias("tag")).groupBy("tag").agg(F.count("*").alias("n"))


_POINTS = "SELECT event_type AS run, event_id % 3600 AS elapsed, user_id AS value, 3600 AS duration FROM events"
_GAINS = f"""WITH p AS ({_POINTS}), b AS (SELECT run, least(floor(elapsed * 6 / duration)::INT, 5) AS w, max(value) AS best FROM p GROUP BY ALL),
  e AS (SELECT DISTINCT run, unnest(range(6))::INT AS w FROM p), f AS (SELECT e.run, e.w, coalesce(max(best) OVER (PARTITION BY e.run ORDER BY e.w), 0) AS reached FROM e LEFT JOIN b ON e.run = b.run AND e.w = b.w),
  g AS (SELECT run, w AS "window", reached, reached - coalesce(lag(reached) OVER (PARTITION BY run ORDER BY w), 0) AS gain FROM f)"""


def _points(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("run"), (F.col("event_id") % 3600).alias("elapsed"), F.col("user_id").alias("value"), F.lit(3600).alias("duration"))


@query("plateau_gains", _GAINS + ' SELECT run, "window", reached, gain FROM g')
def plateau_gains(spark, sf_dir):
    return relational.gains(_points(spark, sf_dir))


@query("plateau", _GAINS + """, h AS (SELECT *, max(reached) OVER (PARTITION BY run) AS total, lag(gain) OVER (PARTITION BY run ORDER BY "window") AS prev FROM g)
  SELECT run, CASE WHEN bool_or("window" > 0 AND gain > 0.01 * total AND gain >= 2 * greatest(prev, 1)) THEN 'punctuated' WHEN bool_or("window" = 5 AND gain < 0.01 * total) THEN 'saturated' ELSE 'climbing' END AS shape FROM h GROUP BY run""")  # fmt: skip
def plateau(spark, sf_dir):
    return relational.classify(relational.gains(_points(spark, sf_dir)))


@query("tally_latest", """WITH c AS (SELECT user_id AS target, max(event_id) AS changed_at FROM events WHERE event_type = 'click' GROUP BY 1),
  v AS (SELECT e.user_id AS target, e.event_id, e.event_type FROM events e LEFT JOIN c ON e.user_id = c.target WHERE c.changed_at IS NULL OR e.event_id > c.changed_at)
  SELECT target, count(*) AS runs, count(*)::BIGINT * 2 AS hours, arg_max(event_type, event_id) AS latest FROM v GROUP BY target""")  # fmt: skip
def tally_latest(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    runs = events.select(F.col("user_id").alias("target"), F.col("event_id").alias("at"), F.lit(2).cast("long").alias("hours"), F.col("event_type").alias("result"))
    changes = events.where("event_type = 'click'").select(F.col("user_id").alias("target"), F.col("event_id").alias("changed_at"))
    return relational.tally(runs, changes)


@query("differential_gap", """SELECT 'first' AS side, n AS name FROM (SELECT DISTINCT p_brand AS n FROM part WHERE p_size < 25 EXCEPT SELECT p_brand FROM part WHERE p_size > 48)
  UNION ALL SELECT 'second', n FROM (SELECT DISTINCT p_brand AS n FROM part WHERE p_size > 48 EXCEPT SELECT p_brand FROM part WHERE p_size < 25)""")  # fmt: skip
def differential_gap(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    return relational.differential(part.where("p_size < 25").select(F.col("p_brand").alias("name")), part.where("p_size > 48").select(F.col("p_brand").alias("name")), ["name"])


@query("output_names", "SELECT path, regexp_replace(path, '\\.([^.]*)$', '.stripped.\\1') AS output_path, false AS output_exists FROM (SELECT 'supplier/' || s_suppkey || '.jpg' AS path FROM supplier)")
def output_names(spark, sf_dir):
    return relational.output_names(table(spark, sf_dir, "supplier").select(F.concat(F.lit("supplier/"), F.col("s_suppkey").cast("string"), F.lit(".jpg")).alias("path")))
