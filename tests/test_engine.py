"""Walkers, rules, reports and sinks: planted values must go, planted content must stay, broken files are rows."""

import base64
import os
import struct
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from stratalens import catalog, dims
from stratalens.functions.detect import detected
from stratalens.operators import engine, isobmff, markup, rebuilders, relational, walkers
from stratalens.plans import batch, queries
from stratalens.sources import filewalk, sink


def chunk(kind, body):
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def riff(form, *chunks):
    body = form + b"".join(k + struct.pack("<I", len(p)) + p + b"\0" * (len(p) % 2) for k, p in chunks)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def tiff(entries, extra=b""):
    out = b"II*\0\x08\0\0\0" + struct.pack("<H", len(entries))
    return out + b"".join(struct.pack("<HHI", t, k, n) + v for t, k, n, v in entries) + b"\0\0\0\0" + extra


def box(kind, body):
    return struct.pack(">I", 8 + len(body)) + kind + body


def ogg(*packets):
    """One page for each packet but the last two, which share one; a serial that must not stay."""
    made = [[p, bytes(8), i != len(packets) - 2] for i, p in enumerate(packets)]
    return rebuilders.ogg_file(made)


def page(entries, data, following=0, at=8):
    entries = sorted(entries)
    n = len(entries) + 2
    strips = [(0x0111, 4, 1, struct.pack("<I", at + 2 + 12 * n + 4)), (0x0117, 4, 1, struct.pack("<I", len(data)))]
    out = struct.pack("<H", n) + b"".join(struct.pack("<HHI", t, k, c) + v for t, k, c, v in sorted([*entries, *strips]))
    return out + struct.pack("<I", following) + data


SHORT = lambda v: struct.pack("<HH", v, 0)
SIZE = [(0x0100, 3, 1, SHORT(1)), (0x0101, 3, 1, SHORT(1))]
COMMENTS = struct.pack("<I", 3) + b"VEN" + struct.pack("<I", 1) + struct.pack("<I", 16) + b"ARTIST=SYNTHETIC"
PNG = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", bytes(13))
FMT = (b"fmt ", bytes(16))
FILES = {
    "png_all": PNG + chunk(b"tEXt", b"Author\0SYNTHETIC-NAME") + chunk(b"zTXt", b"Comment\0\0xx") + chunk(b"iTXt", b"Title\0\0\0en\0\0SYNTHETIC-T") + chunk(b"tIME", b"\x07\xe8\1\2\3\4\5")
    + chunk(b"pHYs", bytes(9)) + chunk(b"eXIf", tiff([(0x010F, 2, 4, b"abc\0")])) + chunk(b"iCCP", b"SYNTHETIC-P\0\0z") + chunk(b"quIx", b"q") + chunk(b"QUIX", b"PRESERVED-Q") + chunk(b"IDAT", b"PRESERVED-D") + chunk(b"IEND", b"") + b"SYNTHETIC-TAIL",
    "jpeg_all": b"\xff\xd8\xff\xe0\0\x13JFIF\0\1\1\0\0\1\0\1\1\1abc" + b"\xff\xff\xe1" + struct.pack(">H", 2 + 6 + len(t := tiff([(0x8825, 4, 1, struct.pack("<I", 38)), (0x0110, 2, 2, b"m\0\0\0")], struct.pack("<H", 1) + struct.pack("<HHI", 2, 5, 3) + bytes(8)))) + b"Exif\0\0" + t
    + b"\xff\xee\0\x0eAdobe" + bytes(7) + b"\xff\xfe\0\x0bSYNTHETIC" + b"\xff\xda\0\4\1\0PRESERVED\xff\0\xff\xd0x\xff\xd9" + b"\xff\xd8again",
    "gif_all": b"GIF89a\1\0\1\0\0\0\0" + b"!\xff\x0bNETSCAPE2.0\3\1\0\0\0" + b"!\xf9\4\0\0\0\0\0" + b"!\1\x0c" + bytes(12) + b"\0" + b"!\xfe\x09SYNTHETIC\0" + b"!\xff\x0bXMP DataXMP\x0axdc:titlex\0" + b",\0\0\0\0\1\0\1\0\0\2\2D\1\0;tail",
    "wav_all": riff(b"WAVE", FMT, (b"LIST", b"INFOIART" + struct.pack("<I", 9) + b"SYNTHETIC\0"), (b"bext", b"SYNTHETIC-D".ljust(256, b"\0") + bytes(400)), (b"JUNK", b"SYNTH"), (b"smpl", b"x"), (b"iXML", b"<x/>"), (b"data", b"PRESERVED-A")),
    "webp_all": riff(b"WEBP", (b"VP8X", b"\x2c" + bytes(9)), (b"ICCP", b"SYNTHETIC"), (b"ANMF", bytes(16) + b"VP8L" + struct.pack("<I", 4) + b"KEPT" + b"JUNQ" + struct.pack("<I", 2) + b"zz"), (b"EXIF", b"Exif\0\0" + tiff([(0x013B, 2, 4, b"SYN\0")])), (b"XMP ", b"exif:GPS")),
    "flac_all": b"fLaC\0\0\0\x22" + bytes(18) + b"m" * 16 + b"\1\0\0\2zz" + b"\4\0\0\x19" + struct.pack("<I", 3) + b"VEN" + struct.pack("<I", 2) + struct.pack("<I", 4) + b"GPS=" + struct.pack("<I", 2) + b"zz" + b"\x86\0\0\4\0\0\0\3" + b"\xff\xf8PRESERVED" + b"TAG" + b"SYNTHETIC".ljust(125, b"\0"),
    "mp3_all": b"ID3\4\0\0\0\0\0\x14TIT2\0\0\0\x0a\0\0\3SYNTHETIC" + b"\0\0" + b"\xff\xfb\x90\0" + bytes(32) + b"Xing" + b"PRESERVED" + b"APETAGEX" + struct.pack("<IIII", 2000, 32 + 8 + 5 + 3, 1, 0x80000000) + bytes(8) + struct.pack("<II", 3, 0) + b"Year\x002024"[:8] + b"APETAGEX" + struct.pack("<IIII", 2000, 48, 1, 0x80000000) + bytes(8),
    "jxl_all": bytes.fromhex("0000000C4A584C200D0A870A") + box(b"ftyp", b"jxl \0\0\0\0jxl ") + box(b"Exif", b"\0\0\0\0" + tiff([(0x0131, 2, 4, b"SYN\0")])) + box(b"xml ", b"tiff:Make") + box(b"brob", b"xml SYNTHETIC") + box(b"jbrd", b"SYNTHETIC") + box(b"jxlc", b"\xff\x0aPRESERVED"),
    "ogg_all": ogg(b"\x01vorbis", b"\x03vorbis" + COMMENTS + b"\1", b"\x05vorbisPRESERVED", b"PRESERVED" * 100, b"x"),
    "opus_all": ogg(b"OpusHead", b"OpusTags" + COMMENTS, b"PRESERVED", b"y" * 510),
    "ogg-flac_all": ogg(b"\x7fFLAC\1\0\0\2fLaC\0\0\0\x22" + bytes(18) + b"m" * 16, b"\4" + len(COMMENTS).to_bytes(3) + COMMENTS, b"\x86\0\0\x09SYNTHETIC", b"\xff\xf8PRESERVED", b"z"),
    "svg_all": b'<?xml version="1.0"?><!-- SYNTHETIC --><?gen SYNTHETIC?><svg xmlns="http://www.w3.org/2000/svg" xmlns:i="http://x/" i:docname="SYNTHETIC" viewBox="0 0 1 1"><metadata><rdf:RDF><dc:creator><cc:Agent><dc:title>SYNTHETIC-P</dc:title></cc:Agent></dc:creator><dc:date>SYNTHETIC-D</dc:date></rdf:RDF></metadata>'
    b'<i:view a=">"><i:view/></i:view><title>PRESERVED-T</title><style>a{b:"/*PRESERVED*/"}/* SYNTHETIC */</style><image href="http://far/PRESERVED.png"/><image href=\'data:image/png;base64,' + base64.b64encode(PNG + chunk(b"tEXt", b"Author\0SYNTHETIC") + chunk(b"IDAT", b"x") + chunk(b"IEND", b"")) + b"'/><rect/></svg>",
    "tiff_all": b"II*\0\x08\0\0\0" + (p1 := page([*SIZE, (0x0131, 2, 4, b"SYN\0"), (0x00FE, 4, 1, bytes(4))], b"PRESERVED-1 ", 98)) + page([*SIZE, (0x00FE, 4, 1, b"\1\0\0\0")], b"SYNTHETIC-T ", 0, 8 + len(p1)),
}
BAD = {
    "svg_script": b'<svg onload="x()"></svg>', "svg_subset": b"<!DOCTYPE svg [ <!ENTITY a 'b'> ]><svg/>",
    "jxl_box": FILES["jxl_all"] + box(b"what", b""), "png_short": FILES["png_all"][:40], "png_first": b"\x89PNG\r\n\x1a\n" + chunk(b"IDAT", b""), "wav_list": riff(b"WAVE", FMT, (b"LIST", b"wavlx"), (b"data", b"")),
    "webp_none": riff(b"WEBP", (b"VP8X", bytes(10))), "unknown": b"\0\1\2", "empty": b"", "gzip": b"\x1f\x8b\x08", "pdf": b"%PDF-1.4",
}


@pytest.fixture(scope="module")
def rows(spark):
    data = [(k, f"{k}.bin", len(v), bytearray(v)) for k, v in {**FILES, **BAD}.items()] + [("none", "none", None, None)]
    return spark.createDataFrame(data, "file_id string, path string, length bigint, content binary").cache()


@pytest.fixture(scope="module")
def made(rows):
    return engine.decided(rows)


def test_findings(made):
    got = {}
    for r in engine.findings(made, True).orderBy("file_id", "seq").collect():
        got.setdefault(r.file_id, []).append((r.kind, r.location, r.field, r.bytes, r.value_text))
    assert got["png_all"] == [
        ("personal-identity", "tEXt", "Author", 14, "SYNTHETIC-NAME"), ("comment", "zTXt", "Comment", 11, None), ("comment", "iTXt", "Title", 23, "SYNTHETIC-T"), ("timestamp", "tIME", "tIME", 7, "2024-01-02T03:04:05Z"),
        ("device-identity", "eXIf IFD0", "Make", 4, "abc"), ("colour-profile", "iCCP", "SYNTHETIC-P", 14, None), ("other", "quIx", None, 1, None), ("other", "trailing data after IEND", None, 14, None),
    ]
    assert got["jpeg_all"] == [
        ("thumbnail", "APP0 (JFIF thumbnail)", None, 3, None), ("location", "APP1 (Exif) GPS IFD", "GPSLatitude", 24, None), ("device-identity", "APP1 (Exif) IFD0", "Model", 2, "m"),
        ("comment", "COM", None, 9, "SYNTHETIC"), ("thumbnail", "trailing data after EOI", None, 7, None),
    ]
    assert got["gif_all"] == [("comment", "Plain Text Extension", "PlainText", 13, None), ("comment", "Comment Extension", "Comment", 10, "SYNTHETIC"), ("comment", "Application Extension (XMP)", "dc:title", 0, None), ("other", "trailing data after the trailer", None, 4, None)]
    assert ("personal-identity", "LIST INFO", "Artist", 9, "SYNTHETIC") in got["wav_all"] and ("comment", "bext", "Description", 256, "SYNTHETIC-D") in got["wav_all"] and ("other", "JUNK", None, 5, None) in got["wav_all"]
    assert [x[:3] for x in got["webp_all"]] == [("colour-profile", "ICCP", None), ("other", "ANMF JUNQ", None), ("personal-identity", "EXIF IFD0", "Artist"), ("location", "XMP", "exif:GPS")]
    assert [x[:3] for x in got["flac_all"]] == [("comment", "ID3v1", "Title"), ("other", "PADDING", "Padding"), ("software-fingerprint", "VORBIS_COMMENT", "vendor"), ("location", "VORBIS_COMMENT", "GPS"), ("other", "VORBIS_COMMENT", "zz"), ("thumbnail", "PICTURE", "PictureType 3")]
    assert ("comment", "ID3v2.4", "TIT2", 10, "SYNTHETIC") in got["mp3_all"]
    svg = {(k, p, f) for k, p, f, _, _ in got["svg_all"]}
    assert {("comment", "<!-- -->", None), ("software-fingerprint", "<? ?>", None), ("personal-identity", "<svg i:docname>", "i:docname"), ("personal-identity", "<metadata>", "dc:title"), ("timestamp", "<metadata>", "dc:date"), ("software-fingerprint", "<i:view>", None), ("comment", "<style> (/* */)", None)} <= svg
    assert ("personal-identity", "<image href> (data: URI) tEXt", "Author") in svg
    artist = ("personal-identity", "ARTIST", 16, "SYNTHETIC")
    assert [(k, f, b, v) for k, _, f, b, v in got["ogg_all"]] == [("software-fingerprint", "vendor", 3, "VEN"), artist] == [(k, f, b, v) for k, _, f, b, v in got["opus_all"]]
    assert ("thumbnail", "PICTURE", None, 9, None) in got["ogg-flac_all"] and ("software-fingerprint", "TIFF IFD0", "Software", 4, "SYN") in got["tiff_all"] and ("thumbnail", "TIFF reduced-resolution IFD", "reduced-resolution image", 0, None) in got["tiff_all"]
    assert [x[:3] for x in got["jxl_all"]] == [("software-fingerprint", "Exif box IFD0", "Software"), ("device-identity", "xml box (XMP)", "tiff:Make"), ("other", "brob box (Brotli-compressed metadata)", "xml "), ("other", "jbrd box (JPEG reconstruction data)", None)]


def test_outputs_lose_what_identifies_and_keep_the_rest(made):
    out = {r.file_id: bytes(r.content) for r in engine.stripped(made).collect()}
    assert set(out) == set(FILES)
    for name, data in out.items():
        assert b"SYNTH" not in data and b"SYN\0" not in data, name
        assert ("PRESERVED" not in str(FILES[name])) or b"PRESERVED" in data, name
    assert out["flac_all"][4] == 0 and out["flac_all"][4 + 4 + 34] == 0x81 and b"KEPT" in out["webp_all"] and out["webp_all"][20] == 0


def test_outputs_verify_and_strip_to_themselves(made):
    once = engine.stripped(made)
    assert all(r.verified for r in engine.verified(once).collect()) and engine.verified(once).count() == len(FILES)
    first = {r.file_id: bytes(r.content) for r in once.collect()}
    again = engine.stripped(engine.decided(once.select("file_id", "path", "content")))
    assert {r.file_id: bytes(r.content) for r in again.collect()} == first


def test_errors_are_rows(rows):
    got = {r.file_id: (r.error_kind, r.detail, r.unsupported_kind) for r in engine.errors(rows).collect()}
    assert got == {
        "jxl_box": ("unsupported-format", None, "unknown-jxl-box"), "png_short": ("malformed", "truncated", None), "png_first": ("malformed", "missing-marker", None), "wav_list": ("unsupported-format", None, "wave-list"),
        "svg_script": ("unsupported-format", None, "scripted-svg"), "svg_subset": ("unsupported-format", None, "xml"),
        "webp_none": ("malformed", "missing-marker", None), "unknown": ("unrecognised-format", None, None), "empty": ("unrecognised-format", None, None), "gzip": ("unsupported-format", None, "gzip"), "pdf": ("not-yet-implemented", None, None), "none": ("unrecognised-format", None, None),
    }


def test_retained_and_notes(made):
    kept = {(r.file_id, r.location, r.reason) for r in engine.retained(made).collect()}
    assert {("png_all", "pHYs", "removal-would-alter-payload"), ("jpeg_all", "APP14 (Adobe)", "removal-would-alter-payload"), ("jpeg_all", "APP0 (JFIF)", "removal-would-alter-payload"), ("wav_all", "JUNK", "structurally-required")} <= kept
    assert ("flac_all", "STREAMINFO (MD5 of the unencoded audio)", "derived-from-payload") in kept
    assert ("svg_all", "<title>", "removal-would-alter-payload") in kept and ("svg_all", "<image href> (a reference outside this document)", "removal-would-alter-payload") in kept
    told = {(r.file_id, r.note, r.location) for r in engine.notes(made).collect()}
    assert ("png_all", "unparsed-region", "QUIX") in told and ("wav_all", "capability-removed", "smpl") in told and ("jxl_all", "capability-removed", "the jbrd box (JPEG bitstream reconstruction data)") in told


def test_truncation_and_flipped_bytes_never_raise():
    for name, data in FILES.items():
        kind = name.split("_")[0]
        for n in range(0, len(data), 3):
            engine.walk_file(kind, data[:n])
            engine.walk_file(kind, data[:n] + bytes([data[n] ^ 0xFF]) + data[n + 1 :])
    assert engine.walk_file("png", None)[1]["detail"] == "missing-marker"


def test_walkers_cover_what_the_rules_name():
    assert set(walkers.WALKERS) | set(rebuilders.WALKERS) | set(markup.WALKERS) | set(isobmff.WALKERS) == set(dims.WALKED) == {r[0] for r in dims.RULES}
    assert {k for _, _, _, k, *_ in dims.items()} <= {k for k, *_ in dims.KINDS}


@pytest.mark.parametrize("name", [n for n in catalog.ORACLES if n not in ("exit_code",)])
def test_oracles(spark, sf, name):
    con = duckdb.connect()
    for t in "nation customer supplier part orders lineitem events documents pages".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    result = con.execute(catalog.ORACLES[name])
    columns = [c[0] for c in result.description]
    want = sorted(map(repr, result.fetchall()))
    out = catalog.QUERIES[name](spark, sf)
    assert sorted(columns) == sorted(out.columns)
    assert sorted(repr(tuple(r)) for r in out.select(*columns).collect()) == want


def test_walk_show_and_strip_a_folder(spark, tmp_path):
    (tmp_path / "in/sub").mkdir(parents=True)
    for name in ("png_all", "wav_all"):
        (tmp_path / "in/sub" / f"{name}.bin").write_bytes(FILES[name])
    (tmp_path / "in/.dot").write_bytes(b"")
    (tmp_path / "in/bad.png").write_bytes(BAD["png_short"])
    os.symlink(tmp_path / "in/bad.png", tmp_path / "in/link")
    rows = filewalk.walk(spark, [str(tmp_path / "in")])
    assert {os.path.basename(r.path) for r in filewalk.files(rows).collect()} == {"png_all.bin", "wav_all.bin", ".dot", "bad.png"}
    assert [(os.path.basename(r.path), r.reason) for r in filewalk.skipped(rows).collect()] == [("link", "symbolic-link")]
    small = filewalk.walk(spark, [str(tmp_path / "in")], max_bytes=10)
    assert {r.error_kind for r in filewalk.failed(small).collect()} == {"input-too-large"}
    shown = {os.path.basename(r.file_id): r.json for r in batch.show(spark, [str(tmp_path / "in")], True).collect()}
    assert len(shown) == 5 and '"status":"skipped"' in shown["link"] and '"status":"failed"' in shown[".dot"] and "SYNTHETIC-NAME" in shown["png_all.bin"]
    assert not any("SYNTHETIC-NAME" in r.json or "SYNTHETIC-D" in r.json for r in batch.show(spark, [str(tmp_path / "in")]).collect())
    (tmp_path / "out").mkdir()
    for expected in (None, "output-exists"):
        done = {os.path.basename(r.file_id): r for r in batch.strip(spark, [str(tmp_path / "in")], str(tmp_path / "out")).collect()}
        assert done["png_all.bin"].error_kind == expected and done["bad.png"].error_kind == "malformed"
    written = tmp_path / "out/png_all.stripped.bin"
    assert b"SYNTHETIC" not in written.read_bytes() and written.stat().st_mode & 0o777 == 0o600
    assert sorted(os.listdir(tmp_path / "out")) == ["png_all.stripped.bin", "wav_all.stripped.bin"]


def test_sink_leaves_nothing_partial(tmp_path):
    target = tmp_path / "a"
    assert sink.put(str(target), b"one", "1", False) is None and sink.put(str(target), b"two", "2", False) == "output-exists" and target.read_bytes() == b"one"
    assert sink.put(str(target), b"two", "3", True) is None and target.read_bytes() == b"two" and os.listdir(tmp_path) == ["a"]
    assert sink.put(str(tmp_path / "no/b"), b"x", "4", False) == "io"


def test_names_that_meet_are_decided_by_path(spark):
    df = spark.createDataFrame([("b/x.png",), ("a/x.png",), ("a/y",)], "path string")
    got = {r.path: (r.output_path, r.output_exists) for r in relational.output_names(df, "/out").collect()}
    assert got == {"a/x.png": ("/out/x.stripped.png", False), "b/x.png": ("/out/x.stripped.png", True), "a/y": ("/out/y.stripped", False)}


def test_detection_of_nothing(spark):
    df = spark.createDataFrame([(None,), (bytearray(b""),)], "content binary")
    assert {(r.format, r.error_kind) for r in detected(df).collect()} == {(None, "unrecognised-format")}
    assert queries.QUERIES.keys() >= queries.ORACLES.keys()


def zipped(**parts):
    import io
    import zipfile

    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr({"types": "[Content_Types].xml", "manifest": "META-INF/manifest.xml"}.get(name, name), text)
    return out.getvalue()


def test_packages_say_what_they_are(spark):
    from stratalens.functions.packages import with_packages

    odf = "application/vnd.oasis.opendocument."
    cases = {
        "docx": zipped(types="x/wordprocessingml.document.main+xml"), "xlsx": zipped(types="spreadsheetml.sheet.main+xml"), "odt": zipped(mimetype=odf + "text"), "ods": zipped(manifest=f'<a:file-entry a:media-type="x" a:full-path="/y"/><m:file-entry m:full-path="/" m:media-type="{odf}spreadsheet"/>'),
        "!macro-enabled-office": zipped(types="wordprocessingml.document.macroEnabled.main+xml"), "!other-open-document": zipped(mimetype=odf + "graphics"), "!zip-container": zipped(a="b"), "! zip-container": b"PK\3\4broken", "png": PNG,
    }
    df = spark.createDataFrame([(k, bytearray(v)) for k, v in cases.items()], "file_id string, content binary")
    got = {r.file_id: r.format or r.unsupported_kind for r in detected(with_packages(df)).collect()}
    assert got == {k: k.strip("! ") for k in cases}


def test_streaming_landing(spark, tmp_path, rows):
    from stratalens.streaming.landing import inspect_stream

    from stratalens.plans import carriers

    sheet = spark.range(1).select(F.lit("sheet").alias("file_id"), F.lit("p").alias("path"), carriers.package(carriers.XLSX, F.lit("SYNTHETIC")).alias("content"))
    rows.where(F.col("content").isNotNull()).select("file_id", "path", "content").unionByName(sheet).write.parquet(str(tmp_path / "land"))
    stream = spark.readStream.schema("file_id string, path string, content binary").parquet(str(tmp_path / "land"))
    inspect_stream(stream, str(tmp_path / "found"), str(tmp_path / "errors"), str(tmp_path / "check")).awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "errors")).count() == len(BAD)
    found = spark.read.parquet(str(tmp_path / "found"))
    assert found.select("file_id").distinct().count() == len(FILES) + 1 and {r.field for r in found.where("file_id = 'sheet'").collect()} == {"author", "dc:creator", "Company"}


def test_records_of_runs(spark, tmp_path):
    from stratalens.sources import runs

    for name, date, seconds in (("a", "2026-01-02T03:04:05Z", 7200), ("b-aborted", "2026-01-03T00:00:00Z", 60), ("c", "never", 7200)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "summary.md").write_text(f"# run\n- Date: {date}\n- Duration: {seconds}s\n\n| target | cov | gain | time | rate | crashes |\n|---|---|---|---|---|---|\n| png | 1200 | 30 | {seconds}s of 7200s | 9 | 0 |\n| gif | 5 | 0 | {seconds}s of 7200s | 9 | 2 |\n")
        (tmp_path / name / "cov-png.tsv").write_text("0\t10\n60\t20\nbad line\n1\t2\t3\n70\tx\n")
    assert sorted((r.run, r.target, str(r.date), r.elapsed, r.value) for r in runs.curves(spark, str(tmp_path)).collect()) == [("a", "png", "2026-01-02", 0, 10), ("a", "png", "2026-01-02", 60, 20)]
    got = sorted((r.run, r.target, r.seconds, r.crashes, r.aborted) for r in runs.collected(spark, str(tmp_path)).collect())
    assert got == [("a", "gif", 7200, 2, False), ("a", "png", 7200, 0, False), ("b-aborted", "gif", 60, 2, True), ("b-aborted", "png", 60, 0, True)]


def test_files_in_a_store_and_plain_files_are_read_alike(spark, tmp_path):
    from pyarrow import fs

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a").write_bytes(b"abc")
    assert filewalk.children(f"file://{tmp_path}/in") == filewalk.children(f"{tmp_path}/in") == [(f"{tmp_path}/in/a", "file", 3, None)]
    assert filewalk.read(f"file://{tmp_path}/in/a", 10) == (3, b"abc", None, None) and filewalk.read(f"{tmp_path}/in/a", 2)[2] == "input-too-large"
    # A store without links: what the Arrow file system lists is taken as it is.
    name = f"mock-{os.getpid()}"
    store = fs.LocalFileSystem()
    filewalk_remote, filewalk_local = filewalk.remote, filewalk.local
    try:
        filewalk.remote = sink.remote = lambda path: (store, path.removeprefix(f"{name}://"), f"{name}://")
        root = f"{name}://{tmp_path}/in"
        assert filewalk.root_entry(root)[:2] == (root, "folder") and filewalk.children(root) == [(f"{root}/a", "file", 3, None)]
        assert filewalk.read(f"{root}/a", 10)[:2] == (3, b"abc") and filewalk.root_entry(f"{root}/none")[1] == "unreadable"
        assert sink.put(f"{root}/b", b"one", "1", False) is None and sink.put(f"{root}/b", b"two", "2", False) == "output-exists" and sink.put(f"{root}/b", b"two", "3", True) is None
        assert (tmp_path / "in/b").read_bytes() == b"two" and sorted(os.listdir(tmp_path / "in")) == ["a", "b"]
    finally:
        filewalk.remote, filewalk.local, sink.remote = filewalk_remote, filewalk_local, filewalk_remote


@pytest.mark.parametrize("made", ["movies", "refused_movies", "stills", "sample_files"])
def test_narrow_rows_are_dealt_to_all_cores_before_they_are_files(spark, sf, made):
    from stratalens.plans import queries

    assert getattr(queries, made)(spark, sf).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism  # one file with one group of rows


@pytest.mark.parametrize("name", ["movie_chunks", "strip_odt", "report_sections", "movie_relaid_refusals"])
def test_no_table_that_grows_with_the_input_is_broadcast(spark, sf, name):
    import re

    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.findall(r"BroadcastHashJoin \[[^\]]*(?:file_id|\bno|chunk)#[^\n]*", plan)


def test_brands_are_those_with_a_meaning_at_their_places(spark):
    from stratalens.functions.detect import brands, detected

    files = {
        "both": b"\0\0\0\x18ftypmp42\0\0\0\0isomxxxx", "shifted": b"\0\0\0\x18ftypxxxx\0\0\0\0xisomxxx", "minor": b"\0\0\0\x18ftypxxxxisomxxxx", "phone": b"\0\0\0\x18ftypisom\0\0\0\0\x003g23gp9",
        "short": b"\0\0\0\x18ftypM4A", "short phone": b"\0\0\0\x18ftyp3gp", "cut": b"\0\0\0\x18ftypmp42\0\0\0\0iso", "far": b"\0\0\0\x18ftypmp42" + bytes(240) + b"isomiso2", "bare": b"\0\0\0\x18ftyp",
    }
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "file_id string, content binary")
    found = {r[0]: r[1] for r in rows.select("file_id", brands(F.col("content"))).collect()}
    assert found == {"both": ["mp42", "isom"], "shifted": [], "minor": [], "phone": ["isom", "3gp"], "short": [], "short phone": ["3gp"], "cut": ["mp42"], "far": ["mp42", "isom"], "bare": []}
    kinds = {r.file_id: r.format or r.unsupported_kind for r in detected(rows).collect()}
    assert kinds["both"] == kinds["far"] == "mp4" and kinds["phone"] == kinds["short phone"] == "third-generation-partnership" and kinds["shifted"] == "iso-base-media"


def test_files_of_equal_bytes_are_walked_once_in_a_lot(spark):
    import pyarrow as pa
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_type

    walked = []

    def work(kind, data):
        walked.append(data)
        return engine.walk_file(kind, data)

    one, cut = FILES["png_all"], FILES["png_all"][:20]
    rows = [("png", one), ("pdf", one), ("png", cut), ("png", one), (None, None), ("png", cut)]
    kinds = [to_arrow_type(T._parse_datatype_string(t)) for t in (f"array<{engine.SEGMENT}>", engine.ERROR)]
    batch = pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.binary()))], names=["format", "content"])
    (out,) = engine._parse(1, 0, ["format", "content", "segments", "error"], kinds, work, False)([batch])
    assert walked == [one, cut] and out.column(1).to_pylist() == [r[1] for r in rows]
    found = list(zip(out.column(2).to_pylist(), out.column(3).to_pylist(), strict=True))
    assert found[0] == found[3] and found[2] == found[5] and found[1] == found[4] == ([], None)
    assert found[0][0] and found[0][1] is None and found[2][1]["error_kind"] == "malformed"


def test_a_file_of_another_format_or_none_after_the_strip_is_not_verified(spark):
    from stratalens.plans import carriers as C

    rows = [("a", "p", "png", FILES["png_all"]), ("b", "p", "jpeg", FILES["png_all"]), ("c", "p", "pdf", b"%PDF-1.4"), ("d", "p", "gif", b"none"), ("e", "p", "png", bytes.fromhex((C.PNG_HEAD + C.PNG_TAIL).replace(" ", "")))]
    done = spark.createDataFrame([(*r[:3], bytearray(r[3])) for r in rows], "file_id string, path string, format string, content binary")
    got = {r.file_id: (r.format, r.residual is None, r.verified) for r in engine.verified(done).collect()}
    assert got == {"a": ("png", False, False), "b": ("jpeg", True, False), "c": ("pdf", True, False), "d": ("gif", True, False), "e": ("png", False, True)}


@pytest.mark.parametrize("name, most", [("verify_residual", 2), ("inspect_variants", 2), ("show_text", 0), ("notes_wav", 1)])
def test_files_are_made_and_walked_once_for_each_pass(spark, sf, name, most):
    """Carriers, walked before and after; samples, filled and walked; reports of what was written; notes of one walk."""
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") <= most
