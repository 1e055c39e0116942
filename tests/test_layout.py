"""Movies as tables of boxes: outputs are those of the walk of one file, byte for byte, on whole and on broken files."""

import struct

from pyspark.sql import functions as F

from stratalens.operators import engine, isobmff, layout
from stratalens.operators.walkers import Doubt, walk


def box(kind, *parts, wide=False):
    body = b"".join(parts)
    return struct.pack(">I4sQ", 1, kind, 16 + len(body)) + body if wide else struct.pack(">I4s", 8 + len(body), kind) + body


def full(kind, *parts, version=0, **kw):
    return box(kind, bytes([version, 0, 0, 7]), *parts, **kw)


def track(offsets, wide=False, name=b"", late=False, handler=b"vide", extra=b""):
    times = struct.pack(">QQ", 5, 6) if late else struct.pack(">II", 5, 6)
    head = full(b"mdhd", times, bytes(8), b"\x15\xc7\0\0", version=int(late))
    entry = box(b"avc1" if handler == b"vide" else b"mp4a", bytes(42), b"\5coder".ljust(32, b"\0"), bytes(4))
    table = full(b"co64" if wide else b"stco", struct.pack(">I", len(offsets)), *[struct.pack(">Q" if wide else ">I", o) for o in offsets])
    own = box(b"dinf", full(b"dref", struct.pack(">I", 1), struct.pack(">I4sI", 12, b"url ", 1)))
    media = box(b"minf", box(b"vmhd", bytes(12)), own, box(b"stbl", full(b"stsd", struct.pack(">I", 1), entry), table, box(b"junk", b"SYNTHETIC")))
    return box(b"trak", full(b"tkhd", times, bytes(68), version=int(late)), extra, box(b"mdia", head, full(b"hdlr", bytes(4), handler, bytes(12), name), media))


def movie(*tracks, before=b"", between=b"", last=False, data=(b"PRESERVED-media",), late=False, tail=b""):
    """tracks: functions of the places of the media. The index comes before the media, or last."""
    made = lambda at: box(b"moov", full(b"mvhd", struct.pack(">QQ" if late else ">II", 1, 2), bytes(60), b"SELECT", bytes(40), version=int(late)), *[t(at) for t in tracks], box(b"udta", box(b"\xa9nam", b"SYNTHETIC")))
    front = box(b"ftyp", b"isom\0\0\0\0mp42") + before
    size = 0 if last else len(made([0] * 9))
    places, at = [], len(front) + size
    media = []
    for d in data:
        places.append(at + 8)
        media.append(box(b"mdat", d) + between)
        at += len(media[-1])
    return front + (b"".join(media) + made(places) if last else made(places) + b"".join(media)) + tail


GOOD = {
    "one": movie(lambda p: track([p[0], p[0] + 4])),
    "last": movie(lambda p: track([p[0]]), lambda p: track([p[0] + 1] * 3, True, b"handler\0", True, b"soun"), last=True, before=box(b"free", bytes(50)), late=True),
    "two media": movie(lambda p: track([p[2], p[0]], name=b"name\0"), data=(b"first", b"", b"second"), between=box(b"free", b"SYNTHETIC"), tail=b"\0\0\0\1x"),
    "no chunks": movie(lambda p: track([]), lambda p: track([], True, b"\0")),
    "tags": movie(lambda p: track([p[0]], extra=box(b"meta", b"SYNTHETIC") + box(b"edts", b"kept"))),
    "wide boxes": box(b"ftyp", b"isom\0\0\0\0", wide=True) + box(b"moov", full(b"mvhd", bytes(96), wide=True), box(b"trak", full(b"tkhd", b"\0\0", wide=True), wide=True), wide=True) + box(b"mdat", b"PRESERVED", wide=True),
    "to the end": box(b"ftyp", b"isom") + box(b"moov", full(b"mvhd", bytes(96)), box(b"trak")) + b"\0\0\0\0mdatPRESERVED",
}
BAD = {
    "null": None, "empty": b"", "text": b"neither", "far": movie(lambda p: track([p[0], 4])), "behind": movie(lambda p: track([p[0] + 15])), "beyond": movie(lambda p: track([1 << 63], True)),
    "fragment": GOOD["one"] + box(b"moof"), "sinf": movie(lambda p: track([p[0]], extra=box(b"sinf"))), "brand": GOOD["one"].replace(b"isom", b"qt  "), "two": GOOD["one"] + GOOD["one"],
    "no index": box(b"ftyp", b"isom"), "bare index": box(b"ftyp", b"isom") + box(b"moov"), "count": GOOD["one"].replace(struct.pack(">I4sII", 24, b"stco", 7, 2), struct.pack(">I4sII", 24, b"stco", 7, 3)),
    "locked": GOOD["one"].replace(b"avc1", b"encv"), "elsewhere": GOOD["one"].replace(b"url \0\0\0\1", b"url \0\0\0\0"),
}


def expected(data):
    """The stripped file by the walk of one file, and its refusal."""
    w, error = walk(isobmff.mp4, data)
    if error:
        return None, (error["error_kind"], error["detail"], error["unsupported_kind"])
    data = data or b""
    return b"".join(data[s["off"] : s["off"] + s["len"]] if s["replace"] is None else s["replace"] for s in w if s["key"] in ("ftyp", "mdat", "moov")), None


def frame(spark, files):
    return spark.createDataFrame([(k, None if v is None else bytearray(v)) for k, v in files.items()], "file_id string, content binary")


def test_outputs_and_refusals_are_those_of_the_walk(spark):
    files = {**GOOD, **BAD}
    done, bad = layout.relaid(frame(spark, files))
    got = {r.file_id: bytes(r.content) for r in done.collect()}
    refusals = {r.file_id: (r.error_kind, r.detail, r.unsupported_kind) for r in bad.collect()}
    assert set(got) == set(GOOD) and set(refusals) == set(BAD)
    for name, data in files.items():
        want, error = expected(data)
        assert got.get(name) == want, name
        assert refusals.get(name) == error, name
    assert all(b"SYNTHETIC" not in v for v in got.values())


def test_laid_out_anew_twice_is_the_same(spark):
    first = layout.relaid(frame(spark, GOOD))[0]
    again = layout.relaid(first)[0].withColumnRenamed("content", "again")
    assert first.join(again, "file_id").where("content = again").count() == len(GOOD)


def test_broken_bytes_are_refused_as_by_the_walk(spark):
    files = {}
    for name in ("last", "two media"):
        data = GOOD[name]
        files |= {f"{name}-cut-{i}": data[:i] for i in range(0, len(data), 41)}
        files |= {f"{name}-flip-{i}": data[:i] + bytes([data[i] ^ 0x41]) + data[i + 1 :] for i in range(0, len(data), 17)}
    done, bad = layout.relaid(frame(spark, files))
    got = {r.file_id: bytes(r.content) for r in done.collect()}
    refusals = {r.file_id for r in bad.collect()}
    assert not refusals & set(got) and refusals | set(got) == set(files)
    for name, data in files.items():
        assert got.get(name) == expected(data)[0], name


def test_an_empty_table_and_rows_beyond_a_batch(spark, monkeypatch):
    none = frame(spark, GOOD).limit(0)
    assert layout.relaid(none)[0].count() == 0 and layout.layout(layout.scanned(none)).count() == 0
    many = box(b"ftyp", b"isom") + box(b"moov", full(b"mvhd", bytes(96)), box(b"trak")) + box(b"free") * 25_000 + box(b"mdat", b"x")
    boxes = layout.scanned(frame(spark, {"many": many}))
    last = layout.layout(boxes).orderBy(F.desc("no")).first()
    assert (last["no"], last["kind"], last["new_off"]) == (25_004, "mdat", len(many) - 9 - 8 * 25_000)
    monkeypatch.setattr("stratalens.operators.walkers.MOST_ITEMS", 100)
    try:
        layout.listed(many)
    except Doubt as e:
        assert e.row["limit"] == "item-count"
    else:
        raise AssertionError("no limit")


def test_the_engine_strips_the_same_bytes(spark):
    files = frame(spark, GOOD).select("file_id", F.col("file_id").alias("path"), F.octet_length("content").cast("long").alias("length"), "content").withColumn("format", F.lit("mp4"))
    one = engine.stripped(engine.decided(files)).select("file_id", "content")
    other = layout.relaid(files)[0].withColumnRenamed("content", "other")
    assert one.join(other, "file_id").where("content = other").count() == len(GOOD)


def test_a_layout_deals_the_boxes_of_a_file_once(spark, capsys):
    layout.layout(layout.scanned(frame(spark, GOOD))).explain()
    plan = capsys.readouterr().out
    assert plan.count("Exchange") == 1 and "Join" not in plan


def test_files_are_laid_out_anew_where_they_lie(spark, capsys):
    done, bad = layout.relaid(frame(spark, GOOD))
    for rows in (done, bad):
        rows.explain()
        plan = capsys.readouterr().out
        assert "Exchange" not in plan and "Join" not in plan


def test_chunks_in_many_media_and_many_boxes(spark):
    """Media are found by halving, places by sums of 1, 2, 4 and so on boxes: counts around powers of two, and each end of each medium."""
    files = {}
    for n in (*range(1, 10), 15, 16, 17, 31, 32, 33):
        data = [b"media %03d" % i for i in range(n)]
        data[n // 2] = b"" if n > 2 else data[n // 2]
        places = movie(last=True, data=data)
        at, inside = len(box(b"ftyp", b"isom\0\0\0\0mp42")), []
        for d in data:
            inside += [at + 8, at + 7 + len(d)] if d else []
            at += 8 + len(d)
        files[f"{n}"] = movie(lambda p, inside=inside: track(inside), last=True, data=data)
        files[f"{n} between"] = movie(lambda p, at=inside[-1] + 1: track([at]), last=True, data=data)
        files[f"{n} before"] = movie(lambda p, at=inside[0] - 1: track([at], True), last=True, data=data)
        assert len(places) < len(files[f"{n}"])
    files["many"] = movie(lambda p: track([p[0]]), between=box(b"free") * 30_000)
    done, bad = layout.relaid(frame(spark, files))
    got, refusals = {r.file_id: bytes(r.content) for r in done.collect()}, {r.file_id: r.detail for r in bad.collect()}
    assert not set(got) & set(refusals) and set(got) | set(refusals) == set(files)
    for name, data in files.items():
        want, error = expected(data)
        assert got.get(name) == want and refusals.get(name) == (error and error[1]), name
    assert set(refusals) == {k for k in files if " " in k}


def test_files_of_equal_bytes_are_one_row_and_have_their_own_again(spark):
    files = [("a", "p", b"one"), ("b", "q", b"two"), ("c", "r", b"one"), (None, "s", None), ("e", None, b""), ("f", "t", None), ("c", "r", b"one")]
    rows = spark.createDataFrame([(k, v and bytearray(v) if v != b"" else bytearray(), p) for k, p, v in files], "file_id string, content binary, path string").coalesce(1)
    held = engine.gathered(rows)
    assert sorted(((len(r["files"]), None if r.content is None else bytes(r.content)) for r in held.collect()), key=str) == sorted([(3, b"one"), (1, b"two"), (2, None), (1, b"")], key=str)
    key = lambda x: str(x)
    got = [(r.file_id, r.path, None if r.content is None else bytes(r.content)) for r in engine.spread(held).collect()]
    assert sorted(got, key=key) == sorted(files, key=key)
    assert engine.gathered(rows.limit(0)).count() == 0
