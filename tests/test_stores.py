"""Sinks that are tried again, sources that leave files unopened, archives by ranges, large packages, documents, nesting and sketches."""

import io
import json
import os
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from stratalens.functions import sketch
from stratalens.operators import nesting, packages, relational, report
from stratalens.sources import archives, filewalk, sink


# --- the sink ---


def test_a_rename_that_was_done_before_is_a_success(tmp_path):
    target = str(tmp_path / "a")
    staged, kind = sink.stage(target, b"one", "job-1")
    assert kind is None and sink.publish(staged, target, False) is None
    assert sink.publish(staged, target, False) is None and open(target, "rb").read() == b"one"  # the task ran again after its rename
    again, _ = sink.stage(target, b"two", "job-2")  # somebody else's
    assert sink.publish(again, target, False) == "output-exists" == sink.publish(again, target, False)
    assert sink.publish(again, target, True) is None is sink.publish(again, target, True)
    assert open(target, "rb").read() == b"two" and os.listdir(tmp_path) == ["a"]


def test_a_crash_between_link_and_removal_is_mended(tmp_path):
    target = str(tmp_path / "a")
    staged, _ = sink.stage(target, b"one", "job-1")
    os.link(staged, target)
    assert sink.publish(staged, target, False) is None and os.listdir(tmp_path) == ["a"]


def test_a_task_that_fails_after_its_renames_reports_success_when_it_runs_again(spark, tmp_path):
    """Of every publishing task the first attempt's results are lost; the second finds all its files renamed."""
    rows = spark.range(40).select(F.col("id").cast("string").alias("file_id"), F.concat(F.lit(f"{tmp_path}/f"), "id").alias("output_path"), F.encode(F.col("id").cast("string"), "UTF-8").alias("content"), F.lit(False).alias("output_exists"))
    publisher = sink._publisher(False)

    def failing(batches):
        batches = list(batches)
        assert sum(b.num_rows for b in publisher(iter(batches))) == sum(b.num_rows for b in batches)
        yield from publisher(iter(batches))

    staged = rows.mapInArrow(sink._stager("job", False), sink.STAGED).cache()
    staged.count()
    first = staged.mapInArrow(failing, sink.RESULT)
    assert {r.error_kind for r in first.collect()} == {None}
    assert {r.error_kind for r in staged.mapInArrow(publisher, sink.RESULT).collect()} == {None}  # all of it once more
    assert {r.error_kind for r in sink.write_files(rows).collect()} == {"output-exists"}  # another job's
    assert sorted(x for x in os.listdir(tmp_path) if x.startswith(".")) == []


def test_what_losing_attempts_staged_is_swept(spark, tmp_path):
    for attempt in (1, 2):
        sink.stage(f"{tmp_path}/a", b"x", f"job-{attempt}")
    sink.stage(f"{tmp_path}/a", b"x", "other-1")
    paths = spark.createDataFrame([(f"{tmp_path}/a",), (f"{tmp_path}/b",)], "output_path string")
    assert [tuple(r) for r in sink.swept(paths, "job").collect()] == [(str(tmp_path), 2)] and os.listdir(tmp_path) == [".a.other-1.part"]


def test_the_writer_commits_aborts_and_refuses(spark, tmp_path):
    rows = spark.range(30).select(F.concat(F.lit(f"{tmp_path}/f"), "id").alias("output_path"), F.encode(F.col("id").cast("string"), "UTF-8").alias("content"))
    sink.save(rows)
    assert sorted(os.listdir(tmp_path)) == sorted(f"f{i}" for i in range(30)) and (tmp_path / "f7").read_bytes() == b"7"
    with pytest.raises(Exception, match="30 files were not written"):
        sink.save(rows.withColumn("content", F.encode(F.lit("other"), "UTF-8")))
    assert (tmp_path / "f7").read_bytes() == b"7"
    sink.save(rows.withColumn("content", F.encode(F.lit("other"), "UTF-8")), replace=True)
    assert (tmp_path / "f7").read_bytes() == b"other" and len(os.listdir(tmp_path)) == 30
    bad = rows.unionByName(spark.createDataFrame([(f"{tmp_path}/none/x", bytearray(b"x"))], rows.schema))
    with pytest.raises(Exception, match="."):
        sink.save(bad, replace=True)
    assert (tmp_path / "f7").read_bytes() == b"other" and len(os.listdir(tmp_path)) == 30  # aborted: nothing is left beside


def test_a_commit_that_runs_again_finds_its_work_done(tmp_path):
    w = sink.FileWriter({"manifests": f"{tmp_path}/m", "replace": "false"}, ["output_path", "content"])
    (tmp_path / "out").mkdir()
    message = w.write(iter([(f"{tmp_path}/out/a", b"1"), (f"{tmp_path}/out/b", b"2")]))
    assert (message.files, message.bytes) == (2, 2) and len(os.listdir(tmp_path / "out")) == 2 and not (tmp_path / "out/a").exists()
    sink.publish(json.loads(open(message.manifest).readline())[0], f"{tmp_path}/out/a", False)  # the driver stopped here
    w.commit([message, None])
    w.commit([message])
    assert sorted(os.listdir(tmp_path / "out")) == ["a", "b"] and os.listdir(tmp_path / "m") == []


# --- the source ---


def test_filters_leave_files_unopened_and_the_longest_come_first(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(12):
        (tmp_path / f"in/f{i}.{'txt' if i % 2 else 'PNG'}").write_bytes(b"x" * (i * 1000))
    os.symlink(tmp_path / "in/f1.txt", tmp_path / "in/link.png")

    def opened(condition):
        trace = tmp_path / f"trace{len(os.listdir(tmp_path))}"
        trace.mkdir()
        rows = filewalk.tree(spark, [str(tmp_path / "in")], partition_bytes=20_000, trace=str(trace)).where(condition)
        got = sorted(os.path.basename(r.path) for r in rows.collect())
        counts = {int(f): list(map(int, (trace / f).read_text().split())) for f in os.listdir(trace)}
        return got, sum(c[0] for c in counts.values()), sum(c[1] for c in counts.values()), counts

    assert opened("length < 3000 AND extension = 'png'")[:3] == (["f0.PNG", "f2.PNG"], 2, 2000)
    assert opened("length >= 9000")[:3] == (["f10.PNG", "f11.txt", "f9.txt"], 3, 30_000)
    assert opened(F.col("path").endswith("f5.txt"))[:3] == (["f5.txt"], 1, 5000)
    assert opened(F.col("extension").isin("txt", "gif"))[1] == 6
    assert opened("length < 3000 OR extension = 'png'")[1] == 12  # not pushed, and still right
    assert len(opened("length < 3000 OR extension = 'png'")[0]) == 8
    every, n, size, counts = opened("true")
    assert len(every) == 13 and n == 12 and size == 66_000
    assert counts[0][1] >= 21_000 - 11_000 and max(c[1] for c in counts.values()) <= 31_000 and len(counts) >= 5
    assert opened("length IS NULL")[0] == ["link.png"]


# --- archives ---


def made(entries, comment=b"", force_64=False):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, data, method in entries:
            with z.open(zipfile.ZipInfo(name), "w", force_zip64=force_64) if method == 0 else z.open(_deflated(name), "w", force_zip64=force_64) as f:
                f.write(data)
        z.comment = comment
    return out.getvalue()


def _deflated(name):
    info = zipfile.ZipInfo(name)
    info.compress_type = zipfile.ZIP_DEFLATED
    return info


def wide(data: bytes) -> bytes:
    """A 64-bit end record, and 64-bit sizes and offset in the only entry's directory record."""
    end = data.rfind(b"PK\5\6")
    at = struct.unpack_from("<I", data, end + 16)[0]
    record = bytearray(data[at:end])
    packed, size = struct.unpack_from("<II", record, 20)
    n, m = struct.unpack_from("<HH", record, 28)
    record[20:28], record[42:46] = b"\xff" * 8, b"\xff" * 4
    extra = struct.pack("<HHQQQ", 1, 24, size, packed, 0)
    record[30:32] = struct.pack("<H", m + len(extra))
    record = record[: 46 + n] + extra + record[46 + n :]
    end_64 = b"PK\6\6" + struct.pack("<QHHIIQQQQ", 44, 45, 45, 0, 0, 1, 1, len(record), at)
    locator = b"PK\6\7" + struct.pack("<IQI", 0, at + len(record), 1)
    return data[:at] + bytes(record) + end_64 + locator + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)


GOOD = made([("a.txt", b"stored", 0), ("d/b.txt", b"packed " * 400, 8), ("d/", b"", 0)], b"a comment")
FLAGGED = bytearray(made([("a.txt", b"x", 0)]))
FLAGGED[FLAGGED.find(b"PK\1\2") + 8] |= 1
CASES = {
    "good": (GOOD, None), "empty": (b"", "missing-marker"), "no_end": (GOOD[:-20], "missing-marker"), "trailing": (GOOD + b"x", "missing-marker"), "encrypted": (bytes(FLAGGED), "unsupported-feature"),
    "wide": (wide(made([("w.txt", b"wide", 0)])), None), "no_locator": (wide(made([("w.txt", b"wide", 0)])).replace(b"PK\6\7", b"PK\6\0"), "missing-marker"), "no_wide_record": (wide(made([("w.txt", b"wide", 0)])).replace(b"PK\6\6", b"PK\6\0"), "missing-marker"),
    "no_wide_extra": (wide(made([("w.txt", b"wide", 0)])).replace(struct.pack("<HH", 1, 24), struct.pack("<HH", 2, 24)), "broken-index"), "unsafe": (made([("../x", b"x", 0)]), "unexpected-marker"),
    "absolute": (made([("/x", b"x", 0)]), "unexpected-marker"), "none": (made([]), None),
}


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("archives")
    for name, (data, _) in CASES.items():
        (folder / name).write_bytes(data)
    twice = folder / "twice"
    with zipfile.ZipFile(twice, "w") as z:
        z.writestr("a", b"1")
        with pytest.warns(UserWarning):
            z.writestr("a", b"2")
    names = [*CASES, "twice", "missing"]
    return archives.entries(spark.createDataFrame([(str(folder / n),) for n in names], "path string"))


def test_directories_and_refusals(stored):
    told = {os.path.basename(r.path): r.failure.detail or r.failure.error_kind for r in archives.refused(stored).collect()}
    assert told == {n: d for n, (_, d) in CASES.items() if d} | {"twice": "duplicate-entry", "missing": "io"}
    listed = sorted((os.path.basename(r.path), r.name, r.size, r.method) for r in stored.where("entry_no IS NOT NULL").collect())
    assert ("good", "d/b.txt", 2800, 8) in listed and ("wide", "w.txt", 4, 0) in listed and sum(x[0] == "good" for x in listed) == 3


def test_payloads_by_ranges(stored):
    wanted = stored.where("name IN ('d/b.txt', 'w.txt')")
    got = {r.path.rsplit("/", 1)[1]: bytes(r.data) for r in archives.payloads(wanted).collect() if r.data is not None}
    assert got == {"good": b"packed " * 400, "wide": b"wide"}


def test_only_the_end_and_the_directory_are_read(tmp_path):
    (tmp_path / "big").write_bytes(made([("big", os.urandom(3_000_000), 0), ("small", b"x", 0)]))
    source = archives.Ranged(str(tmp_path / "big"))
    found = list(archives.listed(source, source.length))
    assert [e.raw for e in found] == [b"big", b"small"] and source.taken < 70_000
    small = found[1]
    assert archives.expanded(0, archives.packed_of(source, source.length, small.at, small.packed), small.size, small.crc) == b"x" and source.taken < 70_100
    source.close()
    for piece in (1, 50, 97):  # whatever the pieces, the same directory
        assert [e[:7] for e in archives.listed(lambda at, n: GOOD[at : at + n], len(GOOD), piece=piece)] == [e[:7] for e in archives.listed(lambda at, n: GOOD[at : at + n], len(GOOD))]


def test_bombs_and_sums(spark):
    zeros = zlib.compressobj(9, zlib.DEFLATED, -15)
    packed = zeros.compress(bytes(10_000_000)) + zeros.flush()
    for size, limit, detail in ((10_000_000, "expanded-size", None), (1000, "expanded-size", None)):
        with pytest.raises(archives.Refused) as e:
            archives.expanded(8, packed, size, 0)
        assert (e.value.limit, e.value.detail) == (limit, detail)
    for method, data, size, detail in ((0, b"ab", 3, "length-out-of-range"), (0, b"ab", 2, "broken-index"), (8, b"\xff\xff", 2, "truncated")):
        with pytest.raises(archives.Refused) as e:
            archives.expanded(method, data, size, 0)
        assert e.value.detail == detail
    bomb = packages.archive([(b"[Content_Types].xml", 8, 0, 0, 10_000_000, packed)])
    df = spark.createDataFrame([("b", "docx", bytearray(bomb))], "file_id string, format string, content binary")
    assert packages.parts(df).first().failure.limit == "expanded-size"


def test_truncated_and_flipped_archives_never_raise_anything_else():
    for data in (GOOD, CASES["wide"][0]):
        for n in range(len(data)):
            for broken in (data[:n], data[:n] + bytes([data[n] ^ 0xFF]) + data[n + 1 :]):
                read = lambda at, k, b=broken: b[at : at + k]
                try:
                    for e in archives.listed(read, len(broken)):
                        archives.expanded(e.method, archives.packed_of(read, len(broken), e.at, e.packed), e.size, e.crc)
                except archives.Refused:
                    pass


# --- packages ---


def test_a_package_of_many_parts(spark):
    """Types of parts are joined by name: twenty thousand parts with a type each once ended the job (8,000 in 4 GiB)."""
    n = 20_000
    main = '<Override PartName="/word/document.xml" ContentType="application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml"/>'
    types = f"<Types>{main}" + "".join(f'<Override PartName="/p{i}.xml" ContentType="application/x"/>' for i in range(n)) + "</Types>"
    entries = [("[Content_Types].xml", types), ("word/document.xml", '<w:document w:rsidR="1"/>'), *((f"p{i}.xml", "<a/>") for i in range(n))]
    data = packages.archive([(k.encode(), 0, 0, zlib.crc32(v.encode()), len(v), v.encode()) for k, v in entries])
    made_of = packages.Package(spark.createDataFrame([("f", "p", "docx", bytearray(data))], "file_id string, path string, format string, content binary"))
    assert [(r.kind, r.location, r.field) for r in made_of.findings().collect()] == [("editing-history", "word/document.xml", "w:rsidR")]
    assert len(zipfile.ZipFile(io.BytesIO(bytes(made_of.stripped().first().content))).infolist()) == n + 2
    made_of.release()


# --- reports ---


def test_a_document_of_many_files(spark, tmp_path):
    rows = spark.range(200_000).select(F.lpad(F.col("id").cast("string"), 7, "0").alias("file_id"), F.to_json(F.struct(F.col("id").alias("path"))).alias("json"))
    manifest = report.document(rows, "1", f"{tmp_path}/doc", 500_000).orderBy("part").collect()
    assert sum(r.files for r in manifest) == 200_000 and [r.start_byte for r in manifest] == [sum(x.bytes for x in manifest[:i]) for i in range(len(manifest))]
    whole = b"".join((tmp_path / "doc" / r.part).read_bytes() for r in manifest)
    assert len(manifest) > 1 and len(whole) == sum(r.bytes for r in manifest)
    assert [x["path"] for x in json.loads(whole)["files"]] == list(range(200_000))
    none = report.document(rows.limit(0), "1", f"{tmp_path}/none").collect()
    assert json.loads((tmp_path / "none" / none[0].part).read_text()) == {"version": "1", "files": []}


def test_removed_counts_repeats(spark):
    schema = "file_id string, seq int, kind string, location string, field string, bytes bigint, value_text string, value_opaque_bytes bigint"
    found = spark.createDataFrame([("f", i, "comment", "COM", None, 3, "abc", None) for i in range(3)] + [("f", 3, "comment", "COM", None, 3, "xyz", None)], schema)
    left = spark.createDataFrame([("f", 0, "comment", "COM", None, 3, "abc", None)], schema)
    assert sorted(r.seq for r in report.removed(found, left).collect()) == [1, 2, 3]


def test_paths_are_made_canonical(spark):
    cases = {"a": "/w/d/a", "/a//b/./c": "/a/b/c", "../x": "/w/x", "../../../../x": "/x", "": None, ".": "/w/d", "/": "/", "a/../..": "/w"}
    rows = spark.createDataFrame([(k,) for k in cases], "p string").select("p", relational.opened_paths(F.col("p"), "/w/d").alias("q"))
    assert {r.p: r.q for r in rows.collect()} == cases


# --- markup and sketches ---


def test_nesting_of_markup_that_does_not_close(spark):
    html = '<div a=">"><p>one<b>two</b><!-- <div> --><script>var a = "</div>";</script><div><br/>x</div></div><i><u>y</i></u>'
    rows = spark.createDataFrame([(1, html), (2, None), (3, ""), (4, "</a><a>"), (5, "no tags")], "id int, html string")
    tags = nesting.tokens(rows, "id", "html")
    assert [r.name for r in tags.where("id = 1").orderBy("no").collect()] == ["div", "p", "b", "b", "", "script", "div", "br", "div", "div", "i", "u", "i", "u"]
    found = sorted((r.name, r.open_no, r.close_no, r.depth, r.nests) for r in nesting.elements(tags, "id").collect())
    assert found == [("b", 2, 3, 2, True), ("div", 0, 9, 1, True), ("div", 6, 8, 2, True), ("i", 10, 12, 1, False), ("u", 11, 13, 2, False)]
    assert sorted((r.open_no, r.parent_no) for r in nesting.parents(nesting.elements(tags, "id"), "id").collect()) == [(0, None), (2, 0), (6, 0)]
    assert [r.no for r in nesting.inside(tags, "id", "div").orderBy("no").collect()] == [1, 2, 3, 4, 5, 6, 7, 8]
    assert [(r.name, r.text) for r in nesting.elements_with_text(tags, "id").collect()] == [("b", "two")]
    bare = {r.id: r.h for r in rows.select("id", nesting.drop_tags(F.col("html"), ["b", "div"]).alias("h")).collect()}
    assert bare == {1: '<p>onetwo<!-- <div> --><script>var a = "</div>";</script><br/>x<i><u>y</i></u>', 2: "", 3: "", 4: "</a><a>", 5: "no tags"}


def test_quantiles_stay_within_their_error(spark):
    rows = spark.range(20_000).select((F.col("id") % 3).alias("run"), (F.col("id") % 7).alias("batch"), F.floor(F.exp(F.rand(7) * 20)).cast("long").alias("v"))
    rows = rows.unionByName(spark.createDataFrame([(9, 0, 5), (9, 0, None), (9, 1, -1), (9, 1, 0)], "run long, batch long, v long")).cache()
    shares = {"median": 500, "p99": 990, "first": 0, "last": 1000}
    got = {r.run: r for r in sketch.quantiles(sketch.merged(sketch.sketched(rows, ["run", "batch"], "v"), ["run"]), ["run"], shares).collect()}
    for run in (0, 1, 2):
        values = sorted(r.v for r in rows.where(f"run = {run}").collect())
        assert got[run].n == len(values) and got[run].least == values[0]
        for name, share in shares.items():
            exact = values[max(1, -(-share * len(values) // 1000)) - 1]
            assert got[run][name] <= exact and exact - got[run][name] <= sketch.error() * exact
    assert (got[9].n, got[9].least, got[9]["median"], got[9]["last"]) == (2, 0, 0, 5)


def test_parts_of_a_package_stay_together_when_a_join_below_becomes_a_broadcast(spark):
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "10m", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k, None) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        rows = spark.range(0, 3000, 1, 6).select((F.col("id") % 1000).cast("string").alias("file_id"), F.floor(F.col("id") / 1000).cast("int").alias("part_no"))
        rows = rows.select("*", F.encode(F.concat(F.lit("p"), F.col("part_no").cast("string")), "UTF-8").alias("raw_name"), F.encode(F.repeat(F.col("file_id"), 50), "UTF-8").alias("new"))
        bad = spark.range(900, 1000).select(F.col("id").cast("string").alias("file_id"))
        made = packages.assembled(rows.join(bad, "file_id", "left_anti")).collect()
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert len(made) == 900 == len({r.file_id for r in made})
    assert all(zipfile.ZipFile(io.BytesIO(r.content)).namelist() == ["p0", "p1", "p2"] for r in made)


def test_archives_are_passed_on_by_their_bytes(monkeypatch):
    import io
    import zipfile

    import pyarrow as pa

    from stratalens.operators import packages

    monkeypatch.setattr(packages, "DONE_BYTES", 1_000)
    rows = [{"file_id": f"a{i // 30}", "raw_name": b"%d" % i, "method": 0, "flags": 2048, "crc": 0, "size": 0, "packed": None, "new": b"x" * i} for i in range(250)]
    kinds = pa.schema([("file_id", pa.string()), ("raw_name", pa.binary()), *[(c, pa.int64()) for c in ("method", "flags", "crc", "size")], ("packed", pa.binary()), ("new", pa.binary())])
    made = list(packages._assemble([pa.RecordBatch.from_pylist(rows[:170], kinds), pa.RecordBatch.from_pylist(rows[170:], kinds)]))
    assert [b.num_rows for b in made[:-1]] == [1] * 8 and [k for b in made for k in b.column(0).to_pylist()] == [f"a{i}" for i in range(9)]
    opened = [zipfile.ZipFile(io.BytesIO(c)) for b in made for c in b.column(1).to_pylist()]
    assert [(n, z.read(n)) for z in opened for n in z.namelist()] == [(r["raw_name"].decode(), r["new"]) for r in rows]
    assert [k for b in packages._assemble([]) for k in b.column(0).to_pylist()] == []


def test_stored_and_equal_parts_are_passed_on_and_looked_into_once(monkeypatch):
    import pyarrow as pa

    from stratalens.operators import packages

    data = packages.archive([(b"a", 0, 0, zlib.crc32(b"one"), 3, b"one"), (b"d/", 0, 0, 0, 0, b"")])
    assert [(p[6], p[7]) for p in packages.open_parts(data)] == [(None, b"one"), (b"", None)]
    seen, look = [], packages.scrubbed_part
    monkeypatch.setattr(packages, "scrubbed_part", lambda *part: seen.append(part[3]) or look(*part))
    rows = [{"file_id": f"f{i}", "part_no": i, "format": "docx", "role": "xml", "name": "p.xml", "data": b'<a w:rsidR="%d"/>' % (i % 2), "gone": None, "dead": None, "dropped": None} for i in range(5)]
    text, names = pa.string(), pa.list_(pa.string())
    kinds = pa.schema([("file_id", text), ("part_no", pa.int32()), ("format", text), ("role", text), ("name", text), ("data", pa.binary()), ("gone", text), ("dead", names), ("dropped", names)])
    item = pa.struct([("scope", text), ("name", text), ("location", text), ("bytes", pa.int64()), ("text", text), ("opaque", pa.int64())])
    (out,) = packages._scrub(pa.list_(item), pa.list_(pa.struct([("location", text), ("bytes", pa.int64())])))([pa.RecordBatch.from_pylist(rows, kinds)])
    assert len(seen) == 2 and out.column(0).to_pylist() == [f"f{i}" for i in range(5)]
    assert [x.replace(b" ", b"") for x in out.column(2).to_pylist()] == [b"<a/>"] * 5
    assert [x[0]["text"] for x in out.column(3).to_pylist()] == ["0", "1", "0", "1", "0"]


def test_what_is_sorted_by_file_is_dealt_by_rows_and_bytes(spark, monkeypatch):
    from stratalens.sources import shared

    monkeypatch.setattr(shared, "PIECE_ROWS", 100)
    least = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    assert [shared.pieces(spark, *x) for x in ((0,), (100 * least + 1,), (0, (least + 1) << 27))] == [least, least + 1, least + 1]
    cuts = spark.range(100 * (least + 3)).select((F.col("id") % 500).alias("file_id"), F.col("id").alias("start"), (F.col("id") + 1).alias("end"))
    merged = relational.merge_cuts(cuts)
    assert merged.count() == cuts.count() and "REPARTITION_BY_NUM" in merged._jdf.queryExecution().executedPlan().toString()
    assert merged.rdd.getNumPartitions() == least + 3
    rows = spark.createDataFrame([("f", "odt", 0, *[None] * 11)], packages.PARTS)
    assert packages.indexed(rows, 77).rdd.getNumPartitions() == 77


def test_packages_are_made_in_steps_that_the_jvm_compiles(spark):
    """The same bytes as by one expression; no generated method is over 8,000 bytes, which the JVM would not compile (18,304 before)."""
    from pyspark.sql.types import StringType

    from stratalens.plans import carriers as C

    rows = spark.createDataFrame(["", "name", "ünï", "x" * 700], StringType()).toDF("v").coalesce(1)
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    for parts, picture in ((C.XLSX, None), (C.PPTX, C.png_text(F.col("v"))), (C.ODS, None), (C.DOCX, C.png_text(F.col("v")))):
        more, content = C.packaged(rows, parts, F.col("v"), picture, "6180 2157")
        made = C.files(more, "v", content, "f").select("content")
        assert [bytes(r[0]) for r in made.collect()] == [bytes(r[0]) for r in rows.select(C.package(parts, F.col("v"), picture, "6180 2157")).collect()]
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        try:
            debug = getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
            stages = debug.codegenStringSeq(made._jdf.queryExecution().executedPlan())
        finally:
            spark.conf.set("spark.sql.adaptive.enabled", adaptive)
        assert stages.size() and max(stages.apply(i)._3().maxMethodCodeSize() for i in range(stages.size())) < 8_000
    numbers = [0, 1, 255, 256, 65_535, 1 << 24, (1 << 32) - 1]
    got = spark.createDataFrame([(n,) for n in numbers], "n bigint").select("n", C.le(F.col("n"), 4).alias("four"), C.le(F.col("n"), 2).alias("two")).collect()
    assert all(bytes(r.four) == r.n.to_bytes(4, "little") and bytes(r.two) == (r.n % 65_536).to_bytes(2, "little") for r in got)


def test_parts_that_are_looked_into_have_no_null_lists(spark):
    """Arrow goes over all rows since the last that has an array, before each row: of lists that are null, the square of a batch."""
    kinds = "file_id string, part_no int, format string, role string, name string, data binary, gone string, dead array<string>"
    rows = spark.createDataFrame([("f", 0, "docx", "index", "_rels/.rels", bytearray(b"<a/>"), None, None), ("f", 1, "docx", "xml", "x.xml", bytearray(b"<a/>"), None, ["i"])], kinds)
    plan = packages.scrubbed(rows)._jdf.queryExecution().optimizedPlan().toString()
    assert "coalesce(dead" in plan and "coalesce(dropped" in plan and packages.scrubbed(rows).count() == 2


def test_only_what_may_be_a_picture_is_looked_at_as_one(spark):
    from stratalens import dims
    from stratalens.functions.detect import detected, may_be_picture
    from stratalens.plans.queries import MAGICS

    rows = spark.createDataFrame([(k, bytearray(bytes.fromhex(k) + more)) for k in (*MAGICS, "", "00") for more in (b"", b"more bytes")] + [("null", None)], "magic string, content binary")
    seen = detected(rows.withColumn("maybe", may_be_picture(F.col("content")))).collect()
    assert {r.maybe for r in seen if r.format in dims.EMBEDDED} == {True} and not any(r.maybe for r in seen if r.format in ("svg", "pdf", "flac", "jxl") or r.magic in ("", "null"))


def test_tags_are_read_as_before():
    import re

    from stratalens.operators import markup

    old = re.compile(rb"""(?:[^>"']|"[^"]*"|'[^']*')*>""")
    for src in (b"<a b='>' c=\">\"/>", b"<a b='>", b"<a 'x' \"y", b"<a", b"<>", b"< a>", b"</a >", b"<!-- > --><a/>", b"<![CDATA[<x>]]><b>", b"<?x?><!D><c d=1>", b"<a\tb>", b"<a'b'>\"<c>"):
        tags = [(t.name, t.kind, src[t.start : t.end]) for t in markup.scan(src)[0]]
        for i in range(len(src)):
            a, b = old.match(src, i), markup._TAG_END.match(src, i)
            assert (a and a.end()) == (b and b.end())
        assert all(name == re.split(rb"[\s/]", raw.strip(b"<>").removeprefix(b"/"), maxsplit=1)[0].decode() for name, _, raw in tags)
    assert [t.name for t in markup.scan(b"<!-- <x> --><a b='<c>'><d/></a>")[0]] == ["a", "d", "a"]
