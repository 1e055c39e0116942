"""Queries over stores: files written and walked, archives and their entries, one document of many reports, folders, and timings."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import dims
from ..functions import sketch
from ..operators import engine, packages, relational, report
from ..sources import archives, filewalk, sink
from ..sources.shared import root, written
from . import carriers as C
from .queries import files_of, query, table


def _folder(spark, name: str) -> str:
    """A new folder below the shared one."""
    path = f"{root(spark)}/stratalens-{name}-{uuid.uuid4().hex}"
    system, inner, _ = filewalk.remote(path)
    system.create_dir(inner, recursive=True)
    return path


def _stored(spark, rows, name: str) -> str:
    """rows (name, content) as files of a new folder."""
    folder = _folder(spark, name)
    done = sink.write_files(rows.select(F.col("name").alias("file_id"), F.concat(F.lit(f"{folder}/"), F.col("name")).alias("output_path"), "content", F.lit(False).alias("output_exists")))
    if bad := done.where("error_kind IS NOT NULL").limit(1).collect():
        raise OSError(f"{bad[0].output_path}: {bad[0].error_kind}")
    return folder


@query("walk_small_texts", "SELECT 'd' || doc_id || '.txt' AS name, octet_length(encode(coalesce(text, '')))::BIGINT AS length, md5(coalesce(text, '')) AS digest FROM documents WHERE doc_id % 2 = 0 AND octet_length(encode(coalesce(text, ''))) < 500")
def walk_small_texts(spark, sf_dir):
    """All documents written by the sink, then walked with conditions that the source decides before it opens a file."""
    extension = F.when(F.col("doc_id") % 2 == 0, "txt").otherwise("BIN")
    rows = table(spark, sf_dir, "documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("."), extension).alias("name"), C.utf8(F.coalesce("text", F.lit(""))).alias("content"))
    found = filewalk.tree(spark, [_stored(spark, rows, "texts")]).where("extension = 'txt' AND length < 500")
    return found.select(F.regexp_extract("path", "([^/]*)$", 1).alias("name"), "length", F.md5("content").alias("digest"))


def _archived(spark, sf_dir):
    """(name, content): archives of the documents, a hundred ids each, stored."""
    rows = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("a"), F.floor(F.col("doc_id") / 100).cast("string"), F.lit(".zip")).alias("file_id"), (F.col("doc_id") % 100).cast("int").alias("part_no"),
        C.utf8(F.concat(F.lit("texts/"), F.col("doc_id").cast("string"), F.lit(".txt"))).alias("raw_name"), C.utf8(F.coalesce("text", F.lit(""))).alias("new"),
    )
    return packages.assembled(rows).select(F.col("file_id").alias("name"), "content")


@query("archive_entries", """SELECT 'a' || (doc_id // 100) || '.zip' AS archive, 'texts/' || doc_id || '.txt' AS name, octet_length(encode(coalesce(text, '')))::BIGINT AS size,
  octet_length(encode(coalesce(text, '')))::BIGINT AS packed_size, md5(coalesce(text, '')) AS digest FROM documents""")  # fmt: skip
def archive_entries(spark, sf_dir):
    """Directories by ranged reads, then every entry by its offset and length in tasks of its own."""
    folder = _stored(spark, _archived(spark, sf_dir), "archives")
    found = archives.entries(filewalk.listing(spark, [folder]).where("kind = 'file'").select("path"))
    held = archives.payloads(found).select("path", "entry_no", F.md5("data").alias("digest"))
    rows = found.where("entry_no IS NOT NULL").join(held, ["path", "entry_no"])
    return rows.select(F.regexp_extract("path", "([^/]*)$", 1).alias("archive"), "name", "size", "packed_size", "digest")


@query("archive_refusals", """SELECT 'a' || a || '.zip' AS archive, CASE a % 4 WHEN 0 THEN 'missing-marker' WHEN 1 THEN 'length-out-of-range' WHEN 2 THEN 'unsupported-feature' END AS detail,
  CASE WHEN a % 4 = 3 THEN n ELSE 0 END::BIGINT AS entries FROM (SELECT doc_id // 100 AS a, count(*) AS n FROM documents GROUP BY ALL)""")  # fmt: skip
def archive_refusals(spark, sf_dir):
    """Archives whose end is cut off, whose directory is said to lie beyond, or whose first entry is encrypted, beside whole ones."""
    rows = _archived(spark, sf_dir)
    kind, n = F.regexp_extract("name", "a([0-9]+)", 1).cast("int") % 4, F.octet_length("content")
    hexed = lambda start, size: F.hex(F.substring(F.col("content"), start, size))
    le = hexed(n - 5, F.lit(4))
    directory = F.conv(F.concat(F.substring(le, 7, 2), F.substring(le, 5, 2), F.substring(le, 3, 2), F.substring(le, 1, 2)), 16, 10).cast("int")
    upto = lambda size: F.substring(F.col("content"), F.lit(1), size)
    rest = lambda start: F.substring(F.col("content"), start, n)
    broken = F.when(kind == 0, upto(n - 3)).when(kind == 1, F.concat(upto(n - 6), C.raw("FFFFFF7F"), rest(n - 1))).when(kind == 2, F.concat(upto(directory + 8), C.raw("01"), rest(directory + 10))).otherwise(F.col("content"))
    folder = _stored(spark, rows.select("name", broken.alias("content")), "broken-archives")
    found = archives.entries(filewalk.listing(spark, [folder]).where("kind = 'file'").select("path"))
    counted = found.groupBy("path").agg(F.count("entry_no").alias("entries")).join(archives.refused(found), "path", "left")
    return counted.select(F.regexp_extract("path", "([^/]*)$", 1).alias("archive"), "failure.detail", "entries")


_PIECE = """CASE WHEN k = 0 THEN '{"version":"1","files":[' ELSE ',' END || '{"path":"' || file_id || '","status":"inspected"}'"""


@query("report_document", f"""WITH r AS (SELECT 'p' || page_id AS file_id, row_number() OVER (ORDER BY 'p' || page_id) - 1 AS k FROM pages),
  p AS (SELECT file_id, k AS position, {_PIECE} AS text FROM r UNION ALL SELECT NULL, count(*), ']}}' FROM pages)
  SELECT file_id, position, coalesce(sum(octet_length(encode(text)) + 1) OVER (ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_byte, text FROM p""")  # fmt: skip
def report_document(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select(F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("file_id"))
    return report.placed(rows.select("file_id", F.to_json(F.struct(F.col("file_id").alias("path"), F.lit("inspected").alias("status"))).alias("json")), "1")


@query("folder_rollup", """WITH e AS (SELECT '/data/' || coalesce(source, 'none') || '/' || coalesce(lang, 'und') || '/' || (doc_id % 7) || '/' || doc_id || '.txt' AS path, (text IS NULL OR n_chars < 100)::INT AS skipped,
    octet_length(encode(coalesce(text, ''))) AS bytes FROM documents),
  s AS (SELECT *, string_split(path, '/') AS parts FROM e), f AS (SELECT array_to_string(parts[1 : unnest(range(1, len(parts)))], '/') AS folder, skipped, bytes FROM s),
  g AS (SELECT folder, sum(1 - skipped)::BIGINT AS files, sum(skipped)::BIGINT AS skipped, sum(bytes)::BIGINT AS bytes FROM f GROUP BY folder),
  h AS (SELECT g.*, (SELECT count(*) FROM g x WHERE starts_with(x.folder, g.folder || '/') AND x.folder <> '') AS folders FROM g)
  SELECT CASE folder WHEN '' THEN '/' ELSE folder END AS folder, CASE folder WHEN '' THEN 0 ELSE len(string_split(folder, '/')) - 1 END::INT AS depth, files, skipped, folders, bytes,
  'It holds ' || files || CASE files WHEN 1 THEN ' file' ELSE ' files' END || ' in ' || folders || CASE folders WHEN 1 THEN ' folder.' ELSE ' folders.' END
    || CASE skipped WHEN 0 THEN '' ELSE ' ' || skipped || CASE skipped WHEN 1 THEN ' other entry' ELSE ' other entries' END || ' will be skipped and listed.' END AS line FROM h""")  # fmt: skip
def folder_rollup(spark, sf_dir):
    """Paths as they are given, some from a working folder and with steps back, in canonical form and summed up at every level."""
    own = F.concat_ws("/", F.coalesce("source", F.lit("none")), F.coalesce("lang", F.lit("und")), (F.col("doc_id") % 7).cast("string"), F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    given = F.when(F.col("doc_id") % 3 == 0, own).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("./x/..//"), own)).otherwise(F.concat(F.lit("/data/"), own))
    rows = table(spark, sf_dir, "documents").select(relational.opened_paths(given, "/data").alias("path"), (F.col("text").isNull() | F.coalesce(F.col("n_chars") < 100, F.lit(False))).alias("skipped"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("bytes"))
    return relational.folders(rows)


_BUCKET = "(v >> greatest(length(bin(v)) - 8, 0)) << greatest(length(bin(v)) - 8, 0)"
_RANK = "min(b) FILTER (upto * 1000 >= greatest(total * {0}, 1000))::BIGINT AS {1}"


@query("timing_quantiles", f"""WITH v AS (SELECT event_type AS run, floor(value * 100 + 0.5)::BIGINT AS v FROM events WHERE floor(value * 100 + 0.5) >= 0), c AS (SELECT run, {_BUCKET} AS b, count(*) AS n, min(v) AS least FROM v GROUP BY ALL),
  u AS (SELECT *, sum(n) OVER (PARTITION BY run ORDER BY b) AS upto, sum(n) OVER (PARTITION BY run) AS total FROM c)
  SELECT run, max(total)::BIGINT AS n, min(least)::BIGINT AS least, {_RANK.format(500, "median")}, {_RANK.format(990, "p99")} FROM u GROUP BY run""")  # fmt: skip
def timing_quantiles(spark, sf_dir):
    """Each day's sketch by itself, merged afterwards: median, 99th percentile and minimum of each kind of event, in hundredths."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("run"), F.to_date("ts").alias("day"), F.floor(F.col("value") * 100 + 0.5).cast("long").alias("v"))
    daily = sketch.sketched(rows, ["run", "day"], "v")
    return sketch.quantiles(sketch.merged(daily, ["run"]), ["run"], {"median": 500, "p99": 990})


_MARK = {k: dims.MARKS[s].rjust(2) for k, s, _ in dims.KINDS}
_LINES = f"""f AS (SELECT 'jpeg_comment-' || o_orderkey AS file_id, o_orderkey % 5 = 0 AS left_over, '{_MARK["comment"]} {dims.LABELS["comment"]} — COM = ' || o_orderpriority AS line, NULL AS note FROM orders
  UNION ALL SELECT 'mp3_id3-' || c_custkey, c_custkey % 5 = 0, '{_MARK["personal-identity"]} {dims.LABELS["personal-identity"]} — ID3v2.3 /TPE1 = ' || c_name, 'contains {dims.OUT_OF_SCOPE["mp3"]}, which is not opened: check it by itself' FROM customer)"""
_S = report.SECTIONS


@query("report_sections", f"""WITH {_LINES} SELECT file_id, 0 AS section, '{_S[0][0]}' AS title, 1 AS line_no, line FROM f
  UNION ALL SELECT file_id, 1, '{_S[1][0]}', 1, CASE WHEN left_over THEN '{_S[1][1]}' ELSE line END FROM f UNION ALL SELECT file_id, 2, '{_S[2][0]}', 1, '{_S[2][1]}' FROM f
  UNION ALL SELECT file_id, 3, '{_S[3][0]}', 1, coalesce(note, '{_S[3][1]}') FROM f""")  # fmt: skip
def report_sections(spark, sf_dir):
    """Both passes over two carriers' files, of which every fifth output still is its input."""
    files = files_of(spark, sf_dir, "jpeg_comment").unionByName(files_of(spark, sf_dir, "mp3_id3"))
    first = written(engine.decided(files), "decided")
    kept = F.regexp_extract("file_id", "([0-9]+)$", 1).cast("long") % 5 == 0
    outputs = engine.with_output(first).select("file_id", "path", F.when(kept, F.col("content")).otherwise(F.col("output")).alias("content"))
    second = written(engine.decided(outputs).drop("content"), "decided-again")
    return report.sections(first, engine.findings(first, True), engine.findings(second, True), engine.retained(first), engine.notes(first), engine.notes(second))
