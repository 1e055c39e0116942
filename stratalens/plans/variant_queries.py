"""Queries over rarer forms of the formats, and over reports of files that are found, skipped or failed."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import dims
from ..operators import engine, report
from ..sources.shared import grown, written
from . import samples, variants
from .queries import _values, files_of, narrow, query, refused_movies, table

_FOUND = _values([(name, form, i, *row) for name, (form, rows) in variants.FOUND.items() for i, row in enumerate(rows)])
_ID = "t.sample || '/' || s_suppkey AS file_id"


def variant_files(spark, sf_dir):
    return samples.files(narrow(spark, sf_dir, "supplier", "s_suppkey", "s_name"), "s_suppkey", F.col("s_name"), variants.VARIANTS)


@query("inspect_variants", f"SELECT {_ID}, t.format AS format, t.seq AS seq, t.kind AS kind, t.location AS location, t.field AS field, t.bytes::BIGINT AS bytes FROM supplier, (VALUES {_FOUND}) t(sample, format, seq, kind, location, field, bytes)")
def inspect_variants(spark, sf_dir):
    """Older and guarded tags, directories of places and thumbnails, frames inside frames, drawings with styles and metadata, for each supplier."""
    return engine.findings(engine.decided(variant_files(spark, sf_dir))).select("file_id", "seq", "kind", "location", "field", "bytes", "format")


@query("strip_variants", f"SELECT {_ID}, t.format AS format, true AS survives, false AS leaks, 0 AS residual, true AS verified FROM supplier, (VALUES {_values([(n, f) for n, (f, _) in variants.FOUND.items()])}) t(sample, format)")
def strip_variants(spark, sf_dir):
    """Stripped variants: the supplier's name is in none, what must survive is in all, and each is inspected again without a finding."""
    done = written(engine.stripped(engine.decided(variant_files(spark, sf_dir))), "stripped")
    name = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), F.rpad("s_name", 18, " ").alias("name"))
    text = F.decode("content", "ISO-8859-1")
    rows = done.withColumn("k", F.split_part("file_id", F.lit("/"), F.lit(2)).cast("long")).join(grown(name), "k")
    rows = rows.select("file_id", "format", F.contains(text, F.lit("PRESERVED")).alias("survives"), F.contains(text, F.col("name")).alias("leaks"))
    return rows.join(grown(engine.verified(done).select("file_id", "residual", "verified")), "file_id")


@query("kept_and_noted_variants", f"""SELECT {_ID}, 'kept' AS what, t.reason AS word, t.location AS location FROM supplier, (VALUES {_values(variants.KEPT)}) t(sample, location, reason)
  UNION ALL SELECT {_ID}, 'noted', t.note, t.location FROM supplier, (VALUES {_values(variants.NOTED)}) t(sample, note, location)""")  # fmt: skip
def kept_and_noted_variants(spark, sf_dir):
    rows = engine.decided(variant_files(spark, sf_dir))
    kept = engine.retained(rows).select("file_id", F.lit("kept").alias("what"), F.col("reason").alias("word"), "location")
    return kept.unionByName(engine.notes(rows).select("file_id", F.lit("noted").alias("what"), F.col("note").alias("word"), "location"))


@query("svg_refusals", f"SELECT {_ID}, t.error_kind AS error_kind, t.detail AS detail, t.other AS unsupported_kind FROM supplier, (VALUES {_values([(n, 'unsupported-format' if other else 'malformed', detail, other) for n, (_, detail, other) in variants.REFUSED.items()])}) t(sample, error_kind, detail, other)")
def svg_refusals(spark, sf_dir):
    """Drawings that can run code, declare entities or hold an archive."""
    files = samples.files(narrow(spark, sf_dir, "supplier", "s_suppkey", "s_name"), "s_suppkey", F.col("s_name"), {n: data for n, (data, *_) in variants.REFUSED.items()})
    return engine.errors(files).select("file_id", "error_kind", "detail", "unsupported_kind")


_TEXT = f"'  [wav]' || chr(10) || '  {dims.MARKS['direct'].rjust(2)} {dims.LABELS['personal-identity']} — LIST INFO /Artist = ' || s_name || chr(10) || '  note: contains {dims.OUT_OF_SCOPE['wav']}, which is not opened: check it by itself'"


@query("show_text", f"""SELECT 'wav_info-' || s_suppkey AS file_id, 'wav_info-' || s_suppkey || '.bin' || {_TEXT} AS report FROM supplier
  UNION ALL SELECT c_custkey || '/' || d.defect, '{{"path":"p","status":"failed","error":"' || d.error_kind || '"}}' FROM customer, (VALUES ('moof', 'unsupported-format'), ('pssh', 'unsupported-format'), ('moov', 'malformed'), ('index', 'malformed'), ('far', 'malformed')) d(defect, error_kind)""")  # fmt: skip
def show_text(spark, sf_dir):
    """Reports as text of files that can be read, and as JSON of files that cannot."""
    rows = written(engine.decided(files_of(spark, sf_dir, "wav_info")).drop("content"), "looked-at")
    told = report.show_text(rows, engine.findings(rows, True), engine.notes(rows)).select("file_id", F.col("text").alias("report"))
    seen = written(engine.looked(refused_movies(spark, sf_dir)).drop("content"), "looked-at")
    failed = report.show_json(seen.withColumn("format", F.lit("mp4")), engine.findings(seen, True), engine.notes(seen), engine.errors(seen))
    return told.unionByName(failed.select("file_id", F.col("json").alias("report")))
