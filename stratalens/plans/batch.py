"""The two verbs over folders: show reports, strip writes verified copies.

Each file is read and walked once: what was decided is one table, with the stripped bytes beside it where they are wanted, and
every report is a projection of it. Packages have such tables of their own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import dims
from ..functions.detect import detected
from ..functions.packages import with_packages
from ..operators import engine, packages, relational, report
from ..sources import filewalk, sink
from ..sources.shared import released, written


class Looked:
    """What is known of all entries below some roots: files, findings, retained, notes, errors, skips and, if wanted, stripped."""

    def __init__(self, spark: SparkSession, roots: list[str], output: bool):
        rows = filewalk.walk(spark, roots)
        there = F.col("content").isNotNull()
        seen = with_packages(rows.withColumnsRenamed({"error_kind": "failed", "error": "why"}))
        table = engine.looked(detected(seen).drop("__package"))
        table = engine.with_output(table) if output else table.withColumn("output", F.lit(None).cast("binary"))
        keep = there & F.col("error").isNull() & F.col("format").isin(*dims.PACKAGES)
        self.table = written(table.withColumns({"input_bytes": F.octet_length("content").cast("long"), "there": there, "content": F.when(keep, F.col("content"))}), "looked")
        self.files = self.table.where("there")
        self.package = packages.Package(self.files.where(F.col("content").isNotNull()).select("file_id", "path", "format", "content"))

    def errors(self) -> DataFrame:
        failed = self.table.where("NOT there AND failed IS NOT NULL").select("file_id", F.col("failed").alias("error_kind"))
        return engine.errors(self.files).unionByName(self.package.errors()).unionByName(failed, allowMissingColumns=True)

    def findings(self) -> DataFrame:
        return engine.findings(self.files, True).unionByName(self.package.findings(True))

    def notes(self) -> DataFrame:
        return engine.notes(self.files.where(~F.coalesce(F.col("format").isin(*dims.PACKAGES), F.lit(False)))).unionByName(self.package.notes())

    def retained(self) -> DataFrame:
        return engine.retained(self.files)

    def stripped(self) -> DataFrame:
        own = self.files.where(F.col("output").isNotNull())
        own = own.select("file_id", "path", "format", F.col("output").alias("content"), "input_bytes", F.octet_length("output").cast("long").alias("output_bytes"))
        return own.unionByName(self.package.stripped())

    def skips(self) -> DataFrame:
        """JSON rows of entries that were passed over and files that could not be read."""
        bad = F.col("failed").isNotNull() | (F.col("skip_reason") == "unreadable")
        failed = F.to_json(F.struct("path", F.lit("failed").alias("status"), F.coalesce("failed", F.concat(F.col("skip_reason"), F.lit(": "), F.coalesce("why", F.lit("")))).alias("error")))
        passed = F.to_json(F.struct("path", F.lit("skipped").alias("status"), report.label(dims.SKIPS, F.col("skip_reason")).alias("reason")))
        return self.table.where("NOT there").select("file_id", F.when(bad, failed).otherwise(passed).alias("json"))

    def release(self) -> None:
        self.package.release()
        released(self.table)


def _values(found: DataFrame, values: bool) -> DataFrame:
    return found if values else found.withColumns({"value_text": F.lit(None).cast("string"), "value_opaque_bytes": F.lit(None).cast("bigint")})


def show(spark: SparkSession, roots: list[str], values: bool = False) -> DataFrame:
    """(file_id, json) of every entry below the roots, in order of path."""
    seen = Looked(spark, roots, False)
    names = seen.files.select("file_id", "path", "format")
    out = report.show_json(names, _values(seen.findings(), values), seen.notes(), seen.errors())
    return out.unionByName(seen.skips()).orderBy("file_id")


def strip(spark: SparkSession, roots: list[str], output_dir: str | None = None, replace: bool = False, values: bool = False) -> DataFrame:
    """Writes a stripped, verified copy of every file that can be: (file_id, output_path, output_bytes, error_kind, json, text).

    A copy that is not verified is not written. json and text report what was removed, kept and noted, or why there is no copy.
    """
    seen = Looked(spark, roots, True)
    done = written(seen.stripped(), "stripped")
    plain = done.where(~F.col("format").isin(*dims.PACKAGES))
    checked = engine.verified(plain).unionByName(packages.verified(done.where(F.col("format").isin(*dims.PACKAGES))))
    checked = written(checked.select("file_id", "verified"), "verified")
    named = relational.output_names(done.select("file_id", "path"), output_dir).select("file_id", "output_path", "output_exists")
    good = done.join(checked.where("verified"), "file_id").join(named, "file_id")
    put = written(sink.write_files(good, replace), "written")
    none = F.lit(None)
    nothing = [none.cast("string").alias("output_path"), none.cast("bigint").alias("output_bytes")]
    bad = checked.where("NOT verified").select("file_id", *nothing, F.lit("verification-failed").alias("error_kind"))
    failed = seen.errors().select("file_id", *nothing, "error_kind")
    result = put.unionByName(bad).unionByName(failed)
    facts = seen.files.select("file_id", "path", "format", "input_bytes").join(result, "file_id", "right")
    facts = facts.withColumn("path", F.coalesce("path", "file_id"))
    told = report.strip_reports(facts, _values(seen.findings(), values), seen.retained(), seen.notes())
    out = result.join(told, "file_id", "left")
    return out.unionByName(seen.skips().join(seen.errors().select("file_id"), "file_id", "left_anti"), allowMissingColumns=True)


def folder_summary(rows: DataFrame) -> DataFrame:
    """files, skipped and bytes of a walk."""
    return rows.agg(F.count_if(F.col("content").isNotNull()).alias("files"), F.count_if(F.col("content").isNull()).alias("skipped"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"))
