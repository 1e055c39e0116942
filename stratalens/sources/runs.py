"""Records of long test runs: a folder for each run, with a summary in Markdown and a coverage curve for each target.

Summaries are read whole, as they are small; curves line by line. Runs without a date or a duration are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value, the format of a row of a summary's table: target, coverage, ..., seconds of seconds planned, ..., crashes.
ROW = r"(?m)^\|\s*([a-z0-9]+)\s*\|\s*(\d+)\s*\|.*?\|\s*(\d+)s of (\d+)s\s*\|[^|\n]*\|\s*(\d+)\s*\|"
LEAST_SECONDS = 3600


def _folder(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -2)


def summaries(spark: SparkSession, folder: str) -> DataFrame:
    """(run, at, duration, aborted, text) of each run's summary."""
    rows = spark.read.text(f"{folder}/*/summary.md", wholetext=True).select(_folder(F.col("_metadata.file_path")).alias("run"), F.col("value").alias("text"))
    rows = rows.withColumns({"at": F.try_to_timestamp(F.regexp_extract("text", r"(?m)^- Date:\s*(\S+)", 1)), "duration": F.expr(r"try_cast(regexp_extract(text, '(?m)^- Duration:\\s*(\\d+)s', 1) AS INT)")})
    return rows.where("at IS NOT NULL AND duration IS NOT NULL").select("run", "at", "duration", F.contains(F.lower("run"), F.lit("aborted")).alias("aborted"), "text")


def points(spark: SparkSession, folder: str) -> DataFrame:
    """(run, target, elapsed, value): lines of two numbers with a tab between them; other lines are passed over."""
    rows = spark.read.text(f"{folder}/*/cov-*.tsv").select(F.col("_metadata.file_path").alias("p"), "value")
    cell = lambda i: F.expr(f"try_cast(split(value, '\t')[{i}] AS BIGINT)")
    rows = rows.where(F.rlike("value", F.lit(r"^\d+\t[^\t]*$")))
    return rows.select(_folder(F.col("p")).alias("run"), F.regexp_extract("p", r"cov-([^/]*)\.tsv$", 1).alias("target"), cell(0).alias("elapsed"), cell(1).alias("value")).where("value IS NOT NULL")


def curves(spark: SparkSession, folder: str) -> DataFrame:
    """(run, target, date, duration, elapsed, value) of runs of an hour or more."""
    long = summaries(spark, folder).where(F.col("duration") >= LEAST_SECONDS).select("run", F.to_date("at").alias("date"), "duration")
    return points(spark, folder).join(long, "run").select("run", "target", "date", "duration", "elapsed", "value")


def collected(spark: SparkSession, folder: str) -> DataFrame:
    """(run, target, at, seconds, duration, crashes, aborted): the rows of all summaries' tables."""
    number = lambda i: F.regexp_extract("line", ROW, i).cast("long")
    rows = summaries(spark, folder).select("run", "at", "duration", "aborted", F.explode(F.regexp_extract_all("text", F.lit(ROW), F.lit(0))).alias("line"))
    return rows.select("run", F.regexp_extract("line", ROW, 1).alias("target"), "at", number(3).alias("seconds"), "duration", number(5).alias("crashes"), "aborted")
