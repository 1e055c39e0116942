"""Relational operators around the files: range joins, renumbering, packets, merged cuts, outcomes and offline analytics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import grown, pieces

#: Worst first is highest: what a batch's exit code is decided by.
SEVERITY = {"found": 1, "other": 1, "io": 5, "unsupported": 3, "verification": 4}
RANKS = ("other", "io", "unsupported", "verification")


def relocate(offsets: DataFrame, extents: DataFrame, width: int = 1 << 20) -> DataFrame:
    """Range join: offsets (file_id, offset, ...) moved by the extent [lo, hi) -> new_lo that holds them; status 'broken-index' outside all.

    Extents do not overlap. Both sides meet on (file, offset div width), so that the join is an equi-join whatever the
    number of extents; an extent longer than the width has a row for each bucket it touches.
    """
    e = extents.select("file_id", "lo", "hi", "new_lo", F.explode(F.sequence(F.floor(F.col("lo") / width), F.floor((F.col("hi") - 1) / width))).alias("bucket")).where("hi > lo").alias("e")
    o = offsets.withColumn("bucket", F.floor(F.col("offset") / width)).alias("o")
    on = (F.col("o.file_id") == F.col("e.file_id")) & (F.col("o.bucket") == F.col("e.bucket")) & (F.col("o.offset") >= F.col("e.lo")) & (F.col("o.offset") < F.col("e.hi"))
    joined = o.join(grown(e), on, "left").select(*[f"o.{c}" for c in offsets.columns], (F.col("o.offset") - F.col("e.lo") + F.col("e.new_lo")).alias("relocated"))
    return joined.withColumn("status", F.when(F.col("relocated").isNull(), "broken-index").otherwise("moved"))


def rebuild_items(items: DataFrame, refs: DataFrame) -> DataFrame:
    """items (file_id, item_id, length) without the sources of thmb references (file_id, kind, from_id), renumbered from 1 with new offsets."""
    thumbs = refs.where("kind = 'thmb'").select("file_id", F.col("from_id").alias("item_id"))
    kept = items.join(thumbs, ["file_id", "item_id"], "left_anti")
    w = Window.partitionBy("file_id").orderBy("item_id")
    before = F.coalesce(F.sum("length").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return kept.select("file_id", "item_id", "length", F.row_number().over(w).alias("new_id"), before.alias("offset"))


def packets(lacing: DataFrame) -> DataFrame:
    """lacing (file_id, pos, value): a value below 255 ends a packet -> (file_id, packet, pieces, length, complete)."""
    w = Window.partitionBy("file_id").orderBy("pos", "value").rowsBetween(Window.unboundedPreceding, -1)
    numbered = lacing.withColumn("packet", F.coalesce(F.sum((F.col("value") < 255).cast("long")).over(w), F.lit(0)))
    return numbered.groupBy("file_id", "packet").agg(F.count("*").alias("pieces"), F.sum("value").alias("length"), F.bool_or(F.col("value") < 255).alias("complete"))


def merge_cuts(cuts: DataFrame) -> DataFrame:
    """cuts (file_id, start, end) -> disjoint ranges (file_id, start, end, n): those that overlap or touch are one.

    Files are dealt into pieces by the count of all cuts, so that what a task sorts does not grow with the input.
    """
    cuts = cuts.repartition(pieces(cuts.sparkSession, cuts.count()), "file_id")
    w = Window.partitionBy("file_id").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    starts = cuts.withColumn("new", F.coalesce((F.col("start") > reach).cast("int"), F.lit(1)))
    grouped = starts.withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy("file_id", "island").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("n")).drop("island")


def removed_groups(findings: DataFrame, dim_kind: DataFrame) -> DataFrame:
    """(sensitivity, rank, kind, n, bytes): findings by kind, the most sensitive first."""
    return findings.groupBy("kind").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).join(F.broadcast(dim_kind), "kind").select("sensitivity", "rank", "kind", "n", "bytes")


def severity(error_kind: Column) -> Column:
    """The rank of an error in a batch's outcome."""
    return (
        F.when(error_kind.isin("io", "input-too-large", "output-exists"), RANKS.index("io") + 1).when(error_kind.isin("unsupported-format", "unrecognised-format"), RANKS.index("unsupported") + 1)
        .when(error_kind == "verification-failed", RANKS.index("verification") + 1).when(error_kind.isNotNull(), RANKS.index("other") + 1).otherwise(0)
    )


def exit_code(outcomes: DataFrame, by: list[str]) -> DataFrame:
    """outcomes (error_kind, found, ...) -> by, exit_code: the worst outcome decides, then whether anything was found."""
    worst = outcomes.groupBy(*by).agg(F.max(severity(F.col("error_kind"))).alias("worst"), F.bool_or("found").alias("found"))
    code = F.when(F.col("worst") == 4, SEVERITY["verification"]).when(F.col("worst") == 3, SEVERITY["unsupported"]).when(F.col("worst") == 2, SEVERITY["io"]).when((F.col("worst") == 1) | F.col("found"), 1).otherwise(0)
    return worst.select(*by, code.alias("exit_code"))


def gains(points: DataFrame, windows: int = 6) -> DataFrame:
    """points (run, elapsed, value, duration) -> (run, window, reached, gain): the largest value by the end of each equal window, and its growth."""
    at = F.least(F.floor(F.col("elapsed") * windows / F.col("duration")).cast("int"), F.lit(windows - 1))
    best = points.groupBy("run", at.alias("window")).agg(F.max("value").alias("best"))
    every = points.select("run").distinct().select("run", F.explode(F.sequence(F.lit(0), F.lit(windows - 1))).alias("window"))
    w = Window.partitionBy("run").orderBy("window")
    reached = F.coalesce(F.max("best").over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    filled = every.join(best, ["run", "window"], "left").withColumn("reached", reached)
    return filled.select("run", "window", "reached", (F.col("reached") - F.coalesce(F.lag("reached").over(w), F.lit(0))).alias("gain"))


def classify(gained: DataFrame) -> DataFrame:
    """(run, shape): punctuated if a later window gains over 1 % of the total and twice its predecessor, else saturated if the last gains under 1 %, else climbing."""
    w = Window.partitionBy("run").orderBy("window")
    rows = gained.withColumns({"total": F.max("reached").over(Window.partitionBy("run")), "previous": F.lag("gain").over(w), "last": F.max("window").over(Window.partitionBy("run"))})
    jump = (F.col("window") > 0) & (F.col("gain") > 0.01 * F.col("total")) & (F.col("gain") >= 2 * F.greatest("previous", F.lit(1)))
    flat = (F.col("window") == F.col("last")) & (F.col("gain") < 0.01 * F.col("total"))
    per = rows.groupBy("run").agg(F.bool_or(F.coalesce(jump, F.lit(False))).alias("jumps"), F.bool_or(flat).alias("flat"))
    return per.select("run", F.when(F.col("jumps"), "punctuated").when(F.col("flat"), "saturated").otherwise("climbing").alias("shape"))


def tally(runs: DataFrame, changes: DataFrame) -> DataFrame:
    """runs (target, at, hours, result) newer than the target's last change -> (target, runs, hours, latest): the latest decides."""
    last = changes.groupBy("target").agg(F.max("changed_at").alias("changed_at"))
    valid = runs.join(last, "target", "left").where(F.col("changed_at").isNull() | (F.col("at") > F.col("changed_at")))
    return valid.groupBy("target").agg(F.count("*").alias("runs"), F.sum("hours").alias("hours"), F.max_by("result", "at").alias("latest"))


def differential(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(side, keys): what only one of two tools left behind."""
    x, y = a.select(*keys).distinct(), b.select(*keys).distinct()
    return x.join(y, keys, "left_anti").select(F.lit("first").alias("side"), *keys).unionByName(y.join(x, keys, "left_anti").select(F.lit("second").alias("side"), *keys))


def output_names(files: DataFrame, output_dir: str | None = None) -> DataFrame:
    """files (path) with output_path and, where several map to one, whether this one loses: the first in path order wins."""
    name = F.regexp_extract("path", "([^/]*)$", 1)
    folder = F.lit(output_dir.rstrip("/") + "/") if output_dir else F.regexp_extract("path", "^(.*/)?[^/]*$", 1)
    stem = F.when(F.rlike(name, F.lit(r"^.+\.[^.]*$")), F.regexp_replace(name, r"\.([^.]*)$", r".stripped.$1")).otherwise(F.concat(name, F.lit(".stripped")))
    out = files.withColumn("output_path", F.concat(folder, stem))
    w = Window.partitionBy("output_path").orderBy("path")
    return out.withColumn("output_exists", F.row_number().over(w) > 1)


def opened_paths(args: Column, cwd: str) -> Column:
    """An argument as a canonical path: absolute against cwd, without empty and `.` steps, each `..` with the step before it. An empty one is null."""
    path = F.when(args.startswith("/"), args).otherwise(F.concat(F.lit(cwd.rstrip("/") + "/"), args))
    steps = F.filter(F.split(path, "/"), lambda s: ~s.isin("", "."))
    none = F.array().cast("array<string>")
    walked = F.aggregate(steps, none, lambda done, s: F.when(s == "..", F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0)))).otherwise(F.concat(done, F.array(s))))
    return F.when(args != "", F.concat(F.lit("/"), F.array_join(walked, "/")))


def folders(entries: DataFrame) -> DataFrame:
    """entries (path, skipped, bytes), paths canonical -> (folder, depth, files, skipped, folders, bytes, line) of every folder above any of them.

    Everything counts in each folder above it: folders are those below it. Sums of one folder are combined in each task first, so the
    top, which holds all, is no larger than another.
    """
    above = lambda path: F.transform(F.sequence(F.lit(1), F.size(F.split(path, "/")) - 1), lambda n: F.array_join(F.slice(F.split(path, "/"), 1, n), "/"))
    held = entries.select(F.explode(above(F.col("path"))).alias("folder"), F.col("skipped").cast("long").alias("skipped"), F.coalesce("bytes", F.lit(0)).alias("bytes"))
    held = held.groupBy("folder").agg(F.sum(1 - F.col("skipped")).alias("files"), F.sum("skipped").alias("skipped"), F.sum("bytes").alias("bytes"))
    under = held.where("folder <> ''").select(F.explode(above(F.col("folder"))).alias("folder")).groupBy("folder").agg(F.count("*").alias("folders"))
    rows = held.join(under, "folder", "left").withColumn("folders", F.coalesce("folders", F.lit(0)))
    counted = lambda c, one, many: F.concat(F.col(c).cast("string"), F.when(F.col(c) == 1, f" {one}").otherwise(f" {many}"))
    line = F.concat(F.lit("It holds "), counted("files", "file", "files"), F.lit(" in "), counted("folders", "folder", "folders"), F.lit("."))
    line = F.when(F.col("skipped") == 0, line).otherwise(F.concat(line, F.lit(" "), counted("skipped", "other entry", "other entries"), F.lit(" will be skipped and listed.")))
    depth = F.size(F.filter(F.split("folder", "/"), lambda s: s != ""))
    return rows.select(F.when(F.col("folder") == "", "/").otherwise(F.col("folder")).alias("folder"), depth.alias("depth"), "files", "skipped", "folders", "bytes", line.alias("line"))
