"""JSON and text sinks: one row for each file, whatever became of it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from ..sources.shared import grown, released, running, written

NULLS = {"ignoreNullFields": "false"}


def label(table: dict[str, str], name: Column) -> Column:
    """The wording of a name; a name without one is shown as it is."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), name), name)


def sensitivity(kind: Column) -> Column:
    return label({k: s for k, s, _ in dims.KINDS}, kind)


def _listed(rows: DataFrame, value: Column, order: list[str], name: str) -> DataFrame:
    """The rows of each file as one sorted array."""
    return rows.groupBy("file_id").agg(F.array_sort(F.collect_list(F.struct(*order, value.alias("v")))).alias("l")).select("file_id", F.transform("l", lambda x: x["v"]).alias(name))


def finding_json() -> Column:
    """A finding as a JSON object. Its value is a text, or what an opaque value measures, or null."""
    quoted = F.to_json(F.array("value_text"))
    value = F.when(F.col("value_text").isNotNull(), F.substring(quoted, 2, F.length(quoted) - 2)).when(F.col("value_opaque_bytes").isNotNull(), F.to_json(F.struct(F.col("value_opaque_bytes").alias("opaque_bytes")))).otherwise("null")
    head = F.to_json(F.struct("kind", sensitivity(F.col("kind")).alias("sensitivity"), "location", "field", "bytes"), NULLS)
    return F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"value":'), value, F.lit("}"))


def note_json() -> Column:
    """A note as a JSON object with the fields of its sort."""
    each = F.when(F.col("note") == "unparsed-region", F.to_json(F.struct("note", "location", "bytes"))).when(F.col("note") == "capability-removed", F.to_json(F.struct("note", "location", "capability")))
    return each.otherwise(F.to_json(F.struct("note", "location")))


def _joined(column: str) -> Column:
    return F.concat(F.lit("["), F.coalesce(F.array_join(F.col(column), ","), F.lit("")), F.lit("]"))


def _object(head: Column, **arrays: str) -> Column:
    """A JSON object with arrays of objects after its plain fields."""
    return F.concat(F.substring(head, F.lit(1), F.length(head) - 1), *[x for name, c in arrays.items() for x in (F.lit(f',"{name}":'), _joined(c))])


def show_json(files: DataFrame, findings: DataFrame, notes: DataFrame, errors: DataFrame) -> DataFrame:
    """(file_id, json): path, format, status, findings and notes of inspected files; path, status and error of others.

    findings with value_text and value_opaque_bytes. files: file_id, path, format.
    """
    per, noted = _listed(findings, finding_json(), ["seq"], "findings"), _listed(notes, note_json(), ["note", "location"], "notes")
    rows = files.select("file_id", "path", "format").join(grown(per), "file_id", "left").join(grown(noted), "file_id", "left").join(grown(errors.select("file_id", "error_kind")), "file_id", "left")
    good = F.concat(_object(F.to_json(F.struct("path", "format", F.lit("inspected").alias("status"))), findings="findings", notes="notes"), F.lit("}"))
    bad = F.to_json(F.struct("path", F.lit("failed").alias("status"), F.col("error_kind").alias("error")))
    return rows.select("file_id", F.when(F.col("error_kind").isNull(), good).otherwise(bad).alias("json"))


def finding_line() -> Column:
    mark = F.lpad(label(dims.MARKS, sensitivity(F.col("kind"))), 2, " ")
    value = F.when(F.col("value_text").isNotNull(), F.concat(F.lit(" = "), "value_text")).when(F.col("value_opaque_bytes").isNotNull(), F.concat(F.lit(" = <"), F.col("value_opaque_bytes").cast("string"), F.lit(" bytes>"))).otherwise("")
    return F.concat(mark, F.lit(" "), label(dims.LABELS, F.col("kind")), F.lit(" — "), "location", F.coalesce(F.concat(F.lit(" /"), F.col("field")), F.lit("")), value)


def note_line() -> Column:
    region = F.concat("location", F.lit(" could not be parsed; its "), F.coalesce("bytes", F.lit(0)).cast("string"), F.lit(" bytes are untouched, with whatever they hold"))
    able = F.concat("location", F.lit(" was removed: the file can no longer "), "capability")
    return F.when(F.col("note") == "unparsed-region", region).when(F.col("note") == "capability-removed", able).otherwise(F.concat(F.lit("contains "), "location", F.lit(", which is not opened: check it by itself")))


def _lines(rows: DataFrame, line: Column, order: list[str], name: str, start: str) -> DataFrame:
    return _listed(rows, F.concat(F.lit(start), line), order, name)


def show_text(files: DataFrame, findings: DataFrame, notes: DataFrame | None = None) -> DataFrame:
    """(file_id, text): the path and format, then a line for each finding and note."""
    rows = files.select("file_id", "path", "format").join(grown(_lines(findings, finding_line(), ["seq"], "l", "  ")), "file_id", "left")
    rows = rows.join(grown(_lines(notes, note_line(), ["note", "location"], "n", "  note: ")), "file_id", "left") if notes is not None else rows.withColumn("n", F.array().cast("array<string>"))
    none = F.when(F.col("l").isNull(), F.lit("  nothing found"))
    return rows.select("file_id", F.concat_ws("\n", F.concat("path", F.lit("  ["), F.coalesce("format", F.lit("unknown")), F.lit("]")), none, "l", "n").alias("text"))


def strip_reports(files: DataFrame, findings: DataFrame, retained: DataFrame, notes: DataFrame) -> DataFrame:
    """(file_id, json, text) of what strip did. files: file_id, path, format, input_bytes, output_path, output_bytes, error_kind."""
    rows = files.join(grown(_listed(findings, finding_json(), ["seq"], "removed")), "file_id", "left").join(grown(_listed(notes, note_json(), ["note", "location"], "noted")), "file_id", "left")
    rows = rows.join(grown(_lines(findings, finding_line(), ["seq"], "l", "  removed ")), "file_id", "left").join(grown(_lines(notes, note_line(), ["note", "location"], "n", "  note: ")), "file_id", "left")
    kept = F.concat("location", F.lit(" ("), label(dims.KEPT_BECAUSE, F.col("reason")), F.lit(")"))
    rows = rows.join(grown(_lines(retained, kept, ["location", "reason"], "k", "  kept ")), "file_id", "left")
    head = F.to_json(F.struct("path", F.col("output_path").alias("output"), "format", F.lit("stripped").alias("status")))
    sizes = F.concat(F.lit(',"input_bytes":'), F.col("input_bytes").cast("string"), F.lit(',"output_bytes":'), F.col("output_bytes").cast("string"), F.lit("}"))
    good = F.concat(_object(head, removed="removed", notes="noted"), sizes)
    bad = F.to_json(F.struct("path", F.lit("failed").alias("status"), F.col("error_kind").alias("error")))
    first = F.concat("path", F.lit(" -> "), "output_path", F.lit("  ["), "format", F.lit("]"))
    none = F.when(F.col("l").isNull(), F.lit("  nothing to remove; wrote a clean copy"))
    text = F.when(F.col("error_kind").isNull(), F.concat_ws("\n", first, none, "l", "k", "n")).otherwise(F.concat("path", F.lit(": "), "error_kind"))
    return rows.select("file_id", F.when(F.col("error_kind").isNull(), good).otherwise(bad).alias("json"), text.alias("text"))


def summary(findings: DataFrame, retained: DataFrame, files: DataFrame) -> DataFrame:
    """(file_id, found, removed, kept, summary) of stripped files: all that was found is removed."""
    per = findings.groupBy("file_id").agg(F.count("*").alias("found"))
    kept = retained.groupBy("file_id").agg(F.count("*").alias("kept"))
    rows = files.select("file_id").join(grown(per), "file_id", "left").join(grown(kept), "file_id", "left").fillna(0, ["found", "kept"])
    items = lambda c: F.concat(F.col(c).cast("string"), F.when(F.col(c) == 1, " item").otherwise(" items"))
    line = F.concat(F.lit("Found "), items("found"), F.lit(", removed "), items("found"), F.lit(", kept "), items("kept"))
    return rows.select("file_id", "found", F.col("found").alias("removed"), "kept", F.when(F.col("found") + F.col("kept") == 0, "Found nothing to remove").otherwise(line).alias("summary"))


def groups(findings: DataFrame) -> DataFrame:
    """(file_id, sensitivity, mark, kind, label, fields): what was removed from each file, by kind."""
    per = findings.groupBy("file_id", "kind").agg(F.count("*").alias("fields"))
    return per.select("file_id", sensitivity(F.col("kind")).alias("sensitivity"), label(dims.MARKS, sensitivity(F.col("kind"))).alias("mark"), "kind", label(dims.PLAIN_LABELS, F.col("kind")).alias("label"), "fields")


def placed(json_rows: DataFrame, version: str) -> DataFrame:
    """(file_id, position, start_byte, text): the pieces of one JSON document of all files, in order of file; the last closes it and has no file.

    Positions and first bytes are running sums over ranges of files, so any number of files makes one document.
    """
    head = F.lit(f'{{"version":"{version}","files":[')
    rows = json_rows.select("file_id", "json", F.lit(0).alias("last")).withColumn("one", F.lit(1).cast("long"))
    end = rows.sparkSession.createDataFrame([(None, None, 1, 1)], "file_id string, json string, last int, one long")
    numbered = running(rows.unionByName(end), ["last", "file_id"], {"position": "one"}, "document-order")
    first = F.when(F.col("position") == 0, head).otherwise("")
    text = F.when(F.col("last") == 1, F.concat(first, F.lit("]}"))).when(F.col("position") == 0, F.concat(first, "json")).otherwise(F.concat(F.lit(","), "json"))
    sized = numbered.select("last", "file_id", "position", text.alias("text")).withColumn("size", F.octet_length("text").cast("long") + 1)  # each piece ends its line
    return running(sized, ["last", "file_id"], {"start_byte": "size"}, "document-bytes").select("file_id", "position", "start_byte", "text")


def document(json_rows: DataFrame, version: str, folder: str, part_bytes: int = 128 << 20) -> DataFrame:
    """Writes one JSON document of all files as parts of about part_bytes, one for each range of files, and its manifest: (part, start_byte, bytes, files).

    The parts' names sort in the document's order, so that putting them one after the other gives it; no task holds more than a part.
    """
    pieces = written(placed(json_rows, version), "document")
    parts = pieces.agg(F.max("start_byte")).first()[0] // part_bytes + 1
    pieces.repartitionByRange(parts, "position").sortWithinPartitions("position").select("text").write.mode("errorifexists").text(folder)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    parts = json_rows.sparkSession.read.text(folder).select(name.alias("part"), F.octet_length("value").cast("long").alias("n"), F.startswith("value", F.lit("]}")).alias("closes"))
    parts = parts.groupBy("part").agg((F.sum("n") + F.count("*")).alias("bytes"), F.count_if(~F.col("closes")).alias("files"))
    manifest = running(parts, ["part"], {"start_byte": "bytes"}, "document-parts").select("part", "start_byte", "bytes", "files")
    released(pieces)
    return manifest


#: The headings of a report of both passes over a file, and what stands under one that has nothing.
SECTIONS = (("Found in the original", "Nothing that is looked for."), ("Removed", "Nothing."), ("Kept, and why", "Nothing that could be seen."), ("Notes", "None."))
SAME = ("kind", "location", "field", "bytes", "value_text", "value_opaque_bytes")


def removed(found: DataFrame, left: DataFrame) -> DataFrame:
    """The findings of a first pass without those of a second, as often as they are there (a difference of multisets)."""
    w = Window.partitionBy("file_id", *SAME).orderBy("seq")
    before, after = (x.withColumn("__k", F.row_number().over(w)) for x in (found, left))
    b, a = before.alias("b"), after.alias("a")
    on = (F.col("b.file_id") == F.col("a.file_id")) & (F.col("b.__k") == F.col("a.__k"))
    for c in SAME:
        on = on & F.col(f"b.{c}").eqNullSafe(F.col(f"a.{c}"))
    return b.join(grown(a), on, "left_anti").drop("__k")


def sections(files: DataFrame, found: DataFrame, left: DataFrame, retained: DataFrame, notes: DataFrame, notes_after: DataFrame) -> DataFrame:
    """(file_id, section, title, line_no, line) of both passes over each file: what was found, what the output lost, what was kept, and the notes of both, each once.

    found and left with value_text and value_opaque_bytes: of the input and of the output. A heading without lines says so in one.
    """
    kept = F.concat("location", F.lit(" ("), label(dims.KEPT_BECAUSE, F.col("reason")), F.lit(")"))
    by_seq = lambda rows, n: rows.select("file_id", F.lit(n).alias("section"), F.struct(F.col("seq").cast("long").alias("a"), F.lit("").alias("b")).alias("o"), finding_line().alias("line"))
    told = notes.unionByName(notes_after).select("file_id", note_line().alias("line"), "note", "location").distinct()
    ordered = lambda rows, n, line, by: rows.select("file_id", F.lit(n).alias("section"), F.struct(F.lit(0).cast("long").alias("a"), by.alias("b")).alias("o"), line.alias("line"))
    rows = by_seq(found, 0).unionByName(by_seq(removed(found, left), 1)).unionByName(ordered(retained, 2, kept, F.concat_ws("\1", "location", "reason")))
    rows = rows.unionByName(ordered(told, 3, F.col("line"), F.concat_ws("\1", "note", "location", "line")))
    rows = rows.withColumn("line_no", F.row_number().over(Window.partitionBy("file_id", "section").orderBy("o", "line"))).drop("o")
    titles = F.array(*[F.struct(F.lit(i).alias("section"), F.lit(t).alias("title"), F.lit(e).alias("empty")) for i, (t, e) in enumerate(SECTIONS)])
    every = files.select("file_id", F.explode(titles).alias("t")).select("file_id", "t.*")
    return every.join(grown(rows), ["file_id", "section"], "left").select("file_id", "section", "title", F.coalesce("line_no", F.lit(1)).alias("line_no"), F.coalesce("line", "empty").alias("line"))
