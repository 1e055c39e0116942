"""The file listing source: every regular file below some folders or files, and a row for everything that was passed over.

Unlike the built-in binary source it reports empty files, dot-files and skipped entries, and never follows links. Folders are
listed by tasks, level by level: the folders that one level finds are the next level's rows, so a tree of any width passes
through no single machine. Files are dealt to tasks by running sums of their sizes, the longest first; a task reads them in batches of bounded
bytes. Conditions on path, extension and length are pushed into the source. A file that is larger than
max_bytes, or has grown beyond it since it was listed, gives an error row and no content.

Roots are paths or URIs. Plain paths and file: URIs are read as the machine's own files, which on a cluster must be mounted on
all machines; other URIs are opened by the Arrow file system of their scheme, where links do not exist.

Columns: file_id, path, length, content, error_kind, skip_reason, error. A row has content, or error_kind (input-too-large,
io), or skip_reason (symbolic-link, not-a-file, unreadable).
"""

from __future__ import annotations

import atexit
import os
import stat
import sys
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .shared import released, remove, root, running, written

SCHEMA = "file_id string, path string, length bigint, content binary, error_kind string, skip_reason string, error string"
SOURCE = f"{SCHEMA}, extension string"
#: What the listing knows of an entry, and the conditions on it that the source decides.
PUSHED = ("path", "extension", "length")
TESTS = {
    "EqualTo": lambda x, v: x == v, "EqualNullSafe": lambda x, v: x == v, "GreaterThan": lambda x, v: x > v, "GreaterThanOrEqual": lambda x, v: x >= v, "LessThan": lambda x, v: x < v,
    "LessThanOrEqual": lambda x, v: x <= v, "In": lambda x, v: x in v, "StringStartsWith": lambda x, v: x.startswith(v), "StringEndsWith": lambda x, v: x.endswith(v), "StringContains": lambda x, v: v in x, "IsNotNull": lambda x, v: True,
}
ENTRIES = "path string, kind string, size bigint, error string"


def local(path: str) -> str | None:
    """The machine's own path of a path or file: URI; None for other schemes."""
    return path.removeprefix("file://").replace("file:/", "/", 1) if path.startswith("file:") else None if "://" in path else path


def remote(path: str):
    """The Arrow file system of a URI, the path in it, and what makes a path a URI again."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system, inner, path[: len(path) - len(inner)]


def entry(path: str, follow: bool = False) -> tuple[str, str, int | None, str | None]:
    """(path, kind, size, error) of one of the machine's own entries. kind: file, folder, or why it is passed over."""
    try:
        info = os.stat(path) if follow else os.lstat(path)
    except OSError as e:
        return path, "unreadable", None, e.strerror
    if stat.S_ISDIR(info.st_mode):
        return path, "folder", None, None
    if stat.S_ISREG(info.st_mode):
        return path, "file", info.st_size, None
    return path, "symbolic-link" if stat.S_ISLNK(info.st_mode) else "not-a-file", None, None


def children(path: str) -> list[tuple]:
    """The entries of a folder."""
    own = local(path)
    if own is not None:
        try:
            names = os.listdir(own)
        except OSError as e:
            return [(path, "unreadable", None, e.strerror)]
        return [entry(os.path.join(own, name)) for name in names]
    from pyarrow import fs

    system, inner, prefix = remote(path)
    try:
        listed = system.get_file_info(fs.FileSelector(inner))
    except OSError as e:
        return [(path, "unreadable", None, str(e))]
    kinds = {fs.FileType.File: "file", fs.FileType.Directory: "folder"}
    return [(prefix + i.path, kinds.get(i.type, "not-a-file"), i.size if i.is_file else None, None) for i in listed]


def root_entry(path: str) -> tuple:
    """A root itself; a link that is given as a root is followed."""
    own = local(path)
    if own is not None:
        return entry(own, follow=True)
    from pyarrow import fs

    system, inner, _ = remote(path)
    info = system.get_file_info(inner)
    kinds = {fs.FileType.File: "file", fs.FileType.Directory: "folder", fs.FileType.NotFound: "unreadable"}
    return path, kinds.get(info.type, "not-a-file"), info.size if info.is_file else None, "not found" if info.type == fs.FileType.NotFound else None


def _each(find):
    def listed(batches):
        import pyarrow as pa

        kinds = (pa.string(), pa.string(), pa.int64(), pa.string())
        for b in batches:
            for path in b.column("path").to_pylist():
                rows = find(path)
                columns = zip(*rows, strict=True) if rows else [[]] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["path", "kind", "size", "error"])

    return listed


def listing(spark: SparkSession, roots: list[str]) -> DataFrame:
    """ENTRIES below the roots, folders among them, each once."""
    level = spark.createDataFrame([(r,) for r in roots], "path string").mapInArrow(_each(lambda p: [root_entry(p)]), ENTRIES)
    level = written(level, "listing")
    found = level
    while level.where("kind = 'folder'").limit(1).count():
        folders = level.where("kind = 'folder'").select("path").repartition("path")
        level = written(folders.mapInArrow(_each(children), ENTRIES), "listing")
        found = found.unionByName(level)
    return found.distinct()


def read(path: str, most: int) -> tuple[int | None, bytes | None, str | None, str | None]:
    """(length, content, error_kind, error) of one file, never more than one byte beyond the limit."""
    try:
        own = local(path)
        if own is not None:
            with open(own, "rb") as f:
                data = f.read(most + 1)
        else:
            system, inner, _ = remote(path)
            with system.open_input_stream(inner) as f:
                data = f.read(most + 1)
    except OSError as e:
        return None, None, "io", e.strerror or str(e)
    return (len(data), None, "input-too-large", None) if len(data) > most else (len(data), data, None, None)


class Bin(InputPartition):
    """Files that one task reads."""


class FileReader(DataSourceReader):
    """Reads what a planned listing names. Filters on path, extension and length are decided from the listing, before a file is opened."""

    def __init__(self, options: dict):
        self.plan, self.bins = options["plan"], int(options["bins"])
        self.most, self.share, self.trace = int(options["max_bytes"]), int(options["batch_bytes"]), options.get("trace")
        self.wanted: list[tuple] = []

    def pushFilters(self, filters):
        for f in filters:
            name, own = type(f).__name__, len(f.attribute) == 1 and f.attribute[0] in PUSHED if hasattr(f, "attribute") else False
            if own and name in TESTS:
                self.wanted.append((name, f.attribute[0], getattr(f, "value", None)))
            if not own or name not in TESTS or f.attribute[0] == "length":  # a file may have grown since it was listed
                yield f

    def partitions(self):
        return [Bin(i) for i in range(self.bins)]

    def read(self, partition):
        import pyarrow as pa
        import pyarrow.parquet as pq
        from pyarrow import fs

        system, inner, _ = remote(self.plan) if "://" in self.plan else (fs.LocalFileSystem(), local(self.plan), "")
        names = [c.split()[0] for c in SOURCE.split(", ")]
        kinds = (pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string(), pa.string(), pa.string(), pa.string())
        opened = taken = 0

        def made(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True) if rows else [[]] * 8, kinds, strict=True)], names=names)

        folder = system.get_file_info(fs.FileSelector(f"{inner}/bin={partition.value}", allow_not_found=True))
        for info in sorted((i for i in folder if i.base_name.endswith(".parquet")), key=lambda i: i.path):
            with system.open_input_file(info.path) as handle:
                for b in pq.ParquetFile(handle).iter_batches(batch_size=4096, columns=["path", "extension", "kind", "size", "error"]):
                    rows, held = [], 0
                    for path, extension, kind, size, error in zip(*(c.to_pylist() for c in b.columns), strict=True):
                        facts = {"path": path, "extension": extension, "length": size if kind == "file" else None}
                        if not all(facts[c] is not None and TESTS[n](facts[c], v) for n, c, v in self.wanted):
                            continue
                        if kind != "file":
                            rows.append((path, path, None, None, None, kind, error, extension))
                            continue
                        length, data, failed, why = (size, None, "input-too-large", None) if size > self.most else read(path, self.most)
                        opened, taken = opened + (size <= self.most), taken + (length or 0) * (size <= self.most)
                        rows.append((path, path, size if length is None else length, data, failed, None, why, extension))
                        held += length or 0
                        if held >= self.share:
                            yield made(rows)
                            rows, held = [], 0
                    yield made(rows)
        if self.trace:
            with open(f"{self.trace}/{partition.value}", "w") as f:
                f.write(f"{opened} {taken}")


class FileSource(DataSource):
    """The planned listing as a table; see `tree`."""

    @classmethod
    def name(cls):
        return "filetree"

    def schema(self):
        return SOURCE

    def reader(self, schema):
        return FileReader(dict(self.options))


def planned(entries: DataFrame, partition_bytes: int, max_bytes: int) -> tuple[str, int]:
    """Deals entries to tasks by size, the longest files first, and writes them by task: (folder, tasks).

    A task's share is partition_bytes and one file at most, or a hundred-thousandth of all bytes where that is more.
    """
    size = F.least(F.coalesce("size", F.lit(0)), F.lit(max_bytes)) + 4096  # opening a file counts too
    rows = entries.withColumns({"extension": F.lower(F.regexp_extract("path", r"[^/]\.([^./]*)$", 1)), "__size": size})
    total = rows.agg(F.sum("__size")).first()[0] or 0
    share = max(partition_bytes, total // 100_000)
    dealt = running(rows.withColumn("__short", -F.col("__size")), ["__short", "path"], {"__before": "__size"}, "sizes")
    dealt = dealt.select("path", "extension", "kind", "size", "error", F.floor(F.col("__before") / share).cast("int").alias("bin"))
    folder = f"{root(entries.sparkSession)}/stratalens-plan-{uuid.uuid4().hex}"
    atexit.register(remove, entries.sparkSession, folder)
    dealt.repartitionByRange("bin").sortWithinPartitions("bin", F.desc("size"), "path").write.partitionBy("bin").parquet(folder)
    return folder, total // share + 1


def tree(spark: SparkSession, roots: list[str], max_bytes: int = 512 << 20, partition_bytes: int = 64 << 20, batch_bytes: int = 4 << 20, trace: str | None = None) -> DataFrame:
    """All rows of the source, with extension (lower case). The listing is planned when this is called; contents are read when the rows are.

    Conditions on path, extension and length are pushed into the source (the session's setting for that is turned on), so files
    that do not meet them are never opened. trace: a folder in which each task says how many files and bytes it opened.
    """
    spark.dataSource.register(FileSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    entries = written(listing(spark, roots).where("kind <> 'folder'"), "entries")
    plan, bins = planned(entries, partition_bytes, max_bytes)
    released(entries)
    options = {"plan": plan, "bins": bins, "max_bytes": max_bytes, "batch_bytes": batch_bytes} | ({"trace": trace} if trace else {})
    return spark.read.format("filetree").options(**options).load()


def walk(spark: SparkSession, roots: list[str], max_bytes: int = 512 << 20, partition_bytes: int = 64 << 20, batch_bytes: int = 4 << 20) -> DataFrame:
    """The rows of `tree` without the extension."""
    return tree(spark, roots, max_bytes, partition_bytes, batch_bytes).drop("extension")


def files(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("content").isNotNull()).select("file_id", "path", "length", "content")


def skipped(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("skip_reason").isNotNull()).select("path", F.col("skip_reason").alias("reason"), "error")


def failed(rows: DataFrame) -> DataFrame:
    return rows.where(F.col("error_kind").isNotNull()).select("file_id", "path", "error_kind", "error")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
