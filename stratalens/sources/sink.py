"""The file sink: one file for each row, complete or not there at all, whatever is lost and tried again meanwhile.

Two steps, each of which may be repeated. Tasks stage each file beside its destination, under a name of the job and of their own
attempt, flushed to disk; which attempt counts is what Spark commits. Then staged files are renamed. A rename that
finds its staged file gone and the destination there was done by an attempt before it, so it reports success; a destination
that is somebody else's leaves the staged file where it is until both steps are over, so that this holds. At last what
the job left beside the destinations is swept away.

`write_files` does both steps as Spark jobs and gives a row for each file: the renames are tasks too, and nothing is collected.
The data source `atomicfiles` is the same as a writer: tasks stage and list what they staged in a manifest, `commit` renames from
the manifests that the tasks' messages name, `abort` removes what they list.

Destinations are paths or URIs. Plain paths and file: URIs are the machine's own, which on a cluster must be mounted on all
machines; there an existing destination is never overwritten without `replace`. Other URIs are written through the Arrow
file system of their scheme: a rename is as atomic as the store makes it, permissions are the store's, and whether a destination exists is
looked up before the rename, so two jobs that write one name at once are not told apart. New files are readable by their owner only.
"""

from __future__ import annotations

import json
import os
import sys
import uuid
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from .filewalk import local, remote
from .shared import released, root, written

STAGED = "file_id string, output_path string, staged string, output_bytes bigint, error_kind string"
RESULT = "file_id string, output_path string, output_bytes bigint, error_kind string"


def _beside(path: str, tag: str) -> str:
    folder, _, name = path.rpartition("/")
    return f"{folder}/.{name}.{tag}.part" if folder or path.startswith("/") else f".{name}.{tag}.part"


def stage(path: str, data: bytes, tag: str) -> tuple[str | None, str | None]:
    """Writes data beside a destination: (staged path, kind of error)."""
    own = local(path)
    staged = _beside(path if own is None else own, tag)
    try:
        if own is None:
            system, inner, _ = remote(staged)
            with system.open_output_stream(inner) as f:
                f.write(data)
            return staged, None
        handle = os.open(staged, os.O_WRONLY | os.O_CREAT | os.O_TRUNC, 0o600)
        try:
            with os.fdopen(handle, "wb") as f:
                f.write(data)
                f.flush()
                os.fsync(f.fileno())
        except BaseException:
            discard(staged)
            raise
    except OSError:
        return None, "io"
    return staged, None


def publish(staged: str, path: str, replace: bool) -> str | None:
    """Renames a staged file to its destination, again and again if need be: the kind of error, if any."""
    own = local(path)
    try:
        if own is None:
            return _publish_remote(staged, path, replace)
        if replace:
            try:
                os.replace(staged, own)
            except FileNotFoundError:
                return None if os.path.exists(own) else "io"
            return None
        try:
            os.link(staged, own)  # fails, atomically, where the destination exists
        except FileNotFoundError:
            return None if os.path.exists(own) else "io"
        except FileExistsError:
            if not os.path.exists(staged):
                return None
            if not os.path.samefile(staged, own):
                return "output-exists"
        discard(staged)
    except OSError:
        return "io"
    return None


def _publish_remote(staged: str, path: str, replace: bool) -> str | None:
    from pyarrow import fs

    system, inner, _ = remote(path)
    _, source, _ = remote(staged)
    waiting, there = (i.type != fs.FileType.NotFound for i in system.get_file_info([source, inner]))
    if not waiting:
        return None if there else "io"
    if there and not replace:
        return "output-exists"
    try:
        system.move(source, inner)
    except OSError:
        if not there:
            raise
        old = f"{source}.old"  # the store does not rename over a file: the old one stays beside until the new one is there
        system.move(inner, old)
        system.move(source, inner)
        system.delete_file(old)
    return None


def discard(staged: str) -> None:
    """Removes a staged file, if it is still there."""
    try:
        if local(staged) is not None:
            os.unlink(local(staged))
        else:
            system, inner, _ = remote(staged)
            system.delete_file(inner)
    except OSError:
        pass


def put(path: str, data: bytes, tag: str, replace: bool) -> str | None:
    """Both steps for one file; returns the kind of error, if any."""
    staged, kind = stage(path, data, tag)
    if kind is None:
        kind = publish(staged, path, replace)
        if kind:
            discard(staged)
    return kind


def _tag(job: str) -> str:
    from pyspark import TaskContext

    context = TaskContext.get()
    return f"{job}-{context.taskAttemptId() if context else 0}"


def _rows(rows: list[tuple], schema: str):
    import pyarrow as pa

    fields = [f.split() for f in schema.split(", ")]
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64() if t == "bigint" else pa.string()) for c, (_, t) in zip(columns, fields, strict=True)], names=[n for n, _ in fields])


def _stager(job: str, replace: bool):
    def write(batches):
        tag = _tag(job)
        for b in batches:
            rows = []
            contents = b.column("content")
            for i, (file_id, path, taken) in enumerate(zip(*(b.column(c).to_pylist() for c in ("file_id", "output_path", "output_exists")), strict=True)):
                data = contents[i].as_py()  # one file's bytes at a time
                staged, kind = (None, "output-exists") if taken and not replace else stage(path, data, tag)
                rows.append((file_id, path, staged, None if kind else len(data), kind))
            yield _rows(rows, STAGED)

    return write


def _publisher(replace: bool):
    def write(batches):
        for b in batches:
            rows = []
            for file_id, path, staged, size, kind in zip(*(c.to_pylist() for c in b.columns), strict=True):
                kind = kind or publish(staged, path, replace)
                rows.append((file_id, path, None if kind else size, kind))
            yield _rows(rows, RESULT)

    return write


def _sweeper(job: str):
    """Removes what a job staged in folders and did not rename: the losing attempts' files among them."""

    def sweep(batches):
        for b in batches:
            rows = []
            for folder in b.column("folder").to_pylist():
                own = local(folder)
                names = os.listdir(own or ".") if own is not None else []
                if own is None:
                    from pyarrow import fs

                    system, inner, prefix = remote(folder)
                    names = [i.base_name for i in system.get_file_info(fs.FileSelector(inner, allow_not_found=True))]
                left = [n for n in names if n.startswith(".") and f".{job}-" in n and n.endswith((".part", ".part.old"))]
                for name in left:
                    discard(f"{folder}/{name}" if folder else name)
                rows.append((folder, len(left)))
            yield _rows(rows, "folder string, removed bigint")

    return sweep


def swept(paths: DataFrame, job: str) -> DataFrame:
    """(folder, removed) of the folders of output_path."""
    folders = paths.select(F.regexp_extract("output_path", "^(.*)/[^/]*$", 1).alias("folder")).distinct()
    return folders.mapInArrow(_sweeper(job), "folder string, removed bigint")


def write_files(rows: DataFrame, replace: bool = False) -> DataFrame:
    """rows: file_id, output_path, content, output_exists (another row of the batch has the name). One result row each; the files are there when this returns."""
    job = uuid.uuid4().hex
    staged = written(rows.select("file_id", "output_path", "content", "output_exists").mapInArrow(_stager(job, replace), STAGED), "staged")
    done = written(staged.mapInArrow(_publisher(replace), RESULT), "published")
    swept(staged, job).write.format("noop").mode("overwrite").save()
    released(staged)
    return done


# --- the same as a data source ---------------------------------------------------------------------------------------------


@dataclass
class Staged(WriterCommitMessage):
    """What a task has staged: its manifest, and how many files and bytes it lists."""

    manifest: str
    files: int
    bytes: int


def _opened(path: str, mode: str):
    own = local(path)
    if own is not None:
        if mode == "w":
            os.makedirs(os.path.dirname(own), exist_ok=True)
        return open(own, f"{mode}b")
    system, inner, _ = remote(path)
    if mode == "w":
        system.create_dir(inner.rpartition("/")[0], recursive=True)
    return system.open_output_stream(inner) if mode == "w" else system.open_input_stream(inner)


class FileWriter(DataSourceWriter):
    """Rows (output_path, content) -> files. The driver holds one manifest at a time, and messages of a fixed size for each task."""

    def __init__(self, options: dict, names: list[str]):
        self.replace = options.get("replace", "false").lower() == "true"
        self.manifests, self.job = options["manifests"].rstrip("/"), uuid.uuid4().hex
        self.path, self.content = names.index("output_path"), names.index("content")

    def write(self, iterator):
        tag = _tag(self.job)
        manifest, n, size = f"{self.manifests}/{tag}.jsonl", 0, 0
        listed: list[str] = []
        try:
            with _opened(manifest, "w") as f:
                for row in iterator:
                    staged, kind = stage(row[self.path], bytes(row[self.content]), tag)
                    if kind:
                        raise OSError(f"{row[self.path]} could not be staged")
                    listed.append(staged)
                    f.write(json.dumps([staged, row[self.path]]).encode() + b"\n")
                    n, size = n + 1, size + len(row[self.content])
        except BaseException:  # a failed attempt has no message: it removes its own files
            for staged in listed:
                discard(staged)
            raise
        return Staged(manifest, n, size)

    def _each(self, messages, do) -> list:
        """do(staged, path) for all that the messages' manifests list, several at a time; what it returned, where it is something."""
        from concurrent.futures import ThreadPoolExecutor

        out = []
        with ThreadPoolExecutor(16) as pool:
            for m in messages:
                if m is not None:
                    try:
                        with _opened(m.manifest, "r") as f:
                            pairs = [json.loads(line) for line in f.read().splitlines()]
                    except FileNotFoundError:  # all it listed is done with
                        continue
                    out += [(p, x) for (_, p), x in zip(pairs, pool.map(lambda p: do(*p), pairs), strict=True) if x]
        return out

    def commit(self, messages):
        failed = self._each(messages, lambda staged, path: publish(staged, path, self.replace))
        self.abort(messages)
        if failed:
            raise OSError(f"{len(failed)} files were not written, the first: {failed[0][0]} ({failed[0][1]})")

    def abort(self, messages):
        self._each(messages, lambda staged, path: discard(staged))
        for m in messages:
            if m is not None:
                discard(m.manifest)


class FileSink(DataSource):
    """df.write.format("atomicfiles").mode("append").options(manifests=a shared folder, replace=...).save(): see `save`."""

    @classmethod
    def name(cls):
        return "atomicfiles"

    def writer(self, schema, overwrite):
        return FileWriter(dict(self.options), schema.names)


def save(rows: DataFrame, replace: bool = False) -> None:
    """Rows (output_path, content) as files by the data source: all are there afterwards, or an error says which is not."""
    spark: SparkSession = rows.sparkSession
    spark.dataSource.register(FileSink)
    rows.select("output_path", "content").write.format("atomicfiles").mode("append").options(manifests=f"{root(spark)}/manifests", replace=str(replace)).save()


cloudpickle.register_pickle_by_value(sys.modules[__name__])
