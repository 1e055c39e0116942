"""Operator 5, flat token-id files with 64-bit document offsets.

Documents are range-partitioned and sorted by id, and each task encodes its range and streams two files into a shared
folder: the ids as flat unsigned integers (16 bits if the vocabulary allows, else 32, little-endian) and the documents'
first positions as unsigned 64-bit integers, one more than documents. Each task returns one summary row; prefix sums over
these few rows give every file's base, which the manifest holds. Readers map the files into memory.

A file's name holds the task attempt, and only names of attempts that succeeded reach the manifest, so that a lost
executor or a speculative copy leaves no wrong file in it.

Defined results: a null or empty text is the end id alone; documents are in ascending id, null first (how many a file has is in
its manifest row, so no id stands for null), repeated ids in order of the text's hash, equal rows as they come, in as many tasks as
their sizes need; other columns are not stored; an empty table gives a manifest of no documents.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import tokens
from .common import materialize, scratch, ship, slices, small_batches, texts_of, to_bytes

ship(__name__)

SUMMARY = "part int, ids string, offsets string, dtype string, n_docs long, n_ids long, doc_bytes long, n_null long"


def open_fs(folder: str):
    """The Arrow file system of a URI or path, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def _file_uri(uri: str) -> str:
    """file:/a and file:///a name the same file; Arrow takes the latter."""
    return "file:///" + uri.removeprefix("file:").lstrip("/") if uri.startswith("file:") else uri


def _writer(raw: bytes, dtype: str, folder: str, end_id: int):
    def write(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        context = TaskContext.get()
        part = context.partitionId()
        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        name = f"{root}/part-{part:06d}-{context.taskAttemptId()}"
        table, cut = tokens.id_bytes_table(raw, dtype)
        end, width = np.asarray([end_id], dtype).tobytes(), np.dtype(dtype).itemsize
        at = n_docs = n_null = 0
        with fs.open_output_stream(f"{name}.ids") as ids, fs.open_output_stream(f"{name}.offsets") as offsets, fs.open_output_stream(f"{name}.docs") as docs:
            offsets.write(np.zeros(1, "<u8").tobytes())
            for batch in batches:
                texts, keys = to_bytes(batch.column("text")), batch.column("doc_id")
                docs.write(np.asarray(keys.fill_null(0)).astype("<i8").tobytes())
                n_null += keys.null_count  # they come first
                for a, b in slices(texts):
                    words = [cut(t) for t in texts[a:b]]
                    table.ready([w for ws in words for w in ws])
                    rows = [b"".join(map(table.__getitem__, ws)) + end for ws in words]
                    ends = at + np.cumsum([len(r) // width for r in rows], dtype="<u8")
                    ids.write(b"".join(rows))
                    offsets.write(ends.astype("<u8").tobytes())
                    at, n_docs = int(ends[-1]), n_docs + len(rows)
        yield pa.RecordBatch.from_pydict(
            {"part": [part], "ids": [f"{name}.ids"], "offsets": [f"{name}.offsets"], "dtype": [dtype], "n_docs": [n_docs], "n_ids": [at], "doc_bytes": [8 * n_docs], "n_null": [n_null]},
            schema=pa.schema([("part", pa.int32()), ("ids", pa.string()), ("offsets", pa.string()), ("dtype", pa.string()), ("n_docs", pa.int64()), ("n_ids", pa.int64()), ("doc_bytes", pa.int64()), ("n_null", pa.int64())]),
        )

    return write


def write_token_files(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 2, text: str = "text") -> DataFrame:
    """Writes the files below `folder` and returns the manifest: SUMMARY's columns, base_ids and base_docs."""
    small_batches(docs.sparkSession)
    raw, _ = tokens.load_file(tokenizer)
    spec = json.loads(raw)
    most = max(end_id, *spec["model"]["vocab"].values(), *(t["id"] for t in spec.get("added_tokens", [])))
    dtype = "<u2" if most < 2**16 else "<u4"
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), texts_of(docs, text).alias("text"))
    plain = plain.withColumns({"h": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    ranged = plain.repartitionByRange("doc_id", "h", "row").sortWithinPartitions("doc_id", "h", "row")
    written = materialize(ranged.select("doc_id", "text").mapInArrow(_writer(raw, dtype, _file_uri(folder), end_id), SUMMARY), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return written.withColumns({"base_ids": F.coalesce(F.sum("n_ids").over(before), F.lit(0)), "base_docs": F.coalesce(F.sum("n_docs").over(before), F.lit(0))})


def mapped(folder: str, path: str, dtype: str):
    """A stored file as an array: mapped into memory where it is local, else read."""
    import numpy as np
    import pyarrow as pa

    fs, _ = open_fs(folder)
    if fs.type_name == "local":
        return np.frombuffer(pa.memory_map(path).read_buffer(), dtype)
    return np.frombuffer(fs.open_input_file(path).read_buffer(), dtype)


def _reader(folder: str):
    def read(batches):
        import zlib

        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row in batch.to_pylist():
                ids = mapped(folder, row["ids"], row["dtype"])
                at = mapped(folder, row["offsets"], "<u8").astype("int64")
                keys = mapped(folder, row["ids"].removesuffix(".ids") + ".docs", "<i8")
                for a in range(0, len(keys), 4096):
                    b = min(a + 4096, len(keys))
                    crc = [zlib.crc32(ids[at[i] : at[i + 1]].astype("<u4").tobytes()) for i in range(a, b)]
                    doc = pa.array(keys[a:b], pa.int64(), mask=np.arange(a, b) < row["n_null"])
                    yield pa.RecordBatch.from_arrays([doc, pa.array(row["base_ids"] + at[a:b]), pa.array(np.diff(at[a : b + 1])), pa.array(crc, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return read


def read_token_files(manifest: DataFrame, folder: str) -> DataFrame:
    """Per document from the files: doc_id, start, n_tokens, ids_crc32 (of the ids as little-endian unsigned 32-bit integers)."""
    # About one file to a task. The manifest has one small row for each file, so the number of tasks is given: by size alone they would meet in one.
    parts = manifest.select("part", "ids", "offsets", "dtype", "base_ids", "n_null")
    parts = parts.repartition(max(1, parts.count()), "part")
    return parts.mapInArrow(_reader(_file_uri(folder)), "doc_id long, start long, n_tokens long, ids_crc32 long")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: all documents written as token files and read back."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = scratch(spark, "token-files")
    return read_token_files(write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), folder), folder)
