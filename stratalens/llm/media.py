"""Operator 6, media columns in archives, read by a custom data source.

Writing: each task stores its rows' payloads as 8-bit grey PNG pictures, 192 samples wide, in ZIP archives (stored, not
compressed again) below a shared folder. An archive's name holds the task attempt, and only names of attempts that succeeded
reach the manifest, so that a lost executor or a speculative copy leaves no wrong archive in it.

Reading: the source `zip_members` takes the manifest's archives and plans byte ranges over them, by size alone; a task reads its
archive's directory and takes the members whose header starts in its range. Payloads stream through Arrow in batches of
bounded bytes. A member that cannot be read or whose checksum differs is read again by its own offset, up to `retries`
times with the file opened anew, then it gives a row with `error` and no payload; its neighbours are unaffected.

Defined results: a null or empty text is one picture of 192 blanks; repeated rows are stored each; null ids are kept;
other columns are not stored; an empty table gives no archives and an empty result.
"""

from __future__ import annotations

import struct
import uuid
import zlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .common import scratch, ship, small_batches, texts_of, to_bytes
from .token_files import _file_uri, open_fs

ship(__name__)

WIDTH = 192
MEMBERS = "key string, archive string, offset long, payload binary, error string"


# --- the stored form ---------------------------------------------------------------------------------------------------


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_picture(text: bytes) -> bytes:
    """The text, padded with blanks to whole rows, as a grey PNG; its unpadded length is in a text chunk."""
    import numpy as np

    rows = max(1, -(-len(text) // WIDTH))
    samples = np.full((rows, WIDTH + 1), 32, np.uint8)
    samples[:, 0] = 0  # the row filter: none
    body = np.full(rows * WIDTH, 32, np.uint8)
    body[: len(text)] = np.frombuffer(text, np.uint8)
    samples[:, 1:] = body.reshape(rows, WIDTH)
    head = struct.pack(">IIBBBBB", WIDTH, rows, 8, 0, 0, 0, 0)
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", head) + _chunk(b"tEXt", b"n_bytes\0%d" % len(text)) + _chunk(b"IDAT", zlib.compress(samples.tobytes(), 4)) + _chunk(b"IEND", b"")


def from_picture(media: bytes):
    """The samples of such a picture as an array of rows, and the unpadded length."""
    import numpy as np

    at, data, rows, n_bytes = 8, [], 0, 0
    while at < len(media):
        n, kind = struct.unpack_from(">I4s", media, at)
        body = media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + body) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("chunk checksum")
        if kind == b"IHDR":
            rows = struct.unpack_from(">II", body)[1]
        elif kind == b"tEXt" and body.startswith(b"n_bytes\0"):
            n_bytes = int(body[8:])
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + n
    return np.frombuffer(zlib.decompress(b"".join(data)), np.uint8).reshape(rows, WIDTH + 1)[:, 1:], n_bytes


def feature(samples) -> str:
    """Height, mean sample and an average hash of 8 by 8 areas, all from integers."""
    import numpy as np

    rows = len(samples)
    edges = [i * rows // 8 for i in range(9)]
    strips = samples.reshape(rows, 8, WIDTH // 8).sum(axis=2, dtype=np.int64)
    areas = [strips[a : max(b, a + 1)].mean(axis=0) if a < rows else strips[-1] * 1.0 for a, b in zip(edges, edges[1:], strict=False)]
    areas = np.array(areas) / (WIDTH // 8)
    bits = (areas > areas.mean()).reshape(-1)
    return f"{rows}:{int(samples.sum(dtype=np.int64)) * 1000 // samples.size}:{int(np.packbits(bits).view('>u8')[0]):016x}"


# --- archives ----------------------------------------------------------------------------------------------------------


class ArchiveWriter:
    """A ZIP archive of stored members, below 2 GiB and 65,535 members, so that no extension fields are needed."""

    def __init__(self, fs, path: str):
        self.fs, self.path, self.at, self.entries = fs, path, 0, []
        self.out = fs.open_output_stream(path)

    def add(self, name: bytes, data: bytes) -> None:
        crc = zlib.crc32(data)
        sizes = struct.pack("<IIIHH", crc, len(data), len(data), len(name), 0)
        self.entries.append(b"PK\1\2" + struct.pack("<HHHHHH", 20, 20, 0, 0, 0, 33) + sizes + struct.pack("<HHHII", 0, 0, 0, 0, self.at) + name)
        local = b"PK\3\4" + struct.pack("<HHHHH", 20, 0, 0, 0, 33) + sizes + name
        self.out.write(local + data)
        self.at += len(local) + len(data)

    def close(self) -> int:
        """Writes the directory; the archive's size."""
        directory = b"".join(self.entries)
        n = len(self.entries)
        self.out.write(directory + b"PK\5\6" + struct.pack("<HHHHIIH", 0, 0, n, n, len(directory), self.at, 0))
        self.out.close()
        return self.at + len(directory) + 22


def read_directory(f, size: int) -> list[tuple[str, int, int, int]]:
    """(name, offset of the local header, stored size, CRC) of each member, from the end of the archive."""
    tail_at = max(0, size - 65_557)
    tail = f.read_at(size - tail_at, tail_at)
    at = tail.rfind(b"PK\5\6")
    if at < 0:
        raise ValueError("no archive directory")
    n, length, start = struct.unpack_from("<HII", tail, at + 10)
    raw = f.read_at(length, start)
    out, p = [], 0
    for _ in range(n):
        crc, stored, _, name, extra, comment = struct.unpack_from("<IIIHHH", raw, p + 16)
        offset = struct.unpack_from("<I", raw, p + 42)[0]
        out.append((raw[p + 46 : p + 46 + name].decode(), offset, stored, crc))
        p += 46 + name + extra + comment
    return out


def read_member(fs, path: str, offset: int, stored: int, crc: int, retries: int, f=None) -> tuple[bytes | None, str | None]:
    """One member by its offset, with its own retries; the file is opened anew after a failure."""
    error = None
    for _ in range(retries + 1):
        try:
            g = f or fs.open_input_file(path)
            head = g.read_at(30, offset)
            name, extra = struct.unpack_from("<HH", head, 26)
            data = g.read_at(stored, offset + 30 + name + extra)
            if head[:4] != b"PK\3\4" or len(data) != stored or zlib.crc32(data) != crc:
                raise ValueError("member checksum")
            return data, None
        except (OSError, ValueError, struct.error) as e:
            error, f = f"{type(e).__name__}: {e}", None
    return None, error


class ByteRange(InputPartition):
    def __init__(self, path: str, size: int, start: int, end: int):
        self.path, self.size, self.start, self.end = path, size, start, end


class ZipMembersReader(DataSourceReader):
    def __init__(self, options: dict):
        self.manifest = options["path"]
        self.range = int(options.get("rangebytes", 16 << 20))
        self.batch = int(options.get("batchbytes", 4 << 20))
        self.retries = int(options.get("retries", 2))

    def partitions(self):
        from pyarrow import dataset

        fs, root = open_fs(self.manifest)
        rows = dataset.dataset(root, filesystem=fs, format="parquet", exclude_invalid_files=False).to_table().to_pylist()
        files = sorted((r["archive"], r["bytes"]) for r in rows)
        return [ByteRange(p, n, a, min(a + self.range, n)) for p, n in files for a in range(0, n, self.range)] or [ByteRange("", 0, 0, 0)]

    def read(self, part):
        import pyarrow as pa

        schema = pa.schema([("key", pa.string()), ("archive", pa.string()), ("offset", pa.int64()), ("payload", pa.binary()), ("error", pa.string())])
        if not part.path:
            return
        fs, _ = open_fs(self.manifest)
        rows, held = [], 0
        with fs.open_input_file(part.path) as f:
            for name, offset, stored, crc in read_directory(f, part.size):
                if part.start <= offset < part.end:
                    data, error = read_member(fs, part.path, offset, stored, crc, self.retries, f)
                    rows.append((name, part.path, offset, data, error))
                    held += stored
                    if held >= self.batch:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                        rows, held = [], 0
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


class ZipMembers(DataSource):
    """Members of the ZIP archives of a manifest (Parquet: archive, bytes). Options: path, rangebytes, batchbytes, retries."""

    @classmethod
    def name(cls):
        return "zip_members"

    def schema(self):
        return MEMBERS

    def reader(self, schema):
        return ZipMembersReader(dict(self.options))


# --- the operator ------------------------------------------------------------------------------------------------------


def _archiver(folder: str, most_bytes: int, most_members: int):
    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        fs, root = open_fs(folder)
        fs.create_dir(root, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{TaskContext.get().taskAttemptId()}"
        made, sizes, out = [], [], None
        for batch in batches:
            for key, text in zip(batch.column("doc_id").to_pylist(), to_bytes(batch.column("text")), strict=True):
                if out is not None and (out.at >= most_bytes or len(out.entries) >= most_members):
                    sizes.append(out.close())
                    out = None
                if out is None:
                    made.append(f"{root}/{name}-{len(made):04d}.zip")
                    out = ArchiveWriter(fs, made[-1])
                out.add(b"null" if key is None else b"%d" % key, to_picture(text))
        if out is not None:
            sizes.append(out.close())
        yield pa.RecordBatch.from_arrays([pa.array(made, pa.string()), pa.array(sizes, pa.int64())], names=["archive", "bytes"])

    return write


def write_archives(docs: DataFrame, folder: str, text: str = "text", most_bytes: int = 64 << 20, most_members: int = 60_000) -> str:
    """Stores docs' texts as pictures in archives below the folder; returns the manifest, a Parquet table below it: (archive, bytes)."""
    small_batches(docs.sparkSession)
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), texts_of(docs, text).alias("text"))
    manifest = f"{folder}/manifest-{uuid.uuid4().hex}"
    plain.mapInArrow(_archiver(_file_uri(folder), most_bytes, most_members), "archive string, bytes long").write.parquet(manifest)
    return manifest


def read_archives(spark: SparkSession, manifest: str, **options) -> DataFrame:
    """key, archive, offset, payload, error of every member of the manifest's archives."""
    spark.dataSource.register(ZipMembers)
    return spark.read.format("zip_members").options(**options).load(_file_uri(manifest))


FACTS = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, error string"


def _facts(batches):
    import hashlib

    import pyarrow as pa

    names = [c.split()[0] for c in FACTS.split(", ")]
    kinds = [pa.int64() if c.endswith("long") else pa.string() for c in FACTS.split(", ")]
    for batch in batches:
        rows = []
        for key, media, error in zip(batch.column("key").to_pylist(), batch.column("payload").to_pylist(), batch.column("error").to_pylist(), strict=True):
            doc = None if key == "null" else int(key)
            if media is None:
                rows.append((doc, None, None, None, None, None, None, None, error))
                continue
            samples, n_bytes = from_picture(media)
            payload = samples.tobytes()
            rows.append((doc, n_bytes, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(media), hashlib.sha256(media).hexdigest(), feature(samples), None))
        columns = zip(*rows, strict=True) if rows else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def media_facts(members: DataFrame) -> DataFrame:
    """What a picture's stored bytes give: FACTS."""
    return members.select("key", "payload", "error").mapInArrow(_facts, FACTS)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: all documents stored as pictures in archives and read back."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    folder = scratch(spark, "media")
    return media_facts(read_archives(spark, write_archives(docs, folder))).drop("error")
