"""Archives as tables of their entries, by ranged reads: no task holds an archive.

`entries` reads the end of each archive and its directory, in pieces, and gives a row for each entry or one that says why the
archive is refused; the 64-bit records are read where the 32-bit ones say so. `payloads` deals entries to other tasks by their
packed size; each entry is read by offset and length, expanded within its declared size, and checked against its sum. An
archive of any size is so read by many tasks, and a filter on entries saves the bytes of the others.

The directory is the authority: what local headers repeat is not looked at. Refused are spanned and encrypted archives, methods other than
stored and deflate, names that leave the archive or come twice, and indexes that do not fit the bytes.
"""

from __future__ import annotations

import struct
import sys
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import dims
from .filewalk import local, remote
from .shared import running, written

# Signatures, the longest end record, and the numbers that stand for a 64-bit one.
END, END_64, LOCATOR, RECORD, LOCAL = b"PK\5\6", b"PK\6\6", b"PK\6\7", b"PK\1\2", b"PK\3\4"
TAIL, FULL_16, FULL_32, EXTRA_64, EPOCH = 22 + 0xFFFF, 0xFFFF, 0xFFFFFFFF, 1, 0x00210000
#: Entries of one archive, bytes that one entry may expand to, and that as a multiple of its packed size (a floor for tiny ones).
MOST_ITEMS, MOST_BYTES, MOST_RATIO, FLOOR = 1_000_000, 256 << 20, 200, 1024

Read = Callable[[int, int], bytes]
FAILURE = "struct<error_kind:string,detail:string,offset:bigint,limit:string,unsupported_kind:string>"
ENTRIES = f"path string, entry_no bigint, name string, raw_name binary, method int, flags int, crc bigint, size bigint, packed_size bigint, at bigint, stamped boolean, host boolean, failure {FAILURE}"


class Refused(Exception):
    def __init__(self, detail: str | None, offset: int | None = None, limit: str | None = None):
        super().__init__(detail or limit)
        self.detail, self.offset, self.limit = detail, offset, limit

    @property
    def row(self) -> dict:
        return {"error_kind": "limit-exceeded" if self.limit else "malformed", "detail": self.detail, "offset": self.offset, "limit": self.limit, "unsupported_kind": None}


class Entry(NamedTuple):
    raw: bytes
    method: int
    flags: int
    crc: int
    size: int
    packed: int
    at: int
    stamped: bool
    host: bool
    record: int

    @property
    def name(self) -> str | None:
        try:
            return self.raw.decode()
        except UnicodeDecodeError:
            return None


def safe(name: bytes) -> bool:
    """Whether a name stays inside the archive wherever it is unpacked."""
    return bool(name) and name[:1] != b"/" and b"\\" not in name and name[1:2] != b":" and b".." not in name.split(b"/")


def fields(extra: bytes) -> Iterator[tuple[int, bytes | None]]:
    """(tag, value) of extra fields; None for one that is longer than what is left, after which nothing follows."""
    at = 0
    while len(extra) - at >= 4:
        tag, n = struct.unpack_from("<HH", extra, at)
        whole = at + 4 + n <= len(extra)
        yield tag, extra[at + 4 : at + 4 + n] if whole else None
        if not whole:
            return
        at += 4 + n


def names_host(extra: bytes) -> bool:
    return any(tag in dims.HOST_FIELDS for tag, value in fields(extra) if value is not None)


def index(read: Read, length: int) -> tuple[int, int]:
    """(number of entries, offset of the directory), from the last record that accounts for all that follows it."""
    start = max(0, length - TAIL)
    tail = read(start, length - start)
    at = tail.rfind(END)
    while at >= 0:
        if len(tail) - at >= 22:
            disk, first, here, total, _, offset, comment = struct.unpack_from("<HHHHIIH", tail, at + 4)
            if not disk and not first and here == total and comment == len(tail) - at - 22:
                break
        at = tail.rfind(END, 0, at + 3)
    else:
        raise Refused("missing-marker")
    if total != FULL_16 and offset != FULL_32:
        return total, offset
    locator = start + at - 20
    found = read(locator, 20) if locator >= 0 else b""
    if found[:4] != LOCATOR:
        raise Refused("missing-marker", max(locator, 0))
    record = struct.unpack_from("<Q", found, 8)[0]
    if record > length:
        raise Refused("length-out-of-range", locator)
    found = read(record, 56)
    if found[:4] != END_64:
        raise Refused("missing-marker", record)
    if len(found) < 56:
        raise Refused("truncated", record)
    here, total, _, offset = struct.unpack_from("<QQQQ", found, 24)
    if here != total:
        raise Refused("unsupported-feature", record)
    return total, offset


def _sizes(record: int, extra: bytes, packed: int, size: int, at: int) -> tuple[int, int, int]:
    """The numbers of an entry, those that are full replaced by the 64-bit ones, which come in this order: size, packed, offset."""
    if FULL_32 not in (packed, size, at):
        return packed, size, at
    for tag, value in fields(extra):
        if value is None:
            raise Refused("length-out-of-range", record)
        if tag == EXTRA_64:
            wanted = [x == FULL_32 for x in (size, packed, at)]
            if len(value) < 8 * sum(wanted):
                raise Refused("truncated", record)
            wide = iter(struct.unpack_from(f"<{sum(wanted)}Q", value))
            size, packed, at = (next(wide) if w else x for w, x in zip(wanted, (size, packed, at), strict=True))
            return packed, size, at
    raise Refused("broken-index", record)


def listed(read: Read, length: int, most: int = MOST_ITEMS, piece: int = 1 << 20) -> Iterator[Entry]:
    """The entries of an archive in the order of its directory, which is read piece by piece."""
    total, at = index(read, length)
    if total > most:
        raise Refused(None, None, "item-count")
    if at > length:
        raise Refused("length-out-of-range", at)
    base, held = at, b""

    def need(n: int) -> int:
        nonlocal base, held
        if at + n > base + len(held):
            base, held = at, read(at, max(n, piece))
        return len(held) - (at - base)

    for _ in range(total):
        there = need(46)
        if held[at - base : at - base + 4] != RECORD:
            raise Refused("missing-marker", at)
        if there < 46:
            raise Refused("truncated", at)
        flags, method, modified, crc, packed, size, n, m, k, disk, _, _, offset = struct.unpack_from("<HHIIIIHHHHHII", held, at - base + 8)
        if flags & 0x41 or method not in (0, 8) or disk not in (0, FULL_16):
            raise Refused("unsupported-feature", at)
        if need(46 + n + m + k) < 46 + n + m + k:
            raise Refused("truncated", at)
        name, extra = held[at - base + 46 : at - base + 46 + n], held[at - base + 46 + n : at - base + 46 + n + m]
        if not safe(name):
            raise Refused("unexpected-marker", at)
        packed, size, offset = _sizes(at, extra, packed, size, offset)
        yield Entry(name, method, flags & ~8, crc, size, packed, offset, modified != EPOCH, names_host(extra), at)
        at += 46 + n + m + k


def packed_of(read: Read, length: int, at: int, packed: int) -> bytes:
    """The packed bytes of the entry whose local header is at an offset."""
    head = read(at, 30) if at <= length else b""
    if head[:4] != LOCAL:
        raise Refused("broken-index", at)
    if len(head) < 30:
        raise Refused("truncated", at)
    start = at + 30 + sum(struct.unpack_from("<HH", head, 26))
    if start + packed > length:
        raise Refused("length-out-of-range", start)
    return read(start, packed)


def expanded(method: int, packed: bytes, size: int, crc: int, budget: int = MOST_BYTES) -> bytes:
    """An entry's content, never more than it declares; what it declares is bounded first."""
    if size > budget or method == 8 and size > max(MOST_RATIO * len(packed), FLOOR):
        raise Refused(None, None, "expanded-size")
    if method == 8:
        pump = zlib.decompressobj(-15)
        try:
            packed = pump.decompress(packed, size + 1)
        except zlib.error:
            raise Refused("truncated") from None
        if not pump.eof and len(packed) > size:
            raise Refused(None, None, "expanded-size")
    if len(packed) != size:
        raise Refused("length-out-of-range")
    if zlib.crc32(packed) != crc:
        raise Refused("broken-index")
    return packed


class Ranged:
    """A file that is read by offset and length; `taken` counts the bytes."""

    def __init__(self, path: str):
        own = local(path)
        self.taken = 0
        if own is not None:
            self.file = open(own, "rb")  # noqa: SIM115
            self.length = self.file.seek(0, 2)
        else:
            system, inner, _ = remote(path)
            self.file = system.open_input_file(inner)
            self.length = self.file.size()

    def __call__(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        out = self.file.read(max(0, min(n, self.length - at)))
        self.taken += len(out)
        return out

    def close(self) -> None:
        self.file.close()


IO = {"error_kind": "io", "detail": None, "offset": None, "limit": None, "unsupported_kind": None}


def _batch(rows: list[tuple], names: list[str]):
    import pyarrow as pa

    text = pa.string()
    failure = pa.struct([("error_kind", text), ("detail", text), ("offset", pa.int64()), ("limit", text), ("unsupported_kind", text)])
    kinds = {"path": text, "name": text, "raw_name": pa.binary(), "method": pa.int32(), "flags": pa.int32(), "stamped": pa.bool_(), "host": pa.bool_(), "data": pa.binary(), "failure": failure}
    columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.int64())) for c, n in zip(columns, names, strict=True)], names=names)


def _lister(most: int):
    names = [c.strip().split()[0] for c in ENTRIES.split(" failure")[0].rstrip(",").split(",")] + ["failure"]

    def each(batches):
        for b in batches:
            for path in b.column("path").to_pylist():
                rows: list[tuple] = []
                source = None
                try:
                    source = Ranged(path)
                    for i, e in enumerate(listed(source, source.length, most)):
                        rows.append((path, i, e.name, e.raw, e.method, e.flags, e.crc, e.size, e.packed, e.at, e.stamped, e.host, None))
                        if len(rows) == 50_000:
                            yield _batch(rows, names)
                            rows = []
                except Refused as e:
                    rows.append((path, None, *[None] * 10, e.row))
                except OSError:
                    rows.append((path, None, *[None] * 10, IO))
                finally:
                    if source:
                        source.close()
                yield _batch(rows, names)

    return each


def entries(archives: DataFrame, most: int = MOST_ITEMS) -> DataFrame:
    """archives (path) -> ENTRIES, written: one row for each entry, and one with a failure for an archive that is refused.

    A failure may come after entries, when the directory breaks off; `refused` names such archives. Names that come twice refuse
    theirs too.
    """
    found = written(archives.select("path").mapInArrow(_lister(most), ENTRIES), "archive-entries")
    again = found.where("raw_name IS NOT NULL").groupBy("path", "raw_name").agg(F.count("*").alias("n"), F.max_by("at", "entry_no").alias("at")).where("n > 1")
    none = F.lit(None).cast("string")
    twice = F.struct(F.lit("malformed").alias("error_kind"), F.lit("duplicate-entry").alias("detail"), F.min("at").alias("offset"), none.alias("limit"), none.alias("unsupported_kind"))
    twice = again.groupBy("path").agg(twice.alias("failure"))
    return found.unionByName(twice, allowMissingColumns=True)


def refused(rows: DataFrame) -> DataFrame:
    """(path, failure): the first of each archive's, by offset."""
    return rows.where("failure IS NOT NULL").groupBy("path").agg(F.min_by("failure", F.coalesce("failure.offset", F.lit(0))).alias("failure"))


def _taker(budget: int):
    names = ["path", "entry_no", "data", "failure"]

    def each(batches):
        last, source = None, None
        for b in batches:
            rows, held = [], 0
            for path, no, method, crc, size, packed, at in zip(*(b.column(c).to_pylist() for c in ("path", "entry_no", "method", "crc", "size", "packed_size", "at")), strict=True):
                try:
                    if path != last:
                        if source:
                            source.close()
                        source, last = None, path
                        source = Ranged(path)
                    if source is None:
                        raise OSError(path)
                    data = expanded(method, packed_of(source, source.length, at, packed) if size <= budget else b"", size, crc, budget)
                    rows.append((path, no, data, None))
                    held += len(data)
                except Refused as e:
                    rows.append((path, no, None, e.row))
                except OSError:
                    rows.append((path, no, None, IO))
                if held > 4 << 20:
                    yield _batch(rows, names)
                    rows, held = [], 0
            yield _batch(rows, names)
        if source:
            source.close()

    return each


def payloads(rows: DataFrame, partition_bytes: int = 64 << 20, most: int = MOST_BYTES) -> DataFrame:
    """entries -> (path, entry_no, data, failure): content by offset and length, dealt to tasks by packed size whatever the archive.

    An archive whose entries together declare more than `most` gives a failure for each entry beyond, by a running sum over its directory.
    """
    wanted = rows.where("entry_no IS NOT NULL").select("path", "entry_no", "method", "crc", "size", "packed_size", "at")
    before = F.sum("size").over(Window.partitionBy("path").orderBy("entry_no").rowsBetween(Window.unboundedPreceding, 0))
    wanted = wanted.withColumns({"size": F.when(before > most, F.lit(most + 1)).otherwise(F.col("size")), "weight": F.col("packed_size") + 4096})
    dealt = running(wanted, ["path", "entry_no"], {"start": "weight"}, "archive-ranges").withColumn("bin", F.floor(F.col("start") / partition_bytes))
    bins = max(1, min(100_000, (dealt.agg(F.max("bin")).first()[0] or 0) + 1))
    dealt = dealt.repartition(bins, "bin").sortWithinPartitions("path", "at")
    return dealt.mapInArrow(_taker(most), f"path string, entry_no bigint, data binary, failure {FAILURE}")


cloudpickle.register_pickle_by_value(sys.modules[__name__])
