"""What a ZIP package says it is: its directory and a few small index parts are read, in Python, for rows that begin like a ZIP only."""

from __future__ import annotations

import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .detect import begins

# Content types of main parts, and media types.
OOXML = {"wordprocessingml.document.main+xml": "docx", "spreadsheetml.sheet.main+xml": "xlsx", "presentationml.presentation.main+xml": "pptx"}
MACROS = tuple(f"{t}.macroEnabled.main+xml" for t in ("wordprocessingml.document", "spreadsheetml.sheet", "presentationml.presentation"))
ODF_PREFIX = "application/vnd.oasis.opendocument."
ODF = {"text": "odt", "spreadsheet": "ods", "presentation": "odp"}
#: First bytes of a ZIP.
ZIPS = (b"PK\3\4", b"PK\5\6", b"PK\7\x08")
#: Bytes of an index part that are inflated at most.
INDEX_BYTES = 4 << 20


def package(data: bytes) -> str | None:
    """docx, xlsx, pptx, odt, ods, odp, macro-enabled-office, other-open-document, or None. Whatever is broken is None."""
    import io
    import re
    import zipfile

    def part(name: str) -> str | None:
        try:
            with z.open(name) as f:
                raw = f.read(INDEX_BYTES + 1)
            return raw.decode() if len(raw) <= INDEX_BYTES else None
        except (KeyError, OSError, ValueError, RuntimeError, NotImplementedError, zipfile.BadZipFile, EOFError):
            return None

    try:
        z = zipfile.ZipFile(io.BytesIO(data))
    except (zipfile.BadZipFile, OSError, ValueError, NotImplementedError):
        return None
    declared = (part("mimetype") or "").strip()
    if not declared.startswith(ODF_PREFIX):
        root = re.search(r"<[^<>]*file-entry\b(?=[^<>]*full-path=[\"']/[\"'])[^<>]*media-type=[\"']([^\"']*)", part("META-INF/manifest.xml") or "")
        declared = root[1] if root else ""
    if declared.startswith(ODF_PREFIX):
        return ODF.get(declared.removeprefix(ODF_PREFIX), "other-open-document")
    types = part("[Content_Types].xml") or ""
    if any(m in types for m in MACROS):
        return "macro-enabled-office"
    return next((f for t, f in OOXML.items() if t in types), None)


def _read(column: int, names: list[str]):
    def read(batches):
        import pyarrow as pa

        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([package(x) if x and x.startswith(ZIPS) else None for x in b.column(column).to_pylist()], pa.string())], names=names)

    return read


def with_packages(files: DataFrame, content: str = "content", zips: bool = False) -> DataFrame:
    """files with __package, which `detected` then uses. Rows that do not begin like a ZIP never reach Python; zips: nearly all do, and one pass over files is enough."""
    schema = T.StructType(list(files.schema.fields)).add("__package", T.StringType())
    read = lambda rows: rows.mapInArrow(_read(files.columns.index(content), schema.names), schema)
    if zips:
        return read(files)
    zipped = F.coalesce(begins(F.col(content), *[z.hex() for z in ZIPS]), F.lit(False))
    return files.where(~zipped).withColumn("__package", F.lit(None).cast("string")).unionByName(read(files.where(zipped)))


cloudpickle.register_pickle_by_value(sys.modules[__name__])
