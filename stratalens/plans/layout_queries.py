"""Queries over movies as tables of boxes: their layout, their chunks, the files laid out anew and what is refused."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import engine, layout
from ..sources.shared import grown, written
from . import carriers as C
from .queries import ORACLES, movies, query, refused_movies

#: Fixed values, by the format: the boxes of a movie with 32-bit offsets in order (path, offset, size, whether wider offsets make it longer); a tag box and the media follow.
_BOXES = [
    ("ftyp", 0, 20, 0), ("moov", 20, 499, 1), ("moov/mvhd", 28, 104, 0), ("moov/trak", 132, 387, 1), ("moov/trak/tkhd", 140, 88, 0), ("moov/trak/mdia", 228, 291, 1),
    ("moov/trak/mdia/mdhd", 236, 32, 0), ("moov/trak/mdia/hdlr", 268, 33, 0), ("moov/trak/mdia/minf", 301, 218, 1), ("moov/trak/mdia/minf/vmhd", 309, 20, 0),
    ("moov/trak/mdia/minf/dinf", 329, 36, 0), ("moov/trak/mdia/minf/stbl", 365, 154, 1), ("moov/trak/mdia/minf/stbl/stsd", 373, 102, 0),
    ("moov/trak/mdia/minf/stbl/stsz", 475, 20, 0), ("moov/trak/mdia/minf/stbl/", 495, 24, 1),
]
_MOVIES = "m AS (SELECT 'mp4_tags-' || o_orderkey AS file_id, CASE WHEN o_orderkey % 2 = 0 THEN 'stco' ELSE 'co64' END AS kind, CASE WHEN o_orderkey % 2 = 0 THEN 0 ELSE 8 END AS w, 24 + octet_length(encode(coalesce(o_orderpriority, ''))) AS u FROM orders)"


@query("movie_layout", f"""WITH {_MOVIES}, b(no, path, off, size, wide) AS (VALUES {", ".join(f"({i}, '{p}', {o}, {n}, {w})" for i, (p, o, n, w) in enumerate(_BOXES))}),
  r AS (SELECT file_id, no, CASE no WHEN 14 THEN path || kind ELSE path END AS path, off, size + wide * w + CASE no WHEN 1 THEN u ELSE 0 END AS size, true AS kept, off AS new_off, size + wide * w AS new_size FROM m, b
    UNION ALL SELECT file_id, 15, 'moov/udta', 519 + w, u, false, 519 + w, 0 FROM m UNION ALL SELECT file_id, 16, 'mdat', 519 + w + u, 28, true, 519 + w, 28 FROM m)
  SELECT file_id, no, path, off::BIGINT AS off, size::BIGINT AS size, kept, new_off::BIGINT AS new_off, new_size::BIGINT AS new_size FROM r""")  # fmt: skip
def movie_layout(spark, sf_dir):
    """Where each box lies, and where it comes to lie without the tags."""
    return layout.layout(layout.scanned(movies(spark, sf_dir))).select("file_id", "no", "path", "off", "size", "kept", "new_off", "new_size")


@query("movie_chunks", f"""WITH {_MOVIES} SELECT file_id, c AS chunk, (527 + w + u + 8 * c)::BIGINT AS "offset", (527 + w + 8 * c)::BIGINT AS relocated, 'moved' AS status, (527 + w + 8 * c)::BIGINT AS read_back FROM m, (VALUES (0), (1)) t(c)""")
def movie_chunks(spark, sf_dir):
    """Each chunk's offset moved with its media, beside what is read back from the stripped file."""
    files = movies(spark, sf_dir, times="00000001")
    boxes = written(layout.scanned(files), "boxes")
    again = written(layout.chunks(layout.scanned(engine.stripped(engine.decided(files)))), "chunks")
    after = again.select("file_id", "chunk", F.col("offset").alias("read_back"))
    return layout.moved(boxes, written(layout.layout(boxes), "layout")).select("file_id", "chunk", "offset", "relocated", "status").join(grown(after), ["file_id", "chunk"])


@query("movie_relaid", f"""WITH {_MOVIES} SELECT file_id, (547 + w)::BIGINT AS output_bytes, true AS bare, true AS alike FROM m""")
def movie_relaid(spark, sf_dir):
    """Files laid out anew: bare if they are the movies without tags and times, alike if they are what the walk of one file gives."""
    rows = engine.with_output(engine.decided(engine.gathered(movies(spark, sf_dir, times="00000001").select("file_id", "content")))).where("error IS NULL")
    rows = layout.relaid(rows.select("files", "content", F.md5("output").alias("walked")))[0]
    rows = engine.spread(rows.select("files", F.octet_length("content").cast("bigint").alias("output_bytes"), F.md5("content").alias("md5"), "walked"))
    plain = F.when(F.regexp_extract("file_id", "([0-9]+)$", 1).cast("long") % 2 == 0, F.md5(C.mp4_file().column())).otherwise(F.md5(C.mp4_file(wide=True).column()))
    return rows.select("file_id", "output_bytes", (F.col("md5") == plain).alias("bare"), (F.col("md5") == F.col("walked")).alias("alike"))


@query("movie_relaid_refusals", ORACLES["mp4_refusals"])
def movie_relaid_refusals(spark, sf_dir):
    """The same refusals from rows of boxes."""
    bad = layout.relaid(refused_movies(spark, sf_dir))[1]
    name = F.split("file_id", "/")
    return bad.select(name[0].cast("bigint").alias("c_custkey"), name[1].alias("defect"), "error_kind", "detail", "unsupported_kind")
