"""Operator 3, SentencePiece encoding and decoding through a distinct-chunk table.

A BPE model whose pieces never hold a white-space marker after another character cannot join across the start of a
marker run. So a text is the sequence of its marked words (a run of markers and what follows it), each distinct marked
word is segmented once per table, and ids are joined back by position. The table is kept by each task and has a bounded
number of entries; nothing is shuffled, so a lost executor costs only its own partitions.

Defined results: a null or empty text has no ids and decodes to the empty text; repeated rows each keep theirs; other
columns pass through; columns named like the results are replaced; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ChunkTable, ship, slices, small_batches, to_bytes, worker_table
from .tokens import load_file

ship(__name__)

MARK = "▁"


def markers_lead(model: bytes) -> bool:
    """Whether every piece has its markers in front, so that chunks may be segmented alone."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    return not any(MARK in sp.id_to_piece(i).lstrip(MARK) for i in range(sp.vocab_size())) and sp.piece_to_id(MARK) != sp.unk_id()


def chunks_of(text: bytes) -> list[bytes]:
    """The marked words of a text, each without its first marker; the library puts one marker in front of every text."""
    import re

    if not text:
        return []
    text = text.replace(MARK.encode(), b" ")
    if b"  " not in text and text[:1] != b" " and text[-1:] != b" ":
        return text.split(b" ")
    return [c[1:] for c in re.findall(rb" +[^ ]*", b" " + text)]


def codec_table(model: bytes) -> ChunkTable:
    """Marked word -> (number of ids, ids in decimal joined by commas, the text that decode() gives for them)."""
    return worker_table(hashlib.sha256(model).hexdigest(), lambda: _new_table(model))


def _new_table(model: bytes) -> ChunkTable:
    import numpy as np
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    mark = sp.piece_to_id(MARK)
    leads = np.array([sp.id_to_piece(i).startswith(MARK) for i in range(sp.vocab_size())])
    digits = [b"%d" % i for i in range(sp.vocab_size())]

    def alone(c: bytes):
        ids = sp.encode(c.decode("utf-8", "replace")) if c else [mark]
        return len(ids), b",".join([digits[i] for i in ids]), sp.decode(ids).encode()

    def make(chunks: list[bytes]):
        """Many marked words in one call: each begins at an id whose piece has the marker. What decode() changes goes alone."""
        out: list = [None] * len(chunks)
        plain = [i for i, c in enumerate(chunks) if c and b" " not in c]
        for k in range(0, len(plain), 200):
            part = plain[k : k + 200]
            joined = b" ".join([chunks[i] for i in part]).decode("utf-8", "replace")
            ids = sp.encode(joined)
            at = np.flatnonzero(leads[ids]).tolist()
            if len(at) != len(part) or sp.decode(ids) != joined:
                continue
            text = [digits[i] for i in ids]
            for i, a, b in zip(part, at, [*at[1:], len(ids)], strict=True):
                out[i] = (b - a, b",".join(text[a:b]), chunks[i])
        return [alone(c) if x is None else x for x, c in zip(out, chunks, strict=True)]

    return ChunkTable(make, 400_000)


def _encoder(model: bytes, column: int, names: list[str], full: bool):
    def encode(batches):
        import pyarrow as pa

        table = codec_table(model)
        for batch in batches:
            texts, n, ids, back, lists = to_bytes(batch.column(column)), [], [], [], []
            for a, b in slices(texts):
                cut = [chunks_of(t) for t in texts[a:b]]
                table.ready([c for cs in cut for c in cs])
                for cs in cut:
                    rows = [table[c] for c in cs]
                    n.append(sum(r[0] for r in rows))
                    x, d = b",".join([r[1] for r in rows]), b" ".join([r[2] for r in rows])
                    ids.append(hashlib.sha256(x).hexdigest())
                    back.append(hashlib.sha256(d).hexdigest())
                    if full:
                        lists.append(([int(i) for i in x.split(b",")] if x else [], d.decode()))
            out = [batch.column(i) for i, c in enumerate(batch.schema.names) if i != column or full]
            out += [pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())]
            if full:
                out += [pa.array([x for x, _ in lists], pa.list_(pa.int32())), pa.array([d for _, d in lists], pa.string())]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return encode


def encode_decode(docs: DataFrame, model_path: str, text: str = "text", full: bool = False) -> DataFrame:
    """docs without its text, with n_tokens, ids_sha256 and decoded_sha256; with full also the text, ids and decoded."""
    small_batches(docs.sparkSession)
    model, _ = load_file(model_path)
    if not markers_lead(model):
        raise ValueError("pieces of this model hold markers after other characters; chunks cannot be segmented alone")
    made = ["n_tokens", "ids_sha256", "decoded_sha256"] + ["ids", "decoded"] * full
    docs = docs.select(*[c for c in docs.columns if c not in made or c == text])
    schema = T.StructType([f for f in docs.schema.fields if f.name != text or full])
    schema = schema.add("n_tokens", T.LongType()).add("ids_sha256", T.StringType()).add("decoded_sha256", T.StringType())
    if full:
        schema = schema.add("ids", T.ArrayType(T.IntegerType())).add("decoded", T.StringType())
    return docs.mapInArrow(_encoder(model, docs.columns.index(text), schema.names, full), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op3: every document's ids and decoded text, as digests."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.col("text"))
    return encode_decode(docs, public_tokenizers.path("piece_bpe_32k.model"))
