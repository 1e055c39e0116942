"""The corpus pipeline: toxicity, near duplicates, secrets, mixing and encoding, each stage on all that the one before kept.

Every stage takes the columns of documents and leaves others out; an empty table gives an empty one; texts of any length are whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stratalens.llm import jaccard, mixing, secrets, sentencepiece_codec, toxicity
from stratalens.llm.common import materialize

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar predicts to be toxic go. Null and empty texts are scored as texts without a match; a null id is scored and learned from by nobody."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.learn(docs.select("doc_id", "text"), labels)
    return toxicity.score(docs.select(*COLUMNS), model).where("predicted = 0").select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles and a similarity of 0.8 or more the one of least id stays.

    Null and empty texts and null ids are linked with nothing and stay; rows that share an id are one document, all of whose rows stay or go.
    """
    found = jaccard.join(docs.select("doc_id", "text"), 5, 80)
    copies = found.where(F.col("component_id") != F.col("doc_id").cast("long")).select("doc_id").distinct()
    return docs.select(*COLUMNS).join(materialize(copies, "near-copies").hint("merge"), "doc_id", "left_anti").select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each secret is replaced by its kind in brackets; every document stays. n_chars is counted anew, null for a null text."""
    clean = secrets.redact(docs.select(*COLUMNS))
    return clean.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, to whole documents: twice, once or not at all.

    Rows that are equal in id, source and text share alike. Null and empty texts have no words, so the mix takes none of them; a null
    source is a source of its own.
    """
    keyed = docs.select(*COLUMNS, F.xxhash64(F.coalesce("text", F.lit(""))).alias("__h"))
    taken = mixing.mix(keyed.select("doc_id", "text", "source", "__h"))
    copies = F.floor(F.sum("taken") / F.sum("size") + 0.5).cast("int")
    copies = taken.where("size > 0").groupBy("doc_id", "source", "__h").agg(copies.alias("copies")).where("copies > 0")
    copies = materialize(copies, "mix-copies").hint("merge").alias("c")
    k = keyed.alias("k")
    same = F.col("k.doc_id").eqNullSafe(F.col("c.doc_id")) & F.col("k.source").eqNullSafe(F.col("c.source")) & (F.col("k.__h") == F.col("c.__h"))
    rows = k.join(copies, same).select(*[f"k.{c}" for c in COLUMNS], "c.copies")
    return rows.select(*COLUMNS, F.explode(F.sequence(F.lit(1), "copies")).alias("copy")).select(*COLUMNS)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids and the decoded text of each row, as digests. A null text is encoded as an empty one."""
    import public_tokenizers

    out = sentencepiece_codec.encode_decode(docs.select("doc_id", "source", "text"), public_tokenizers.path("piece_bpe_32k.model"))
    return out.select("doc_id", "source", "n_tokens", "ids_sha256", "decoded_sha256")


STAGES = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", redact_secrets),
    ("mixing sources to target weights", mix_sources),
    ("SentencePiece encoding and decoding", encode),
]

#: SQL cannot express the learned grammar or the encoding; tests hold the stages against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each one's rows are written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{i}")
    return docs
