"""Operator 1, token counts by a digest cache.

Normalised content and the tokenizer version are joined, as digests, to stored counts; only distinct misses are encoded,
and their counts are appended to the cache. A cache is a Parquet folder (content, version, n_tokens) that may be kept
between runs and shared by many tables.

Defined results: a null or empty text has 0 tokens; repeated rows each keep their row; rows are matched by content alone,
so ties and null ids need no rule; other columns pass through untouched (the operator adds n_bytes and n_tokens, and a
column of that name in the input is replaced); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import scratch, ship, slices, small_batches, texts_of, to_bytes

ship(__name__)

CACHE = "content binary, version string, n_tokens long"


def normalised(text: Column, drops_spaces: bool) -> Column:
    """What decides the count: runs of ASCII white space as one space, none at the ends, where the tokenizer drops white space anyway."""
    return F.trim(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")) if drops_spaces else text


def _counter(raw: bytes):
    def count(batches):
        import pyarrow as pa

        table, cut = tokens.id_bytes_table(raw, "<u4")
        for batch in batches:
            texts, n = to_bytes(batch.column("norm")), []
            for a, b in slices(texts):
                words = [cut(t) for t in texts[a:b]]
                table.ready([w for ws in words for w in ws])
                n += [sum(map(len, map(table.__getitem__, ws))) // 4 for ws in words]
            yield pa.RecordBatch.from_arrays([batch.column("content"), batch.column("version"), pa.array(n, pa.int64())], names=["content", "version", "n_tokens"])

    return count


def read_cache(spark: SparkSession, cache: str) -> DataFrame:
    """The cache's rows, none where the folder does not exist yet."""
    path = spark._jvm.org.apache.hadoop.fs.Path(cache)
    there = path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)
    return spark.read.schema(CACHE).parquet(cache) if there else spark.createDataFrame([], CACHE)


def token_counts(docs: DataFrame, tokenizer: str, cache: str, text: str = "text") -> DataFrame:
    """docs with n_bytes (UTF-8) and n_tokens. tokenizer: path of a `tokenizers` file; cache: folder that every executor can reach.

    One pass hashes the texts; the texts themselves are shuffled once, and only those whose digest the cache lacks. The
    last join moves digests, not texts: a digest held by a third of all rows is split by adaptive skew handling, since
    the cache side is unique.
    """
    spark = docs.sparkSession
    small_batches(spark)
    raw, version = tokens.load_file(tokenizer)
    drops = tokens.splits_at_spaces(raw)
    keyed = docs.withColumns({"__norm": normalised(texts_of(docs, text), drops)})
    keyed = keyed.withColumn("__content", F.unhex(F.sha2("__norm", 256)))
    stored = read_cache(spark, cache).where(F.col("version") == version)
    misses = keyed.select(F.col("__content").alias("content"), F.lit(version).alias("version"), F.col("__norm").alias("norm"))
    misses = misses.join(stored.select("content"), "content", "left_anti").dropDuplicates(["content"])
    misses.mapInArrow(_counter(raw), CACHE).write.mode("append").parquet(cache)
    counts = read_cache(spark, cache).where(F.col("version") == version).groupBy("content").agg(F.max("n_tokens").alias("__n"))
    keyed = keyed.withColumn("n_bytes", F.octet_length(texts_of(docs, text)).cast("long")).drop("__norm")
    rest = [c for c in docs.columns if c not in ("n_bytes", "n_tokens", text)]
    keyed = keyed.select(*rest, "n_bytes", "__content")
    return keyed.join(counts.withColumnRenamed("content", "__content"), "__content", "left").select(*rest, "n_bytes", F.col("__n").alias("n_tokens"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op1: every document's token count; its cache starts empty, so that each run does the whole work."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = token_counts(docs, public_tokenizers.path("word_bpe_49k.json"), scratch(spark, "token-cache"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))
