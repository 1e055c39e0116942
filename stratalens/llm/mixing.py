"""Operator 2, mixing sources to target weights by weighted fair queueing. DataFrame functions only.

Each source's documents queue in a shuffled order (MD5 of seed and id), `most` times over: a document may be taken that often.
A copy's virtual finish time is its source's cumulative words up to and with it, divided by the source's weight. All copies are
range-sorted by finish time, and the sorted queue is cut where its running words reach the total budget: copies before the
cut are taken whole, the copy that the cut falls into up to the word, the others not at all. So each source is served in
proportion to its weight until it has no copies left, and what it takes is its target to within two documents.

Cumulative words of a source are prefix sums over fixed hash buckets of its order, then within a bucket, so that a source
with a third of all rows is spread over its buckets. The running words of the whole queue, and the ranks and running sums of
the sources themselves, are prefix sums over range partitions (common.prefix_sums), so nothing passes through one task.

Defined results: a null source is a source of its own, after all others; a null or blank text has size 0 and takes 0;
rows that repeat an id stand next to each other in the queue, in order of size, then of the text's MD5; null ids queue by the
text's MD5; rows that are equal in all of these take as they come, which makes no difference between them in sum; other columns
pass through (columns named like the results are replaced); an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, materialize, prefix_sums, texts_of

#: Weights of the sources in code-point order, repeating.
WEIGHTS = (5, 2, 1)


def n_words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def source_targets(sized: DataFrame, weights=WEIGHTS, share: float = 1.5, most: int = 2) -> DataFrame:
    """source, source_size, weight, target: the budget shared by weight, no source above `most` times its size.

    In order of size per weight the sources that stop at their cap come first, so one running sum finds the level of the rest.
    """
    per = materialize(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.lit(1).cast("long").alias("one")), "mix-sources")
    per = prefix_sums(per, [F.col("source").asc_nulls_last()], {"rank": "one"}, "mix-ranks")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    per = per.withColumn("weight", weight).withColumn("cap", most * F.col("source_size"))
    per = per.withColumn("until", F.col("cap") / F.col("weight"))  # the virtual time at which it stops
    per = materialize(prefix_sums(per, ["until", F.col("source").asc_nulls_last()], {"capped": "cap", "gone": "weight"}, "mix-levels"), "mix-levels")
    whole = per.agg(F.sum("source_size").alias("words"), F.sum("weight").alias("weight")).first()
    level = (share * F.lit(whole["words"] or 0) - F.col("capped")) / (F.lit(whole["weight"] or 0.0) - F.col("gone"))
    per = per.withColumn("level", level)
    found = per.where(F.col("level") * F.col("weight") < F.col("cap")).agg(F.min(F.struct("until", "level"))["level"].alias("level")).first()["level"]
    cap = F.col("cap").cast("double")
    target = cap if found is None else F.least(cap, F.lit(found) * F.col("weight"))
    return per.select("source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = 1.5, most: int = 2, seed: str = "mix", text: str = "text") -> DataFrame:
    """docs with size, source_size, target, taken and virtual_finish (of the first copy), in no given order."""
    made = ("size", "source_size", "target", "taken", "virtual_finish")
    docs = docs.select(*[c for c in docs.columns if c not in made])
    digest = F.md5(texts_of(docs, text))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), digest)))
    queue = docs.withColumns({"size": n_words(texts_of(docs, text)), "__order": order, "__text": digest, "__row": F.monotonically_increasing_id()})
    queue = queue.withColumn("__bucket", F.substring("__order", 1, 3))
    queue = materialize(queue.select(*[c for c in queue.columns if c != text]), "mix-queue")  # the texts are read once; rows have their numbers for good

    # Running words of a source: buckets of its order first, then inside each bucket.
    buckets = queue.groupBy("source", "__bucket").agg(F.sum("size").alias("__words"))
    earlier = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = buckets.select("source", "__bucket", F.coalesce(F.sum("__words").over(earlier), F.lit(0)).alias("__base"))
    inside = Window.partitionBy("source", "__bucket").orderBy("__order", "size", "__text", "__row").rowsBetween(Window.unboundedPreceding, 0)
    cumulative = queue.select("source", "__bucket", "__order", "size", "__text", "__row", F.sum("size").over(inside).alias("__in"))

    targets = materialize(source_targets(queue, weights, share, most), "mix-targets")
    words = targets.agg(F.sum("source_size")).first()[0] or 0
    b, t = bases.alias("b"), targets.alias("t")
    same = F.col("q.source").eqNullSafe(F.col("b.source")) & (F.col("q.__bucket") == F.col("b.__bucket"))
    cumulative = cumulative.alias("q").join(b, same).select("q.source", "q.size", "q.__row", (F.col("b.__base") + F.col("q.__in")).alias("__cum"))
    copies = cumulative.alias("q").join(t, F.col("q.source").eqNullSafe(F.col("t.source")))
    copies = copies.select("q.source", "q.size", "q.__row", "q.__cum", "t.source_size", "t.weight", F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("__copy")).where("size > 0")
    finish = (F.col("__cum") + F.col("__copy") * F.col("source_size")) / F.col("weight")

    # The sorted queue, cut where its running words reach the budget.
    ordered = ["finish", F.col("source").asc_nulls_last(), "__copy", "__cum"]
    queued = prefix_sums(copies.select("source", "size", "__row", "__cum", "__copy", finish.alias("finish")), ordered, {"before": "size"}, "mix-order")
    taken = F.greatest(F.lit(0), F.least(F.col("size"), F.floor(F.lit(share) * words).cast("long") - F.col("before")))
    served = queued.groupBy("__row").agg(F.sum(taken).cast("long").alias("taken"), F.min("finish").alias("virtual_finish"))

    rest = [c for c in docs.columns if c != text]
    rows = queue.join(served, "__row", "left").alias("q").join(t, F.col("q.source").eqNullSafe(F.col("t.source")))
    return rows.select(*[f"q.{c}" for c in rest], "q.size", "t.source_size", "t.target", F.coalesce("q.taken", F.lit(0).cast("long")).alias("taken"), "q.virtual_finish")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op2: the words that the mix takes of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH q AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
         md5('mix:' || coalesce(doc_id::VARCHAR, md5(coalesce(text, '')))) AS k, md5(coalesce(text, '')) AS h, row_number() OVER () AS rid FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         list_extract([5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE], ((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT) AS weight
  FROM q GROUP BY source),
c AS (
  SELECT *, 2 * source_size AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS budget,
         coalesce(sum(2 * source_size) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS capped,
         sum(weight) OVER (ORDER BY 2 * source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS w_left
  FROM s),
v AS (
  SELECT min_by((budget - capped) / w_left, cap / weight) FILTER (WHERE (budget - capped) / w_left * weight < cap) AS level FROM c),
t AS (SELECT source, source_size, weight, coalesce(least(cap::DOUBLE, level * weight), cap::DOUBLE) AS target FROM c, v),
r AS (
  SELECT q.*, t.source_size, t.target, t.weight, sum(size) OVER (PARTITION BY q.source ORDER BY k, size, h, rid ROWS UNBOUNDED PRECEDING) AS cum
  FROM q JOIN t ON q.source IS NOT DISTINCT FROM t.source),
f AS (SELECT r.*, copy, (cum + copy * source_size)::DOUBLE / weight AS finish FROM r, (VALUES (0), (1)) c(copy) WHERE size > 0),
o AS (
  SELECT rid, size, coalesce(sum(size) OVER (ORDER BY finish, source NULLS LAST, copy, cum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
         floor(1.5::DOUBLE * sum(size) OVER () / 2)::BIGINT AS budget FROM f),
g AS (SELECT rid, sum(greatest(0, least(size, budget - before)))::BIGINT AS taken FROM o GROUP BY rid)
SELECT doc_id, size, source_size, target, coalesce(taken, 0)::BIGINT AS taken FROM r LEFT JOIN g USING (rid)
"""
