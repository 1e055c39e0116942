"""Operator 9, quality rules with risk-controlled thresholds.

Each rule rejects a text whose statistic (in thousandths) is above a cutoff of a fixed grid. Cutoffs are chosen per stratum on
labelled holdouts, in two halves of the stratum's distinct good texts that pass the base rules (dealt by digest). The first half lays down a path: for
each of a few rates, the rules' lowest cutoffs that no more than that share of its texts exceeds, at first with some steps of the grid to spare. So along the path the
cutoffs fall, and what all rules together reject only grows. The second half tests the path in order, the most lenient step
first, by an exact binomial test that all rules together wrongly reject at most alpha of the stratum's good documents; the
first step that fails ends it (a fixed sequence, so its steps need no correction). The level delta is divided by the number of
strata. So with probability 1 - delta, in every stratum at once, at most alpha of the good documents that pass the base rules
are rejected. A stratum whose second half is too small for the first step gets no cutoff (at alpha 0.05, delta 0.05 and four
strata: fewer than 86 texts, or about 172 labelled good ones), and nothing is rejected there beyond the base rules.

Only counts per (stratum, rule, grid step) leave the tasks; they cover all labelled rows.

Defined results: a null, empty or blank text has no words and fails the base rules; a null stratum is a stratum of its
own; repeated rows are each judged; an id whose labels contradict each other is not good; texts that are equal within a
stratum are one trial; rows whose id is null or has no label calibrate nothing; other columns pass through (columns named
like the results are replaced); an empty table gives an empty result, and without labels only the base rules apply.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import materialize, ship, small_batches, texts_of, to_bytes

ship(__name__)

#: Rule -> its statistic, in thousandths.
RULES = {
    "symbols": lambda: F.col("n_symbols") * 1000 / F.greatest(F.col("n_words"), F.lit(1)),
    "dup_lines": lambda: F.col("n_dup_lines") * 1000 / F.greatest(F.col("n_lines"), F.lit(1)),
    "repeats": lambda: F.col("n_repeat_words") * 1000 / F.greatest(F.col("n_words"), F.lit(1)),
    "capitals": lambda: F.col("n_upper") * 1000 / F.greatest(F.col("word_chars"), F.lit(1)),
    "shouts": lambda: F.col("n_shouts") * 1000 / F.greatest(F.col("n_words"), F.lit(1)),
}
#: Cutoffs, in thousandths, the lowest first.
GRID = (10, 20, 30, 50, 70, 100, 140, 200, 280, 400, 560, 800)
#: Steps of a stratum's path: the share of good texts, in thousandths, that one rule's cutoff may reject in the first half, and steps of the grid beyond it.
STEPS = ((0, 2), (0, 1), (0, 0), (2, 0))
#: What fails whatever the cutoffs are.
BASE = lambda: (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_shouts")


def repeat_words(words: list[bytes]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:], strict=False))
    if len(set(windows)) == len(windows):
        return 0
    seen: dict = {}
    for w in windows:
        seen[w] = seen.get(w, 0) + 1
    covered, n = 0, 0
    for i, w in enumerate(windows):
        if seen[w] > 1:
            n += i + 3 - max(covered, i)
            covered = i + 3
    return n


def _measure(column: int, names: list[str]):
    def measure(batches):
        import pyarrow as pa

        spaces = b"\x20\x09\x0a\x0b\x0c\x0d"
        not_letters = spaces + bytes(range(0x80, 0xC0))
        upper = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
        for batch in batches:
            rows = []
            for t in to_bytes(batch.column(column)):
                words = t.split()
                lines = [x for x in t.split(b"\n") if x.strip()]
                n = len(t)
                rows.append((len(words), len(t.translate(None, not_letters)), n - len(t.translate(None, b"#*$%&|<>")), len(lines) - len(set(lines)), repeat_words(words), len(lines), n - len(t.translate(None, upper)), t.count(b"!")))
            columns = zip(*rows, strict=True) if rows else [[]] * len(FEATURES)
            kept = [c for i, c in enumerate(batch.columns) if i != column]
            yield pa.RecordBatch.from_arrays(kept + [pa.array(c, pa.int64()) for c in columns], names=names)

    return measure


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs without the text, with FEATURES."""
    small_batches(docs.sparkSession)
    docs = docs.select(*[c for c in docs.columns if c not in FEATURES or c == text])
    schema = T.StructType([f for f in docs.schema.fields if f.name != text] + [T.StructField(f, T.LongType()) for f in FEATURES])
    return docs.mapInArrow(_measure(docs.columns.index(text), schema.names), schema)


def at_most(k: int, n: int, p: float, level: float) -> bool:
    """Whether k of n shows, by the exact binomial test at this level, that the rate is below p: P(Binomial(n, p) <= k) <= level."""
    import math

    if n <= 0 or k >= n * p:
        return False
    base, odds = n * math.log1p(-p), math.log(p) - math.log1p(-p)
    total, log_c = 0.0, 0.0
    for i in range(k + 1):
        if i:
            log_c += math.log((n - i + 1) / i)
        total += math.exp(base + log_c + i * odds)
        if total > level:
            return False
    return True


def _tested(alpha: float, delta: float):
    """Rows (stratum, step, rejected, good, strata) -> with whether the step passes its test."""

    def tested(batches):
        import pyarrow as pa

        for b in batches:
            passed = [at_most(r["rejected"], r["good"], alpha, delta / max(1, r["strata"])) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("stratum"), b.column("step"), pa.array(passed, pa.bool_())], names=["stratum", "step", "passed"])

    return tested


def _above(rule: str):
    """Whether a text exceeds its stratum's cutoff for a rule; without a cutoff it does not."""
    return F.coalesce(RULES[rule]() > F.col(f"__{rule}"), F.lit(False))


def paths(first: DataFrame) -> DataFrame:
    """(stratum, step, __<rule> for each rule): the cutoffs of each step, null where no cutoff of the grid is lenient enough."""
    above = [F.sum((stat() > c).cast("long")).alias(f"{name}|{c}") for name, stat in RULES.items() for c in GRID]
    counted = first.groupBy("stratum").agg(F.count("*").alias("good"), *above)
    steps = counted.withColumn("s", F.explode(F.array(*[F.struct(F.lit(i).alias("step"), F.lit(r).alias("rate"), F.lit(x).alias("spare")) for i, (r, x) in enumerate(STEPS)])))
    grid = F.array(*[F.lit(c) for c in GRID])
    lowest = [F.get(grid, F.col("s.spare") + F.coalesce(*[F.when(1000 * F.col(f"{name}|{c}") <= F.col("s.rate") * F.col("good"), F.lit(i)) for i, c in enumerate(GRID)], F.lit(len(GRID)))).alias(f"__{name}") for name in RULES]
    return steps.select("stratum", "s.step", *lowest)


def cutoffs(measured: DataFrame, labels: DataFrame, alpha: float, delta: float) -> DataFrame:
    """(stratum, __<rule> for each rule) of the strata that have cutoffs. measured: doc_id, stratum, digest and FEATURES; labels: doc_id, quality."""
    good = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("q"), F.count_if(F.col("quality").isNull()).alias("unknown")).where("q = 1 AND unknown = 0")
    held = measured.where(~BASE()).join(good.select("doc_id"), "doc_id").groupBy("stratum", "digest").agg(*[F.first(f).alias(f) for f in FEATURES])
    held = materialize(held, "quality-held")
    second = F.substring("digest", 1, 1).isin(*"89abcdef")
    path = materialize(paths(held.where(~second)), "quality-paths").withColumnRenamed("stratum", "__s")
    tests = held.where(second).join(path, held["stratum"].eqNullSafe(path["__s"]))
    rejected = F.lit(False)
    for rule in RULES:
        rejected = rejected | _above(rule)
    counts = materialize(tests.groupBy("stratum", "step").agg(F.count_if(rejected).alias("rejected"), F.count("*").alias("good")), "quality-counts")
    counts = counts.withColumn("strata", F.lit(counts.where("step = 0").count()).cast("long"))
    tested = counts.mapInArrow(_tested(alpha, delta), "stratum string, step int, passed boolean")
    so_far = F.bool_and("passed").over(Window.partitionBy("stratum").orderBy("step").rowsBetween(Window.unboundedPreceding, 0))
    last = tested.withColumn("passed", so_far).where("passed").groupBy("stratum").agg(F.max("step").alias("__last"))
    chosen = path.join(last, path["__s"].eqNullSafe(last["stratum"]) & (path["step"] == last["__last"]))
    return chosen.select("stratum", *[f"__{r}" for r in RULES])


def judge(docs: DataFrame, labels: DataFrame, stratum: str = "lang", alpha: float = 0.05, delta: float = 0.05, text: str = "text") -> DataFrame:
    """docs without the text, with FEATURES, base_failed, failed (the rules that reject it) and kept."""
    docs = docs.select(*[c for c in docs.columns if c not in ("base_failed", "failed", "kept")])
    keyed = docs.withColumns({"__stratum": F.col(stratum).cast("string"), "__digest": F.md5(texts_of(docs, text))})
    measured = materialize(features(keyed, text), "quality-features")
    found = cutoffs(measured.select("doc_id", F.col("__stratum").alias("stratum"), F.col("__digest").alias("digest"), *FEATURES), labels, alpha, delta)
    per = materialize(found, "quality-cutoffs").withColumnRenamed("stratum", "__s")
    rows = measured.join(per, measured["__stratum"].eqNullSafe(per["__s"]), "left")
    failed = F.array_compact(F.array(*[F.when(_above(r), F.lit(r)) for r in RULES]))
    rows = rows.withColumns({"base_failed": BASE(), "failed": failed})
    kept = ~F.col("base_failed") & (F.size("failed") == 0)
    return rows.withColumn("kept", kept).select(*[c for c in measured.columns if c not in ("__stratum", "__digest")], "base_failed", "failed", "kept")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: every document's features and verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "quality")
    return judge(docs, labels).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
