"""Quantiles from counts that can be merged: each value falls into a bucket of its highest bits.

A bucket is named by its lowest value, so a sketch is a table of (bucket, n) with the least value beside it; sketches of batches are merged by
adding counts, in any order. With `bits` bits a quantile is the lowest value of the bucket that holds it, which is below the true
one by less than a 2^(1 - bits) part of it, and values below 2^bits are exact. Buckets are few: 2^(bits - 1) for each doubling.
Values are whole numbers of 0 or more, in any unit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BITS = 8


def error(bits: int = BITS) -> float:
    """The relative error of a quantile stays below this."""
    return 2.0 ** (1 - bits)


def bucket(value: Column, bits: int = BITS) -> Column:
    """The value with all but its highest bits as zeros."""
    low = F.greatest(F.length(F.bin(value)) - bits, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, low), low)


def sketched(rows: DataFrame, by: list[str], value: str, bits: int = BITS) -> DataFrame:
    """(by, bucket, n, least): what to keep of a batch. Null and negative values are left out."""
    kept = rows.where(F.col(value) >= 0).withColumn("bucket", bucket(F.col(value).cast("long"), bits))
    return kept.groupBy(*by, "bucket").agg(F.count("*").alias("n"), F.min(value).cast("long").alias("least"))


def merged(sketches: DataFrame, by: list[str]) -> DataFrame:
    """One sketch for each `by` from those of many batches."""
    return sketches.groupBy(*by, "bucket").agg(F.sum("n").alias("n"), F.min("least").alias("least"))


def quantiles(sketches: DataFrame, by: list[str], shares: dict[str, int]) -> DataFrame:
    """(by, n, least, one column for each share in thousandths): the value of rank ceil(share * n / 1000), at least the first."""
    w = Window.partitionBy(*by).orderBy("bucket")
    rows = sketches.withColumns({"upto": F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("n").over(Window.partitionBy(*by))})
    wanted = {name: F.min(F.when(F.col("upto") * 1000 >= F.greatest(F.col("total") * share, F.lit(1000)), F.col("bucket"))).alias(name) for name, share in shares.items()}
    return rows.groupBy(*by).agg(F.max("total").alias("n"), F.min("least").alias("least"), *wanted.values())
