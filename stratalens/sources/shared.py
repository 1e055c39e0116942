"""Tables that a plan writes once and reads several times, in the folder that driver and executors share."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def root(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a local session (tests) may leave it unset."""
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        path = sc.__dict__.setdefault("_stratalens_shared", f"file://{tempfile.mkdtemp(prefix='stratalens-')}")
    return path.rstrip("/")


def remove(spark: SparkSession, path: str) -> None:
    try:
        p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session may be gone at exit
        pass


def written(df: DataFrame, name: str) -> DataFrame:
    """df, written below the shared folder and read again; released() or the end of the driver removes it."""
    spark = df.sparkSession
    path = f"{root(spark)}/stratalens-{name}-{uuid.uuid4().hex}"
    atexit.register(remove, spark, path)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stratalens_path = path
    return out


def grown(df: DataFrame) -> DataFrame:
    """df, as a side of a join that is merged rather than broadcast: it grows with the input.

    What files take on disk says little of their rows (equal bytes are stored once), so that the planner would send tables of any
    size through the driver.
    """
    return df.hint("merge")


#: Rows and bytes that a task sorts at a time.
PIECE_ROWS, PIECE_BYTES = 250_000, 128 << 20


def pieces(spark: SparkSession, rows: int, size: int = 0) -> int:
    """The pieces that a table of so many rows and bytes is dealt into before it is sorted.

    A shuffle by a given number is left as it is. Others are put together at run time until there is one for each core, whatever a task then holds.
    """
    least = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return max(least, -(-rows // PIECE_ROWS), -(-size // PIECE_BYTES))


def released(*tables: DataFrame) -> None:
    """Removes what written() wrote for these tables, once nothing that is still to run reads them."""
    for df in tables:
        if path := df.__dict__.pop("_stratalens_path", None):
            remove(df.sparkSession, path)


def running(df: DataFrame, order: list, sums: dict[str, str], name: str) -> DataFrame:
    """df with, for each new column: summed column of `sums`, the sum over all rows before this one in the global order.

    Rows are range-partitioned by the order and written with the number of their range. The ranges' sums are few rows, whose
    running sums are the ranges' bases; inside each range a window adds its own. So no task holds more than a range.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = written(ranged.withColumn("__range", F.spark_partition_id()), name)
    per = ranged.groupBy("__range").agg(*[F.sum(c).alias(f"__s_{new}") for new, c in sums.items()])
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    bases = per.select("__range", *[F.coalesce(F.sum(f"__s_{new}").over(earlier), F.lit(0)).alias(f"__b_{new}") for new in sums])
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.withColumns({f"__i_{new}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for new, c in sums.items()})
    return rows.join(bases, "__range").select(*df.columns, *[(F.col(f"__b_{new}") + F.col(f"__i_{new}")).alias(new) for new in sums])
