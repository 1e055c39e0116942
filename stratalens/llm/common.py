"""What several training-data operators share: the shared scratch folder, worker shipping and per-task chunk tables."""

from __future__ import annotations

import atexit
import re
import sys
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Words are the maximal runs of anything but space and the five ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def ship(module: str) -> None:
    """Functions of this module are sent to Python workers whole, so that executors need no copy of the package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. A local session (tests) may leave it unset."""
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        root = getattr(sc, "_stratalens_root", None)
        if root is None:
            root = sc._stratalens_root = f"file://{tempfile.mkdtemp(prefix='stratalens-')}"
    return root.rstrip("/")


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(conf).delete(p, True)
    except Exception:  # the session may be gone at exit
        pass


def scratch(spark: SparkSession, name: str, keep: bool = False) -> str:
    """A new folder name below the shared folder; it goes when the driver's Python ends, unless it is kept."""
    path = f"{shared_root(spark)}/stratalens-{name}-{uuid.uuid4().hex}"
    if not keep:
        atexit.register(_remove, spark, path)
    return path


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes df below the shared folder and reads it again: lineage ends here, and lost executors cost no rerun of what came before."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._stratalens_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Removes what materialize() wrote for these tables, once nothing that is still to run reads them."""
    for df in tables:
        if path := df.__dict__.pop("_stratalens_path", None):
            _remove(df.sparkSession, path)


def prefix_sums(df: DataFrame, order: list, sums: dict[str, str], name: str) -> DataFrame:
    """df with, for each new column: summed column of `sums`, the sum over all rows before this one in the global order.

    Rows are range-partitioned by the order and written with the number of their range. The ranges' sums are few rows, whose
    running sums are the ranges' bases; inside each range a window adds its own. So no task holds more than a range.
    """
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    ranged = materialize(ranged.withColumn("__range", F.spark_partition_id()), name)
    per = ranged.groupBy("__range").agg(*[F.sum(c).alias(f"__s_{new}") for new, c in sums.items()])
    earlier = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    bases = per.select("__range", *[F.coalesce(F.sum(f"__s_{new}").over(earlier), F.lit(0)).alias(f"__b_{new}") for new in sums])
    inside = Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    rows = ranged.withColumns({f"__i_{new}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for new, c in sums.items()})
    return rows.join(bases, "__range").select(*df.columns, *[(F.col(f"__b_{new}") + F.col(f"__i_{new}")).alias(new) for new in sums])


def small_batches(spark: SparkSession, size: str = "4m") -> None:
    """Keeps this session's Arrow batches to some bytes: rows alone bound nothing where texts are long."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def texts_of(docs: DataFrame, text: str = "text"):
    """The text column, null as empty."""
    return F.coalesce(F.col(text), F.lit(""))


def to_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8, null as empty; invalid surrogates cannot occur in Arrow strings."""
    import pyarrow as pa

    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


class ChunkTable(dict):
    """Distinct chunk -> what was made of it. Misses are computed together, once each; past `most` entries it starts anew, so memory is bounded."""

    def __init__(self, make, most: int = 300_000):
        super().__init__()
        self.make, self.most = make, most

    def ready(self, chunks: list) -> None:
        new = set(chunks).difference(self)
        if len(self) + len(new) > self.most:
            self.clear()
            new = set(chunks)
        if new:
            new = list(new)
            for i in range(0, len(new), 50_000):
                part = new[i : i + 50_000]
                self.update(zip(part, self.make(part), strict=True))


def worker_table(key, new) -> ChunkTable:
    """The table of this key that this Python worker already has, else a new one: workers serve many tasks."""
    held = sys.__dict__.setdefault("_stratalens_tables", {})
    if key not in held:
        held.clear()
        held[key] = new()
    return held[key]


def slices(texts: list[bytes], size: int = 2_000_000):
    """(start, end) of runs of texts of about `size` bytes, so that what is made of them at once stays small."""
    start = total = 0
    for i, x in enumerate(texts):
        if total and total + len(x) > size:
            yield start, i
            start, total = i, 0
        total += len(x)
    if start < len(texts):
        yield start, len(texts)


ship(__name__)
