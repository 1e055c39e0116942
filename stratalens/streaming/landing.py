"""Incremental reports over a landing directory of binary rows: each micro-batch is inspected like a batch.

A Structured Streaming use of the same plan, beyond what a batch of files needs. The stream's rows have file_id, path and
content; packages are opened like a batch's. Each micro-batch is walked once, and its reports are written below a folder of its own number, which a repeated
micro-batch replaces: so a failure between the write and the checkpoint leaves no row twice. An id that comes again in a
later micro-batch is reported again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .. import dims
from ..functions.detect import detected
from ..functions.packages import with_packages
from ..operators import engine, packages
from ..sources.shared import released, written


def inspect_stream(files: DataFrame, findings_path: str, errors_path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Starts the query; findings and errors are Parquet folders with a partition column batch."""

    def each(batch: DataFrame, number: int) -> None:
        seen = detected(with_packages(batch.select("file_id", "path", "content"))).drop("__package")
        rows = engine.looked(seen)
        package = F.col("format").isin(*dims.PACKAGES) & F.col("error").isNull()
        rows = written(rows.withColumn("content", F.when(package, F.col("content"))), "landing")
        inner = packages.Package(rows.where("content IS NOT NULL").select("file_id", "path", "format", "content"))
        engine.findings(rows).unionByName(inner.findings()).write.mode("overwrite").parquet(f"{findings_path}/batch={number}")
        engine.errors(rows).unionByName(inner.errors()).write.mode("overwrite").parquet(f"{errors_path}/batch={number}")
        inner.release()
        released(rows)

    out = files.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (out.trigger(availableNow=True) if available_now else out).start()
