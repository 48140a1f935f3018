"""PL17 as a stream: finished pairs arrive as files, each (a, b) is kept once, pairs of deleted books are dropped.

Exactly once by construction: a batch is merged into a new version of the result, named after the batch, from the
version before it; a batch that runs again writes the same version again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from quire.operators.compare import appended


def follow_pairs(spark: SparkSession, source: str, schema: T.StructType, deleted: DataFrame, target: str, checkpoint: str):
    """Start a query over the files of ``source`` that are there now; returns it. Results: ``<target>/batch=<n>``."""

    def merge(batch: DataFrame, n: int) -> None:
        old = spark.read.parquet(f"{target}/batch={n - 1}") if n else batch.limit(0)
        appended(old, batch, deleted).write.mode("overwrite").parquet(f"{target}/batch={n}")

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
