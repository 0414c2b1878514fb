"""Structured Streaming: incremental merges and windowed counts."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statloom.operators.relational import keep_last
from statloom.session import checkpoint_folder


def stream_latest(spark: SparkSession, path: str, key: list[str], order: str) -> DataFrame:
    """(key, n, last_event) kept up to date by a stream over a Parquet source, read to its present end.

    The stream aggregates in its state store; each micro-batch is written to the
    shared checkpoint folder as a new version, so a repeated batch changes nothing.
    """
    base = f"{checkpoint_folder(spark)}/stream-{uuid.uuid4().hex}"
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    source = spark.readStream.schema(schema)
    rows = source.option("pathGlobFilter", name).parquet(folder) if _is_file(spark, path) else source.parquet(path)
    state = rows.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.max(order).alias("last_event"))

    def version(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{base}/out/batch={number}")

    q = state.writeStream.outputMode("update").foreachBatch(version).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return keep_last(spark.read.parquet(f"{base}/out"), key, ["batch"]).drop("batch")


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


def windowed_counts(events: DataFrame, at: str, kind: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window start, kind, n) of a stream or a table; a stream forgets windows ``late`` behind the newest event."""
    x = events.withWatermark(at, late) if events.isStreaming else events
    return x.groupBy(F.window(at, width).alias("w"), kind).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), kind, "n")
