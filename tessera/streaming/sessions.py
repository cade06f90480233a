"""Streaming forms: gap sessions over event time, and resumable chunk processing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tessera.sources import runs


def session_counts(events: DataFrame, ts: str, key: str, gap: str = "1 day", late: str = "2 days") -> DataFrame:
    """Rows per key and gap session; works on batches and streams (late rows beyond the watermark are dropped on streams)."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def resume(source: DataFrame, process: Callable[[DataFrame], DataFrame], keys: list[str], target: str, checkpoint: str) -> StreamingQuery:
    """Process new rows of a stream once: rows whose keys ``target`` has are skipped, results are appended.

    ``target`` is a run table (``runs``): a batch reads only the buckets of its keys. A restart goes on from
    ``checkpoint``; a batch that was written but not recorded is written again without repeating a key.
    """

    def batch(df: DataFrame, _: int) -> None:
        fresh = runs.unseen(df.sparkSession, target, df, keys)
        process(fresh).withColumn(runs.BUCKET, runs.bucket_of(keys)).write.mode("append").partitionBy(runs.BUCKET).parquet(target)

    return source.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
