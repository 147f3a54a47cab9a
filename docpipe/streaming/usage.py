"""Usage metrics on a request stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery

from docpipe.operators.metrics import histogram_metrics
from docpipe.streaming.sink import write_batches


def stream_latency_histogram(usage: DataFrame, bucket: str = "1 hour", delay: str = "1 minute") -> DataFrame:
    """``bucket, endpoint, ms, failed, n`` of each closed window (append mode):
    how many requests took so long. The state is these counts, which are
    combined before the shuffle and merge over batches, so a hot endpoint costs
    one row per distinct latency. Rows later than the watermark are dropped."""
    timed = usage.withColumn("event_time", F.col("timestamp").cast("timestamp")).withWatermark("event_time", delay)
    failed = F.coalesce("status_code", F.lit(0)) >= 400
    counted = timed.groupBy(
        F.window("event_time", bucket).alias("w"), "endpoint", F.col("response_time_ms").alias("ms"), failed.alias("failed")
    ).agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.col("w.start").cast("timestamp_ntz").alias("bucket"), "endpoint", "ms", "failed", "n")


def stream_usage_metrics(usage: DataFrame, path: str, checkpoint: str, bucket: str = "1 hour", delay: str = "1 minute",
                         available_now: bool = True) -> StreamingQuery:
    """Writes the metrics of `request_metrics`, exact percentiles included, per
    closed window and endpoint. All latencies of a window are emitted by the
    batch that closes it, so each batch is turned into metrics by itself."""
    histogram = stream_latency_histogram(usage, bucket, delay)
    return write_batches(histogram, path, checkpoint, transform=histogram_metrics, available_now=available_now)
