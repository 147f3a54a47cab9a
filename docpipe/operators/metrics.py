"""Aggregates over usage rows and jobs."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from docpipe.functions.scalars import as_timestamp, epoch_micros


def usage_total(usage: DataFrame, as_of, days: int = 7) -> DataFrame:
    """Requests per token in the window."""
    cutoff = as_timestamp(as_of) - F.make_dt_interval(days=F.lit(days))
    return usage.filter(F.col("timestamp") >= cutoff).groupBy("token_id").agg(
        F.count(F.lit(1)).alias("requests")
    )


def last_used(tokens: DataFrame, usage: DataFrame) -> DataFrame:
    """``token_id, last_used_at``; null for a token that was never used."""
    latest = usage.groupBy("token_id").agg(F.max("timestamp").alias("last_used_at"))
    return tokens.select("token_id").join(latest, "token_id", "left")


def request_metrics(usage: DataFrame, bucket: str = "1 hour", approximate: bool = False) -> DataFrame:
    """Requests, latency and error rate per endpoint and time bucket.

    Rows are first counted per distinct (bucket, endpoint, latency, failed),
    with a partial step before the shuffle, so a hot endpoint reaches its final
    task as a histogram. The exact percentiles are taken from that.
    """
    keyed = usage.select(
        F.window("timestamp", bucket).start.alias("bucket"),
        "endpoint",
        F.col("response_time_ms").alias("ms"),
        (F.coalesce("status_code", F.lit(0)) >= 400).alias("failed"),
    )
    if approximate:
        return keyed.groupBy("bucket", "endpoint").agg(
            F.count(F.lit(1)).alias("requests"),
            F.avg("ms").alias("avg_ms"),
            F.percentile_approx("ms", 0.5).cast("double").alias("p50_ms"),
            F.percentile_approx("ms", 0.95).cast("double").alias("p95_ms"),
            F.max("ms").alias("max_ms"),
            (F.count_if(F.col("failed")) / F.count(F.lit(1))).alias("error_rate"),
        )
    histogram = keyed.groupBy("bucket", "endpoint", "ms", "failed").agg(F.count(F.lit(1)).alias("n"))
    return histogram_metrics(histogram)


def histogram_metrics(histogram: DataFrame) -> DataFrame:
    """The metrics of `request_metrics` from ``bucket, endpoint, ms, failed, n``."""
    timed = F.when(F.col("ms").isNotNull(), F.col("n"))
    return histogram.groupBy("bucket", "endpoint").agg(
        F.sum("n").alias("requests"),
        (F.sum(F.col("ms").cast("bigint") * F.col("n")) / F.sum(timed)).alias("avg_ms"),
        F.percentile("ms", 0.5, F.col("n")).alias("p50_ms"),
        F.percentile("ms", 0.95, F.col("n")).alias("p95_ms"),
        F.max("ms").alias("max_ms"),
        (F.sum(F.when(F.col("failed"), F.col("n")).otherwise(0)) / F.sum("n")).alias("error_rate"),
    )


def job_metrics(jobs: DataFrame) -> DataFrame:
    """Per status: jobs, throttled jobs, queue wait and run time in seconds."""

    def seconds(start: str, end: str):
        return (epoch_micros(F.col(end)) - epoch_micros(F.col(start))) / F.lit(1_000_000)

    wait, run = seconds("created_at", "started_at"), seconds("started_at", "completed_at")
    return jobs.groupBy("status").agg(
        F.count(F.lit(1)).alias("jobs"),
        F.count_if(F.col("throttled")).alias("throttled"),
        F.avg(wait).alias("avg_wait_s"),
        F.max(wait).alias("max_wait_s"),
        F.avg(run).alias("avg_run_s"),
        F.max(run).alias("max_run_s"),
    )
