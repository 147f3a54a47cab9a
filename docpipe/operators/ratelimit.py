"""Replay of request logs against per-token limits.

Two policies with different answers. *Fixed*: every request of a clock window
counts, rejected ones too. *Sliding*: only requests that were allowed count,
for exactly one window length (a request that is a full window old is out).

Every request is kept, whatever the window's length. Requests without a token
share one, with the limit of a token that is not listed. A request without a
time has no place in a window: it is allowed, has no rank and counts for none.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from docpipe.functions.scalars import epoch_micros, floor_div
from docpipe.plans.ordered import sliced_row_number

#: Limit of a token that the limits table does not list.
UNLISTED_LIMIT = 60
#: A clock window is ranked in at most this many slices of a minute or more.
MAX_SLICES = 1440


def _with_limit(df: DataFrame, limits: int | DataFrame) -> DataFrame:
    """Adds ``rate_limit``; ``limits`` is one number or ``token_id, rate_limit``."""
    if isinstance(limits, int):
        return df.withColumn("rate_limit", F.lit(limits))
    listed = limits.select("token_id", F.col("rate_limit").alias("__limit"))
    return (
        df.join(listed, "token_id", "left")
        .withColumn("rate_limit", F.coalesce("__limit", F.lit(UNLISTED_LIMIT)))
        .drop("__limit")
    )


def _ranked(requests: DataFrame, window_seconds: int, ts: str, tie: str) -> DataFrame:
    """Adds ``window_id`` and the request's 1-based ``request_rank`` in it."""
    slice_us = max(60, -(-window_seconds // MAX_SLICES)) * 1_000_000
    window_us = window_seconds * 1_000_000
    timed = requests.withColumn("__us", epoch_micros(F.col(ts))).withColumn(
        "window_id", floor_div(F.col("__us"), window_us)
    )
    order = [F.col("__us"), F.col(tie)]
    if window_us <= slice_us:
        rank = F.row_number().over(Window.partitionBy("token_id", "window_id").orderBy(*order))
        ranked = timed.withColumn("request_rank", rank.cast("bigint"))
    else:
        ranked = sliced_row_number(
            timed, ["token_id", "window_id"], order, floor_div(F.col("__us"), slice_us), "request_rank"
        )
    timed_rank = F.when(F.col("__us").isNotNull(), F.col("request_rank"))
    return ranked.withColumn("request_rank", timed_rank).drop("__us")


def rate_limit_fixed(
    requests: DataFrame, limits: int | DataFrame, window_seconds: int = 60,
    ts: str = "timestamp", tie: str = "id",
) -> DataFrame:
    """Adds ``window_id, request_rank, rate_limit, allowed``."""
    ranked = _ranked(requests, window_seconds, ts, tie)
    return _with_limit(ranked, limits).withColumn(
        "allowed", F.coalesce(F.col("request_rank") <= F.col("rate_limit"), F.lit(True)))


def rate_limit_headroom(
    requests: DataFrame, limits: int | DataFrame, window_seconds: int = 60,
    ts: str = "timestamp", tie: str = "id",
) -> DataFrame:
    """`rate_limit_fixed` plus ``remaining`` and ``reset_epoch`` (seconds)."""
    decided = rate_limit_fixed(requests, limits, window_seconds, ts, tie)
    left = F.when(F.col("request_rank").isNotNull(), F.greatest(F.col("rate_limit") - F.col("request_rank"), F.lit(0))).cast("bigint")
    return decided.withColumn("remaining", left).withColumn(
        "reset_epoch", (F.col("window_id") + 1) * F.lit(window_seconds)
    )


def rate_limit_sliding(
    requests: DataFrame, limits: int | DataFrame, window_seconds: int = 60,
    ts: str = "timestamp", tie: str = "id",
) -> DataFrame:
    """Adds ``rate_limit, allowed``.

    A decision depends on earlier decisions, but only where a token comes near
    its limit. Time is cut into slices of one window length. If a slice and
    the one before it hold no more requests than the limit, every request of
    the slice is allowed: no window ending in it can be full. Those rows never
    leave the JVM. What remains are runs of consecutive busy slices; a run
    starts from a known history, the requests of the calm slice before it, so
    runs are independent and a token spreads over as many tasks as it has
    runs. Each run streams through one pass that keeps at most ``rate_limit``
    timestamps.
    """
    window_us = window_seconds * 1_000_000
    placed = requests.withColumn("__us", epoch_micros(F.col(ts))).withColumn(
        "__slice", floor_div(F.col("__us"), window_us)
    )
    rows = placed.filter(F.col("__us").isNotNull())
    untimed = _with_limit(placed.filter(F.col("__us").isNull()), limits).withColumn("allowed", F.lit(True))
    counts = rows.groupBy("token_id", "__slice").agg(F.count(F.lit(1)).alias("__n"))
    order = Window.partitionBy("token_id").orderBy("__slice")
    follows = F.coalesce(F.lag("__slice").over(order) == F.col("__slice") - 1, F.lit(False))
    before = F.when(follows, F.lag("__n").over(order)).otherwise(F.lit(0))
    slices = _with_limit(counts, limits).withColumn(
        "__busy", F.col("__n") + before > F.col("rate_limit")
    )
    starts = F.col("__busy") & ~(follows & F.coalesce(F.lag("__busy").over(order), F.lit(False)))
    slices = slices.withColumn("__start", starts)
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = F.when(
        F.col("__busy"), F.last(F.when(F.col("__start"), F.col("__slice")), ignorenulls=True).over(upto)
    )
    next_starts = (F.lead("__slice").over(order) == F.col("__slice") + 1) & F.lead("__start").over(order)
    warms = F.when(~F.col("__busy") & next_starts, F.col("__slice") + 1)
    slices = slices.select(
        "token_id", "__slice", "rate_limit", run.alias("__run"), warms.alias("__warms")
    )
    slices = slices.withColumnRenamed("token_id", "__token").withColumnRenamed("__slice", "__of_slice")
    same = F.col("token_id").eqNullSafe(F.col("__token")) & (F.col("__slice") == F.col("__of_slice"))
    tagged = rows.join(slices, same).drop("__token", "__of_slice")
    columns = [*requests.columns, "rate_limit", "allowed"]
    calm = tagged.filter(F.col("__run").isNull()).withColumn("allowed", F.lit(True)).select(*columns)
    replay_input = (
        tagged.filter(F.col("__run").isNotNull() | F.col("__warms").isNotNull())
        .withColumn("__history", F.col("__run").isNull())
        .withColumn("__run", F.coalesce("__run", "__warms"))
        .select(*requests.columns, "rate_limit", "__us", "__run", "__history")
        .repartition("token_id", "__run")
        .sortWithinPartitions("token_id", "__run", "__us", tie)
    )
    kept = [f for f in replay_input.schema if f.name not in ("__us", "__run", "__history")]
    schema = StructType([*kept, StructField("allowed", BooleanType())])
    replayed = replay_input.mapInArrow(_replay(window_us), schema).select(*columns)
    return calm.unionByName(replayed).unionByName(untimed.select(*columns))


def _replay(window_us: int):
    """Streams sorted runs; the history is reset when the run changes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, history = None, deque()
        for batch in batches:
            column = {name: batch.column(name) for name in ("token_id", "__run", "__us", "__history", "rate_limit")}
            decisions = []
            for token, start, us, known, limit in zip(*(c.to_pylist() for c in column.values())):
                if (token, start) != current:
                    current, history = (token, start), deque()
                while history and history[0] <= us - window_us:
                    history.popleft()
                allowed = known or len(history) < limit
                if allowed:
                    history.append(us)
                decisions.append(allowed)
            names = [n for n in batch.schema.names if n not in ("__us", "__run", "__history")]
            decided = pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(decisions, pa.bool_())], names=[*names, "allowed"]
            )
            yield decided.filter(pc.invert(column["__history"]))

    return run


def rejections(decisions: DataFrame) -> DataFrame:
    """Requests and rejected requests per token."""
    return decisions.groupBy("token_id").agg(
        F.count(F.lit(1)).alias("requests"),
        F.sum(F.when(F.col("allowed"), 0).otherwise(1)).alias("rejected"),
    )
