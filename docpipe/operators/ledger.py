"""Job ledger: listing, state from event logs, batch changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from docpipe.functions.scalars import all_of, as_timestamp, epoch_micros, floor_div
from docpipe.plans.lookup import lookup
from docpipe.schemas import CANCELLABLE_STATUSES, STATUSES, TERMINAL_STATUSES


def _matching(jobs: DataFrame, status: str | None, owner) -> DataFrame:
    if status is not None and status not in STATUSES:
        raise ValueError(f"Invalid status: {status}")
    conditions = []
    if status is not None:
        conditions.append(F.col("status") == status)
    if owner is not None:
        conditions.append(F.col("owner_user_id") == F.lit(owner))
    return jobs.filter(all_of(conditions)) if conditions else jobs


def list_jobs(jobs: DataFrame, status: str | None = None, owner=None, limit: int = 50,
              offset: int = 0, after: tuple | None = None) -> DataFrame:
    """A page of jobs, newest first, ``job_id`` breaking ties.

    Deep pages: pass ``after=(created_at, job_id)`` of the last row seen rather
    than a large offset, so no skipped rows are sorted.
    """
    found = _matching(jobs, status, owner)
    if after is not None:
        created, job_id = as_timestamp(after[0]), F.lit(after[1])
        found = found.filter(
            (F.col("created_at") < created)
            | ((F.col("created_at") == created) & (F.col("job_id") > job_id))
        )
    return found.orderBy(F.col("created_at").desc(), F.col("job_id")).offset(offset).limit(limit)


def count_jobs(jobs: DataFrame, status: str | None = None, owner=None) -> DataFrame:
    """Total behind a page: the same filter, one row ``total``."""
    return _matching(jobs, status, owner).agg(F.count(F.lit(1)).alias("total"))


def next_pending(jobs: DataFrame, policy: str = "reference", n: int = 1) -> DataFrame:
    """``reference``: the newest pending jobs, minus throttled ones (none if
    the newest is throttled). ``fifo``: the oldest jobs not throttled."""
    pending = jobs.filter(F.col("status") == "PENDING")
    free = ~F.coalesce(F.col("throttled"), F.lit(False))
    if policy == "reference":
        newest = pending.orderBy(F.col("created_at").desc(), F.col("job_id")).limit(n)
        return newest.filter(free)
    if policy == "fifo":
        return pending.filter(free).orderBy("created_at", "job_id").limit(n)
    raise ValueError(f"Unknown policy: {policy}")


def get_jobs(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """One row per wanted id, nulls if there is no such job."""
    return lookup(ids, jobs, "job_id")


def fold_job_state(events: DataFrame, slice_seconds: int = 600) -> DataFrame:
    """Current row per job from ``job_id, seq, event_time, event, result_path,
    error_message``.

    A CANCEL takes effect only right after PENDING or RUNNING; the last
    effective terminal event sets time, result and error together. Whether a
    CANCEL counts depends on the event before it, so events are ordered inside
    (job, time slice) and each slice is reduced to one summary row. Only the
    summaries of a job meet: its slices, not its events. Most jobs fit in one
    or two slices; a job with a large share of all events is cut by time.
    """
    order = F.struct("event_time", "seq")
    sliced = events.withColumn(
        "__slice", floor_div(epoch_micros(F.col("event_time")), slice_seconds * 1_000_000)
    )
    in_slice = Window.partitionBy("job_id", "__slice").orderBy("event_time", "seq")
    previous = F.lag("event").over(in_slice)
    is_cancel = F.col("event") == "CANCEL"
    effective = ~is_cancel | F.coalesce(F.col("__prev").isin(*CANCELLABLE_STATUSES), F.lit(False))
    status = F.when(is_cancel, F.lit("CANCELLED")).otherwise(F.col("event"))
    entry = F.struct(
        F.col("event_time"), F.col("seq"), F.col("__status").alias("status"),
        F.col("result_path"), F.col("error_message"),
    )
    terminal = F.col("__status").isin(*TERMINAL_STATUSES)
    summary = (
        sliced.withColumn("__prev", previous)
        .withColumn("__status", status)
        .withColumn("__effective", effective)
        .groupBy("job_id", "__slice")
        .agg(
            F.min(F.struct(order.alias("o"), is_cancel.alias("cancel"), entry.alias("e"))).alias("first"),
            F.max(F.struct(order.alias("o"), F.col("event").alias("event"))).alias("last"),
            F.max(F.when(F.col("__effective"), entry)).alias("state"),
            F.max(F.when(F.col("__effective") & terminal, entry)).alias("ended"),
            F.max(F.when(F.col("event") == "RUNNING", F.col("event_time"))).alias("started_at"),
        )
    )
    across = Window.partitionBy("job_id").orderBy("__slice")
    earlier = F.lag(F.col("last.event")).over(across)
    late_cancel = F.when(
        F.col("first.cancel") & F.coalesce(F.col("__earlier").isin(*CANCELLABLE_STATUSES), F.lit(False)),
        F.col("first.e"),
    )
    return (
        summary.withColumn("__earlier", earlier)
        .withColumn("__late", late_cancel)
        .groupBy("job_id")
        .agg(
            F.max(F.greatest("state", "__late")).alias("state"),
            F.max("started_at").alias("started_at"),
            F.max(F.greatest("ended", "__late")).alias("ended"),
        )
        .filter(F.col("state").isNotNull())
        .select(
            "job_id",
            F.col("state.status").alias("status"),
            "started_at",
            F.col("ended.event_time").alias("completed_at"),
            F.col("ended.result_path").alias("result_path"),
            F.col("ended.error_message").alias("error_message"),
        )
    )


def set_job_throttle(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """Applies ``job_id, throttled, actor``: the actor is recorded when
    throttling and cleared when not. One change per job."""
    new = changes.select(
        "job_id", F.col("throttled").alias("__new"), F.col("actor").alias("__actor"), F.lit(True).alias("__hit")
    )
    return (
        jobs.join(new, "job_id", "left")
        .withColumn("throttled_by", F.when(F.col("__hit"), F.when(F.col("__new"), F.col("__actor"))).otherwise(F.col("throttled_by")))
        .withColumn("throttled", F.when(F.col("__hit"), F.col("__new")).otherwise(F.col("throttled")))
        .drop("__new", "__actor", "__hit")
    )


def apply_status_changes(jobs: DataFrame, changes: DataFrame, as_of) -> DataFrame:
    """Jobs after a batch of ``job_id, status, result_path, error_message,
    cancel``: RUNNING sets the start, a terminal status sets completion, result
    and error (null included), PENDING only the status. A ``cancel`` row counts
    only for a pending or running job. One change per job; fold longer logs
    with `fold_job_state`."""
    new = changes.select(
        "job_id",
        F.when(F.col("cancel"), F.lit("CANCELLED")).otherwise(F.col("status")).alias("__status"),
        F.col("cancel").alias("__cancel"),
        F.when(~F.col("cancel"), F.col("result_path")).alias("__result"),
        F.when(~F.col("cancel"), F.col("error_message")).alias("__error"),
    )
    now = as_timestamp(as_of)
    hit = F.col("__status").isNotNull() & (~F.col("__cancel") | F.col("status").isin(*CANCELLABLE_STATUSES))
    started = F.col("__hit") & (F.col("__status") == "RUNNING")
    ended = F.col("__hit") & F.col("__status").isin(*TERMINAL_STATUSES)

    def put(condition: Column, value: Column, column: str) -> Column:
        return F.when(F.coalesce(condition, F.lit(False)), value).otherwise(F.col(column))

    joined = jobs.join(new, "job_id", "left").withColumn("__hit", F.coalesce(hit, F.lit(False)))
    return joined.withColumns(
        {
            "status": put(F.col("__hit"), F.col("__status"), "status"),
            "started_at": put(started, now, "started_at"),
            "completed_at": put(ended, now, "completed_at"),
            "result_path": put(ended, F.col("__result"), "result_path"),
            "error_message": put(ended, F.col("__error"), "error_message"),
        }
    ).drop("__status", "__cancel", "__result", "__error", "__hit")


def status_change_outcomes(jobs: DataFrame, changes: DataFrame) -> DataFrame:
    """``job_id, updated`` per change."""
    current = jobs.select("job_id", F.col("status").alias("__current"))
    open_job = F.col("__current").isin(*CANCELLABLE_STATUSES)
    updated = F.col("__current").isNotNull() & (~F.col("cancel") | open_job)
    return changes.join(current, "job_id", "left").select("job_id", updated.alias("updated"))
