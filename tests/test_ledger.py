"""Job state, listing and access against plain Python."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docpipe.operators import access, ledger
from docpipe.plans.convert import assign_job_ids, submit_jobs

EVENTS = "job_id string, seq bigint, event_time timestamp_ntz, event string, result_path string, error_message string"
START = datetime(2024, 1, 1)


def replay(rows):
    jobs = {}
    for job, seq, at, event, path, error in sorted(rows, key=lambda r: (r[2], r[1])):
        row = jobs.get(job)
        if event == "CANCEL":
            if row is None or row[0] not in ("PENDING", "RUNNING"):
                continue
            event = "CANCELLED"
        row = jobs.setdefault(job, [None] * 5)
        row[0] = event
        if event == "RUNNING":
            row[1] = at
        elif event in ("COMPLETED", "FAILED", "CANCELLED"):
            row[2:] = [at, path, error]
    return {job: tuple(row) for job, row in jobs.items()}


@pytest.mark.parametrize("seed,slice_seconds", [(1, 86_400), (2, 3600), (3, 60), (4, 1)])
def test_fold_equals_replay(spark, seed, slice_seconds):
    rng = random.Random(seed)
    rows = []
    for i in range(2000):
        job = "hot" if rng.random() < 0.33 else f"j{rng.randrange(300)}"
        event = rng.choice(["PENDING", "RUNNING", "COMPLETED", "FAILED", "CANCEL", "CANCEL", "CANCEL"])
        at = START + timedelta(seconds=rng.randrange(5000))
        rows.append((
            job, i, at, event, f"r{i}" if event == "COMPLETED" else None, f"e{i}" if event == "FAILED" else None,
        ))
    folded = ledger.fold_job_state(spark.createDataFrame(rows, EVENTS), slice_seconds).collect()
    got = {
        r.job_id: (r.status, r.started_at, r.completed_at, r.result_path, r.error_message) for r in folded
    }
    assert got == replay(rows)


def test_cancel_rules(spark):
    def at(s):
        return START + timedelta(seconds=s)

    rows = [
        ("only-cancel", 1, at(0), "CANCEL", None, None),
        ("late", 1, at(0), "RUNNING", None, None), ("late", 2, at(1), "CANCEL", None, None),
        ("late", 3, at(2), "COMPLETED", "out.md", None),
        ("done", 1, at(0), "COMPLETED", "a.md", None), ("done", 2, at(1), "CANCEL", None, None),
        ("reset", 1, at(0), "COMPLETED", "a.md", None), ("reset", 2, at(1), "RUNNING", None, None),
        ("reset", 3, at(100_000), "CANCEL", None, None),
    ]
    got = {r.job_id: r for r in ledger.fold_job_state(spark.createDataFrame(rows, EVENTS)).collect()}
    assert set(got) == {"late", "done", "reset"}
    assert (got["late"].status, got["late"].result_path) == ("COMPLETED", "out.md")
    assert (got["done"].status, got["done"].result_path) == ("COMPLETED", "a.md")
    # A cancel after a result clears it.
    assert (got["reset"].status, got["reset"].result_path) == ("CANCELLED", None)


JOBS = "job_id string, owner_user_id string, status string, created_at timestamp_ntz, throttled boolean"


@pytest.fixture
def jobs(spark):
    return spark.createDataFrame([
        ("a", "u1", "PENDING", START, False),
        ("b", "u1", "PENDING", START + timedelta(hours=1), True),
        ("c", "u2", "COMPLETED", START + timedelta(hours=2), False),
        ("d", "u2", "PENDING", START + timedelta(hours=1), False),
    ], JOBS)


def ids(df):
    return [r.job_id for r in df.collect()]


def test_list_pages_are_stable(jobs):
    assert ids(ledger.list_jobs(jobs)) == ["c", "b", "d", "a"]
    assert ids(ledger.list_jobs(jobs, limit=2, offset=1)) == ["b", "d"]
    assert ids(ledger.list_jobs(jobs, after=(START + timedelta(hours=1), "b"))) == ["d", "a"]
    assert ids(ledger.list_jobs(jobs, "PENDING", "u1")) == ["b", "a"]
    assert ledger.count_jobs(jobs, "PENDING").collect()[0].total == 3


def test_bad_status_is_refused(jobs):
    with pytest.raises(ValueError, match="Invalid status: bad"):
        ledger.list_jobs(jobs, "bad")


def test_next_pending(jobs):
    # The newest pending job is throttled: the reference policy returns none.
    assert ids(ledger.next_pending(jobs)) == []
    assert ids(ledger.next_pending(jobs, "fifo")) == ["a"]
    with pytest.raises(ValueError):
        ledger.next_pending(jobs, "other")


def test_visibility_and_access(spark, jobs):
    grants = spark.createDataFrame(
        [("c", "u1", "u2", START), ("a", "u1", "u1", START)],
        "job_id string, granted_to_user_id string, granted_by_user_id string, granted_at timestamp_ntz",
    )
    assert sorted(ids(access.visible_jobs(jobs, "u1", "job_reader"))) == ["a", "b"]
    assert sorted(ids(access.visible_jobs(jobs, "u1", "job_reader", grants, True))) == ["a", "b", "c"]
    assert len(ids(access.visible_jobs(jobs, "u1", "job_manager"))) == 4
    assert sorted(ids(access.visible_jobs(jobs, "u1", "nobody"))) == ["a", "b"]
    pairs = spark.createDataFrame(
        [("a", "u1"), ("c", "u1"), ("d", "u1"), ("zz", "u1")], "job_id string, user_id string"
    )
    got = {r.job_id: r.has_access for r in access.job_access(pairs, jobs, grants).collect()}
    assert got == {"a": True, "c": True, "d": False, "zz": False}


def test_permission_matrix_sizes(spark):
    granted = access.permission_matrix(spark).filter("granted").groupBy("role").count().collect()
    assert {r.role: r["count"] for r in granted} == {
        "admin": 13, "job_manager": 6, "job_writer": 4, "job_reader": 1,
    }


def test_ids_are_unique_and_repeatable(spark):
    df = spark.range(2000).selectExpr("id", "'p' AS path")
    first = assign_job_ids(df, ["id", "path"]).collect()
    again = assign_job_ids(df.repartition(7), ["id", "path"]).collect()
    assert {r.id: r.job_id for r in first} == {r.id: r.job_id for r in again}
    assert len({r.job_id for r in first}) == 2000
    assert all(len(r.job_id) == 10 and r.job_id.isalnum() and r.job_id.isascii() for r in first)


def test_taken_ids_are_hashed_again(spark):
    df = spark.range(50).selectExpr("id")
    taken = assign_job_ids(df, ["id"]).filter("id < 10").select("job_id")
    fresh = assign_job_ids(df, ["id"], existing=taken)
    used = {r.job_id for r in taken.collect()}
    assert not used & {r.job_id for r in fresh.collect()} and fresh.count() == 50


def test_colliding_ids(spark):
    # Two letters have 3,844 ids, so 800 rows collide often.
    df = spark.range(800).selectExpr("id", "id % 7 AS other")
    stored = spark.range(400).select(F.concat(F.lit("a"), F.substring(F.md5(F.col("id").cast("string")), 1, 1)).alias("job_id"))
    rows = assign_job_ids(df, ["id"], existing=stored, length=2).collect()
    ids = [r.job_id for r in rows]
    assert len(set(ids)) == 800 and not set(ids) & {r.job_id for r in stored.collect()}
    again = assign_job_ids(df.repartition(5), ["id"], existing=stored, length=2).collect()
    assert {r.id: r.job_id for r in again} == {r.id: r.job_id for r in rows} and rows[0].other is not None
    twice = assign_job_ids(spark.createDataFrame([(1,), (1,), (1,), (None,)], "id bigint"), ["id"]).collect()
    assert len({r.job_id for r in twice}) == 4
    with pytest.raises(Exception, match="10 attempts"):
        assign_job_ids(spark.range(80), ["id"], length=1).collect()


def test_ids_need_no_job_while_planned(spark):
    spark.sparkContext.setJobGroup("planning", "ids")
    try:
        ids = assign_job_ids(spark.range(10), ["id"], existing=spark.range(3).selectExpr("CAST(id AS STRING) AS job_id"))
        assert ids.columns == ["id", "job_id"]
        assert list(spark.sparkContext.statusTracker().getJobIdsForGroup("planning")) == []
        assert ids.count() == 10
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("planning")) > 0
    finally:
        spark.sparkContext.setJobGroup("tests", "tests")


def test_submit(spark):
    requests = spark.createDataFrame([
        (1, "u1", "job_writer", "a.pdf", "json", "pymupdf"),
        (2, "u1", "job_reader", "a.pdf", "json", "pymupdf"),
        (3, "u1", "admin", "a.PDF", "json", "pymupdf"),
        (4, "u1", "admin", "a.pdf", "json", "auto"),
    ], "request_id int, user_id string, role string, filename string, output_format string, extractor string")
    rows = submit_jobs(requests, START).collect()
    assert [(r.request_id, r.status, r.pdf_path) for r in rows] == [(1, "PENDING", "data/uploads/u1_a.pdf")]
    assert rows[0].options == '{"output_format": "json", "extractor": "pymupdf", "include_metadata": true}'
