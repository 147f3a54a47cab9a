"""Rate limits against a sequential replay of random logs."""

import random
from collections import defaultdict, deque
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from docpipe.operators.ratelimit import (
    rate_limit_fixed, rate_limit_headroom, rate_limit_sliding, rejections,
)

SCHEMA = "id bigint, token_id string, timestamp timestamp_ntz"
START = datetime(2024, 1, 1)


def sliding(rows, limit_of, window):
    logs, out = defaultdict(deque), {}
    for ts, request, token in sorted((r[2], r[0], r[1]) for r in rows):
        log = logs[token]
        while log and log[0] <= ts - timedelta(seconds=window):
            log.popleft()
        out[request] = len(log) < limit_of(token)
        if out[request]:
            log.append(ts)
    return out


def fixed(rows, limit_of, window):
    counts, out = defaultdict(int), {}
    for ts, request, token in sorted((r[2], r[0], r[1]) for r in rows):
        slot = (token, int((ts - START).total_seconds()) // window)
        counts[slot] += 1
        out[request] = counts[slot] <= limit_of(token)
    return out


def log(seed, tokens, n, span, step=1.0):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        # A third of all rows on one token, many equal and whole-minute times.
        token = "hot" if rng.random() < 0.33 else f"t{rng.randrange(tokens)}"
        at = START + timedelta(seconds=round(rng.random() * span / step) * step)
        rows.append((i, token, at))
    return rows


@pytest.mark.parametrize("seed,limit,span,step", [
    (1, 0, 600, 1), (3, 1, 6000, 60), (5, 3, 400, 0.5), (6, 10, 2000, 1), (8, 5, 90_000, 60),
])
def test_sliding_equals_replay(spark, seed, limit, span, step):
    rows = log(seed, 8, 1500, span, step)
    decided = rate_limit_sliding(spark.createDataFrame(rows, SCHEMA), limit).collect()
    assert {r.id: r.allowed for r in decided} == sliding(rows, lambda _: limit, 60)


@pytest.mark.parametrize("seed,limit,window", [(1, 0, 60), (3, 5, 60), (5, 200, 86_400)])
def test_fixed_equals_replay(spark, seed, limit, window):
    rows = log(seed, 8, 1500, 4000)
    decided = rate_limit_fixed(spark.createDataFrame(rows, SCHEMA), limit, window).collect()
    assert {r.id: r.allowed for r in decided} == fixed(rows, lambda _: limit, window)


def test_limits_per_token_and_default(spark):
    rows = log(9, 4, 800, 500)
    limits = spark.createDataFrame([("hot", 3), ("t0", 0), ("t1", 7)], "token_id string, rate_limit int")
    limit_of = {"hot": 3, "t0": 0, "t1": 7}
    df = spark.createDataFrame(rows, SCHEMA)
    got = {r.id: r.allowed for r in rate_limit_sliding(df, limits).collect()}
    assert got == sliding(rows, lambda t: limit_of.get(t, 60), 60)
    got = {r.id: r.allowed for r in rate_limit_fixed(df, limits).collect()}
    assert got == fixed(rows, lambda t: limit_of.get(t, 60), 60)


def test_exactly_one_window_later_is_allowed(spark):
    rows = [(i, "a", START + timedelta(seconds=s)) for i, s in enumerate([0, 59.999999, 60, 60, 119.999999, 120])]
    got = {r.id: r.allowed for r in rate_limit_sliding(spark.createDataFrame(rows, SCHEMA), 1).collect()}
    assert got == {0: True, 1: False, 2: True, 3: False, 4: False, 5: True}


def test_eleventh_request_is_blocked_and_users_are_independent(spark):
    rows = [(i, "a", START + timedelta(milliseconds=i)) for i in range(11)]
    rows += [(100 + i, "b", START + timedelta(milliseconds=i)) for i in range(5)]
    for policy in (rate_limit_sliding, rate_limit_fixed):
        got = {r.id: r.allowed for r in policy(spark.createDataFrame(rows, SCHEMA), 10).collect()}
        assert [got[i] for i in range(11)] == [True] * 10 + [False]
        assert all(got[100 + i] for i in range(5))


def test_policies_differ_on_rejected_requests(spark):
    # A rejected request counts in the fixed window only.
    rows = [(i, "a", START + timedelta(seconds=s)) for i, s in enumerate([50, 55, 61, 62, 110.5])]
    df = spark.createDataFrame(rows, SCHEMA)
    assert [r.allowed for r in rate_limit_fixed(df, 1).orderBy("id").collect()] == [True, False, True, False, False]
    assert [r.allowed for r in rate_limit_sliding(df, 1).orderBy("id").collect()] == [True, False, False, False, True]


def test_headroom_and_rejections(spark):
    rows = [(i, "a", START + timedelta(seconds=i)) for i in range(4)]
    df = rate_limit_headroom(spark.createDataFrame(rows, SCHEMA), 2)
    got = [(r.remaining, r.allowed) for r in df.orderBy("id").collect()]
    assert got == [(1, True), (0, True), (0, False), (0, False)]
    epoch = int((START - datetime(1970, 1, 1)).total_seconds())
    assert {r.reset_epoch for r in df.collect()} == {epoch + 60}
    assert rejections(df).collect()[0].asDict() == {"token_id": "a", "requests": 4, "rejected": 2}


def test_calm_tokens_skip_python(spark):
    rows = [(i, f"t{i % 5}", START + timedelta(seconds=30 * i)) for i in range(100)]
    decided = rate_limit_sliding(spark.createDataFrame(rows, SCHEMA), 10)
    assert decided.filter(~F.col("allowed")).count() == 0


def test_null_tokens_and_times_are_kept_by_every_window(spark):
    rows = [(i, None if i % 2 else "a", START + timedelta(seconds=i) if i > 3 else None) for i in range(12)]
    df = spark.createDataFrame(rows, SCHEMA)
    for window in (60, 3_600, 86_400):
        fixed = {r.id: (r.request_rank, r.allowed) for r in rate_limit_fixed(df, 3, window).collect()}
        assert len(fixed) == 12 and all(fixed[i] == (None, True) for i in range(4))
        assert [fixed[i] for i in range(4, 12, 2)] == [fixed[i] for i in range(5, 12, 2)] == [(1, True), (2, True), (3, True), (4, False)]
        sliding = {r.id: r.allowed for r in rate_limit_sliding(df, 3, window).collect()}
        assert sliding == {i: i not in (10, 11) for i in range(12)}
