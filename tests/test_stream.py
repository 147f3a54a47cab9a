"""Streams over several micro-batches give what the batch operators give."""

import random
import shutil
import time
from datetime import datetime, timedelta

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import Row, functions as F

from docpipe.fixtures import Inputs
from docpipe.operators.ledger import fold_job_state
from docpipe.operators.metrics import request_metrics
from docpipe.operators.ratelimit import rate_limit_fixed, rate_limit_sliding
from docpipe.plans.convert import convert_corpus
from docpipe.registry import streams
from docpipe.streaming.jobs import _JobState, latest_job_state, stream_convert, stream_files, stream_job_state
from docpipe.streaming.limits import _FixedWindow, _SlidingLog, latest_decisions, stream_rate_fixed, stream_rate_sliding, stream_window_counts
from docpipe.streaming.sink import read_batches, write_batches
from docpipe.streaming.usage import stream_usage_metrics

START = datetime(2024, 1, 1)
USAGE = "id bigint, token_id string, timestamp timestamp_ntz, endpoint string, response_time_ms int, status_code int"


@pytest.fixture(scope="module")
def usage():
    rng = random.Random(5)
    times = sorted(rng.randrange(1200) for _ in range(600))
    return [
        (i, "hot" if rng.random() < 0.4 else f"t{rng.randrange(6)}", START + timedelta(seconds=t),
         rng.choice(["/a", "/b"]), rng.randrange(100), rng.choice([200, 200, 500]))
        for i, t in enumerate(times)
    ]


def write_parts(spark, rows, schema, path, parts):
    """One file per part, in row order."""
    size = -(-len(rows) // parts)
    for part in range(parts):
        chunk = rows[part * size:(part + 1) * size]
        spark.createDataFrame(chunk, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.read.parquet(path).schema


def source(spark, path, schema):
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(stream, base, mode="append"):
    query = write_batches(stream, f"{base}/out", f"{base}/checkpoint", mode)
    query.awaitTermination()
    return f"{base}/out"


@pytest.mark.parametrize("policy", ["fixed", "sliding"])
def test_limits(spark, usage, tmp_path, policy):
    schema = write_parts(spark, usage, USAGE, f"{tmp_path}/in", 3)
    stream_of = stream_rate_fixed if policy == "fixed" else stream_rate_sliding
    batch_of = rate_limit_fixed if policy == "fixed" else rate_limit_sliding
    path = run(stream_of(source(spark, f"{tmp_path}/in", schema), 3), str(tmp_path))
    got = {r.id: r.allowed for r in latest_decisions(spark, path).collect()}
    want = {r.id: r.allowed for r in batch_of(spark.createDataFrame(usage, USAGE), 3).collect()}
    assert got == want and False in got.values()


@pytest.mark.parametrize("policy", ["fixed", "sliding"])
def test_limits_out_of_order(spark, usage, tmp_path, policy):
    rows = usage + [(9000, None, START, "/a", 1, 200), (9001, None, START, "/a", 1, 200), (9002, "hot", None, "/a", 1, 200)]
    random.Random(8).shuffle(rows)
    schema = write_parts(spark, rows, USAGE, f"{tmp_path}/in", 4)
    stream_of = stream_rate_fixed if policy == "fixed" else stream_rate_sliding
    batch_of = rate_limit_fixed if policy == "fixed" else rate_limit_sliding
    path = run(stream_of(source(spark, f"{tmp_path}/in", schema), 3, delay="1 hour"), str(tmp_path))
    got = {r.id: (r.allowed, r.late) for r in latest_decisions(spark, path).collect()}
    want = {r.id: (r.allowed, False) for r in batch_of(spark.createDataFrame(rows, USAGE), 3).collect()}
    assert got == want and len(got) == len(rows)


@pytest.mark.parametrize("policy", ["fixed", "sliding"])
def test_late_requests_are_rows(spark, tmp_path, policy):
    def request(i, seconds):
        return i, "t", START + timedelta(seconds=seconds), "/a", 1, 200

    for part in ([request(1, 0), request(2, 600)], [request(3, 605)], [request(4, 10), request(5, 610)]):
        schema = write_parts(spark, part, USAGE, f"{tmp_path}/in", 1)
    stream_of = stream_rate_fixed if policy == "fixed" else stream_rate_sliding
    path = run(stream_of(source(spark, f"{tmp_path}/in", schema), 2), str(tmp_path))
    got = {r.id: (r.allowed, r.late) for r in latest_decisions(spark, path).collect()}
    assert got == {1: (True, False), 2: (True, False), 3: (True, False), 4: (None, True), 5: (False, False)}


def test_job_state_out_of_order(spark, tmp_path):
    rng = random.Random(7)
    schema = ("job_id string, seq bigint, event_time timestamp_ntz, event string, result_path string, "
              "error_message string")
    rows = [
        (f"j{rng.randrange(20)}", i, START + timedelta(seconds=i // 2),
         rng.choice(["PENDING", "RUNNING", "COMPLETED", "FAILED", "CANCEL", "CANCEL"]), f"r{i}", None)
        for i in range(200)
    ]
    rng.shuffle(rows)
    declared = write_parts(spark, rows, schema, f"{tmp_path}/in", 4)
    path = run(stream_job_state(source(spark, f"{tmp_path}/in", declared)), str(tmp_path), "update")
    columns = ["job_id", "status", "started_at", "completed_at", "result_path", "error_message"]
    got = sorted(map(repr, latest_job_state(spark, path).select(columns).collect()))
    want = fold_job_state(spark.createDataFrame(rows, schema)).select(columns)
    assert got == sorted(map(repr, want.collect()))


def test_convert_same_file_again(spark, tmp_path):
    schema = "path string, size bigint, modified timestamp_ntz, content binary"
    first = [("a.pdf", 8, START, bytearray(b"%PDF-one")), ("b.pdf", 0, START, bytearray(b""))]
    again = [*first, ("a.pdf", 8, START, bytearray(b"%PDF-two"))]

    def poll():
        stream_convert(
            source(spark, f"{tmp_path}/in", declared), f"{tmp_path}/out", f"{tmp_path}/checkpoint", output_format="text"
        ).awaitTermination()

    declared = write_parts(spark, [*first, *first, *first[:1]], schema, f"{tmp_path}/in", 1)
    poll()
    found = read_batches(spark, f"{tmp_path}/out").select("path", "source_hash").collect()
    assert sorted(r.path for r in found) == ["a.pdf", "b.pdf"]
    # What was written is not read again: it may be moved away.
    shutil.move(f"{tmp_path}/out", f"{tmp_path}/moved")
    for part in (first, again):
        write_parts(spark, part, schema, f"{tmp_path}/in", 1)
    poll()
    found += read_batches(spark, f"{tmp_path}/out").select("path", "source_hash").collect()
    assert sorted(r.path for r in found) == ["a.pdf", "a.pdf", "b.pdf"] and len(set(found)) == 3


def test_folder_of_files(spark, tmp_path):
    inbox, listed = tmp_path / "in", f"{tmp_path}/manifests"
    inbox.mkdir()
    steps = [{"a.pdf": b"%PDF-a", "_b.pdf": b"%PDF-b", "c.pdf": b""}, {"d.pdf": b"%PDF-d", "e.txt": b"no"}, {"f.pdf": b"%PDF-\xff"}]
    told = {}
    for step in steps:
        for name, content in step.items():
            (inbox / name).write_bytes(content)
        told |= step
        # The whole folder is listed each time.
        rows = [(f"{inbox}/{name}", len(content), START) for name, content in told.items()]
        spark.createDataFrame(rows, "path string, size bigint, modified timestamp_ntz").write.mode("append").parquet(listed)
        files = stream_files(spark, str(inbox), listed, glob="*.pdf")
        stream_convert(files, f"{tmp_path}/out", f"{tmp_path}/checkpoint", output_format="text").awaitTermination()
    found = {r.path.rsplit("/", 1)[1]: r for r in read_batches(spark, f"{tmp_path}/out").collect()}
    assert read_batches(spark, f"{tmp_path}/out").count() == 5 and set(found) == {"a.pdf", "_b.pdf", "c.pdf", "d.pdf", "f.pdf"}
    assert {n for n, r in found.items() if r.status == "COMPLETED"} == {"a.pdf", "d.pdf", "f.pdf"}
    assert found["c.pdf"].error_message == "PDF validation failed: File is empty"
    assert found["_b.pdf"].error_message.startswith("PDF validation failed: Failed to read file")
    assert {r.batch for r in found.values()} >= {0, 1, 2}


def poll_folder(spark, folder, path, **options):
    """One poll; what it found, and the bytes that the driver keeps of the poll."""
    stream = stream_files(spark, str(folder), **options)
    write_batches(stream, f"{path}/out", f"{path}/checkpoint").awaitTermination()
    kept = [f for name in ("offsets", "sources") for f in (path / "checkpoint" / name).rglob("*") if f.is_file() and f.suffix != ".crc"]
    return read_batches(spark, f"{path}/out").drop("batch"), sum(f.stat().st_size for f in kept)


def test_driver_keeps_nothing_of_a_file(spark, tmp_path):
    kept = {}
    for count in (3, 300):
        inbox = tmp_path / f"in{count}"
        inbox.mkdir()
        for i in range(count):
            (inbox / f"{i:03}.pdf").write_bytes(b"%PDF-")
        found, kept[count] = poll_folder(spark, inbox, tmp_path / f"run{count}", glob="*.pdf")
        assert found.count() == count
    assert kept[300] < kept[3] + 50


def test_folder_as_spark_reads_it(spark, tmp_path):
    inbox = tmp_path / "in box"
    contents = {"a.pdf": b"%PDF-a", "a%20b c.pdf": b"%PDF-b", "_c.pdf": b"%PDF-c", "_d=1.pdf": b"%PDF-d", ".e.pdf": b"%PDF-e", "f.pdf": b"",
                "_metadata.pdf": b"%PDF-g", "h.txt": b"no", "\u00fc.md": b"%PDF-h\n\xff", "sub/i.pdf": b"%PDF-i", "_sub/j.pdf": b"%PDF-j",
                "sub/deep/k.pdf": b"%PDF-k" * 1000, "l.pdf._COPYING_": b"%PDF-l", "sub/[m].pdf": b"%PDF-m"}
    for name, content in contents.items():
        (inbox / name).parent.mkdir(parents=True, exist_ok=True)
        (inbox / name).write_bytes(content)
    for i, options in enumerate([{}, {"glob": "*.{pdf,md}"}, {"recursive": True, "glob": "[!a]*.pdf"}]):
        got, _ = poll_folder(spark, inbox, tmp_path / f"own{i}", **options)
        # Spark's own source takes the limit on files.
        want, _ = poll_folder(spark, inbox, tmp_path / f"spark{i}", max_files=100, **options)
        assert got.schema == want.schema
        assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and want.count() > 3


def test_polls_tell_a_path_once(spark, tmp_path):
    inbox, told = tmp_path / "in", set()
    inbox.mkdir()
    for step in range(3):
        for i in range(20 * step, 20 * step + 20):
            (inbox / f"{i}.pdf").write_bytes(b"%%PDF-%d" % i)
            told.add(f"file:{inbox}/{i}.pdf")
        (inbox / "0.pdf").write_bytes(b"%%PDF-again-%d" % step)
        (inbox / f"{20 * step + 1}.pdf").unlink()
        told.discard(f"file:{inbox}/{20 * step + 1}.pdf")
        found, _ = poll_folder(spark, inbox, tmp_path)
        assert sorted(r.path for r in found.collect()) == sorted(told)
    # A name that is no UTF-8 is read as well.
    with open(b"%s/\xe9.pdf" % str(inbox).encode(), "wb") as file:
        file.write(b"%PDF-latin")
    found, _ = poll_folder(spark, inbox, tmp_path)
    assert [bytes(r.content) for r in found.where("path LIKE '%\ufffd.pdf'").collect()] == [b"%PDF-latin"]


def test_broken_poll_is_done_again(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    for i in range(5):
        (inbox / f"{i}.pdf").write_bytes(b"%PDF-")
    target = tmp_path / "out"
    target.write_text("not a folder, so that the batch fails")
    with pytest.raises(StreamingQueryException):
        poll_folder(spark, inbox, tmp_path)
    target.unlink()
    (inbox / "late.pdf").write_bytes(b"%PDF-")
    poll_folder(spark, inbox, tmp_path)
    paths = sorted(r.path.rsplit("/", 1)[1] for r in read_batches(spark, str(target)).collect())
    assert paths == [*(f"{i}.pdf" for i in range(5)), "late.pdf"]


def test_idle_polls_leave_no_folders(spark, tmp_path):
    inbox = tmp_path / "in"
    inbox.mkdir()
    files = stream_files(spark, str(inbox))
    stream = stream_convert(files, f"{tmp_path}/out", f"{tmp_path}/checkpoint", available_now=False, interval="0 seconds", output_format="text")
    try:
        for count in (1, 2):
            (inbox / f"{count}.pdf").write_bytes(b"%PDF-")
            polls = stream.lastProgress["batchId"] if stream.lastProgress else 0
            until = time.time() + 60
            while time.time() < until and (not stream.lastProgress or stream.lastProgress["batchId"] < polls + 4):
                time.sleep(0.2)
        assert read_batches(spark, f"{tmp_path}/out").count() == 2
        assert len(list((tmp_path / "out").glob("batch=*"))) <= 4
    finally:
        stream.stop()


def test_compaction_bounds_the_files(spark, tmp_path):
    schema = ("job_id string, seq bigint, event_time timestamp_ntz, event string, result_path string, "
              "error_message string")
    rows = [(f"j{i % 5}", i, START + timedelta(seconds=i), ["PENDING", "RUNNING", "COMPLETED"][i // 5 % 3], f"r{i}", None) for i in range(120)]
    declared, out = write_parts(spark, rows, schema, f"{tmp_path}/in", 12), f"{tmp_path}/out"
    stream = stream_job_state(source(spark, f"{tmp_path}/in", declared))
    write_batches(stream, out, f"{tmp_path}/checkpoint", "update", compact_every=4, keys=["job_id"]).awaitTermination()
    folders = sorted(f.name for f in (tmp_path / "out").iterdir() if f.is_dir())
    assert "snapshot=11" in folders and "snapshot=7" in folders and "snapshot=3" not in folders
    # Two snapshots, and the batches that the older one doesn't hold.
    assert "batch=3" not in folders and len(folders) <= 2 + 2 * 4
    assert len(read_batches(spark, out).inputFiles()) <= 4
    columns = ["job_id", "status", "started_at", "completed_at", "result_path"]
    want = fold_job_state(spark.createDataFrame(rows, schema)).select(columns).collect()
    assert sorted(map(repr, latest_job_state(spark, out).select(columns).collect())) == sorted(map(repr, want))
    # A snapshot without its mark is not read, and more batches follow.
    write_parts(spark, [("j9", 500, START, "RUNNING", None, None)], schema, f"{tmp_path}/in", 1)
    (tmp_path / "out" / "snapshot=99").mkdir()
    write_batches(stream, out, f"{tmp_path}/checkpoint", "update").awaitTermination()
    assert {r.job_id for r in latest_job_state(spark, out).collect()} == {*(f"j{i}" for i in range(5)), "j9"}


class Handle:
    """State kept in dicts; counts the slices that are read."""

    def __init__(self):
        self.states, self.reads, self.timers = {}, [], []

    def getValueState(self, name, schema):
        return self.states.setdefault(name, Value())

    getListState = getValueState

    def getMapState(self, name, key, value):
        return self.states.setdefault(name, Slices(self.reads))

    def registerTimer(self, at):
        self.timers.append(at)


class Value:
    value = None

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    put = update

    def clear(self):
        self.value = None


class Slices(dict):
    def __init__(self, reads):
        self.reads = reads

    def containsKey(self, key):
        return key in self

    def getValue(self, key):
        self.reads.append(key[0])
        return self[key]

    def updateValue(self, key, value):
        self[key] = value

    def removeKey(self, key):
        del self[key]


class Clock:
    def __init__(self, ms):
        self.getCurrentWatermarkInMs = self.getExpiryTimeInMs = lambda: ms


def test_sliding_replays_only_touched_slices():
    handle, processor = Handle(), _SlidingLog(60_000_000, "bigint")
    processor.init(handle)
    log = [Row(us=i * 7_000_000, id=i, rate_limit=5) for i in range(4000)]
    list(processor.handleInputRows(("hot",), log, Clock(0)))
    handle.reads.clear()
    # One more request in the middle, over the limit: nothing else changes.
    out = list(processor.handleInputRows(("hot",), [Row(us=14_000_050_000, id=9000, rate_limit=5)], Clock(0)))
    assert len(out) >= 1 and len(handle.reads) <= 8
    handle.reads.clear()
    late = list(processor.handleInputRows(("hot",), [Row(us=5, id=9001, rate_limit=5)], Clock(20_000_000)))
    assert [(r.allowed, r.late) for r in late] == [(None, True)] and not handle.reads
    for at in sorted(handle.timers):
        processor.handleExpiredTimer(("hot",), None, Clock(at))
    assert not handle.states["slices"]


@pytest.mark.parametrize("made", [_FixedWindow, _SlidingLog])
def test_sparse_log_is_few_pages(made):
    """Requests far apart share a page: a batch does not ask once a request."""
    handle, processor = Handle(), made(60_000_000, "bigint")
    processor.init(handle)
    sparse = [Row(us=i * 300_000_000, id=i, rate_limit=2) for i in range(400)]
    for part in (sparse[::2], sparse[1::2], [Row(us=r.us, id=-1 - r.id, rate_limit=2) for r in sparse]):
        handle.reads.clear()
        handle.timers.clear()
        out = list(processor.handleInputRows(("t",), part, Clock(0)))
        assert all(r.allowed for r in out) and len(out) == len(part)
        assert len(handle.reads) <= 1 and len(handle.timers) <= 2
    assert len(handle.states["slices"]) == 2
    over = list(processor.handleInputRows(("t",), [Row(us=300_000_000, id=900, rate_limit=2)], Clock(0)))
    assert [(r.id, r.allowed) for r in over] == [(900, False)]
    assert [r.late for r in processor.handleInputRows(("t",), [Row(us=0, id=901, rate_limit=2)], Clock(10**9))] == [True]
    processor.handleExpiredTimer(("t",), None, Clock(10**9))
    assert not handle.states["slices"]


def test_replay_deals_by_size(spark, tmp_path, monkeypatch):
    rows = [(i, START + timedelta(seconds=i), i % 7, "view", 1.0) for i in range(900)]
    columns = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double"
    spark.createDataFrame(rows, columns).write.parquet(f"{tmp_path}/events.parquet")
    monkeypatch.setattr(streams, "DEALT_BYTES", 1000)
    monkeypatch.setattr(streams, "scratch_path", lambda *_: f"{tmp_path}/dealt")
    view = streams.stream_view(Inputs(spark, str(tmp_path)), "fx_usage", "events", "event_id")
    files = len([*(tmp_path / "dealt").glob("part-*")])
    path = run(view, str(tmp_path))
    batches = read_batches(spark, path).groupBy("batch").count().collect()
    assert files > 6 and len(batches) == 3 and sum(r["count"] for r in batches) == 900


def test_job_state_is_bounded():
    handle, processor = Handle(), _JobState("bigint")
    processor.init(handle)

    def feed(events, mark=0):
        rows = [Row(event_time=START + timedelta(seconds=t), seq=t, event=e, result_path=f"r{t}", error_message=None) for t, e in events]
        return list(processor.handleInputRows(("j",), rows, Clock(mark)))

    feed([(t, ["PENDING", "RUNNING", "FAILED"][t % 3]) for t in range(3000)])
    assert not handle.states["tail"].exists()
    # Before the last outcome only the latest start counts, so nothing changes.
    assert feed([(1500, "CANCEL"), (1501, "COMPLETED")]) == []
    feed([(4000 + t, "RUNNING") for t in range(500)])
    assert len(handle.states["tail"].get()) == 500
    mark = int((START + timedelta(seconds=4400) - datetime(1970, 1, 1)).total_seconds() * 1000)
    feed([(5000, "CANCEL")], mark)
    assert len(handle.states["tail"].get()) <= 101
    (row,) = feed([(5001, "COMPLETED"), (4001, "CANCEL")], mark)
    assert (row.status, row.result_path, row.late_events) == ("COMPLETED", "r5001", 1)


def test_job_state_and_restart(spark, tmp_path):
    rng = random.Random(6)
    schema = ("job_id string, seq bigint, event_time timestamp_ntz, event string, result_path string, "
              "error_message string")
    rows = [
        (f"j{rng.randrange(20)}", i, START + timedelta(seconds=i),
         rng.choice(["PENDING", "RUNNING", "COMPLETED", "FAILED", "CANCEL", "CANCEL"]), f"r{i}", None)
        for i in range(300)
    ]
    half = len(rows) // 2
    declared = write_parts(spark, rows[:half], schema, f"{tmp_path}/in", 2)
    # The second run starts from the checkpoint of the first.
    run(stream_job_state(source(spark, f"{tmp_path}/in", declared)), str(tmp_path), "update")
    write_parts(spark, rows[half:], schema, f"{tmp_path}/in", 1)
    path = run(stream_job_state(source(spark, f"{tmp_path}/in", declared)), str(tmp_path), "update")
    columns = ["job_id", "status", "started_at", "completed_at", "result_path", "error_message"]
    got = sorted(map(tuple, latest_job_state(spark, path).select(columns).collect()))
    # A cancel carries no result of its own.
    log = spark.createDataFrame(rows, schema)
    want = sorted(map(tuple, fold_job_state(log).select(columns).collect()))
    assert got == want


def test_convert_is_idempotent(spark, tmp_path):
    schema = "path string, size bigint, modified timestamp_ntz, content binary"
    contents = [b"%PDF-one", b"", b"plain", b"%PDF-two\fmore"]
    rows = [(f"{i}.pdf", len(c), START, bytearray(c)) for i, c in enumerate(contents)]
    declared = write_parts(spark, rows, schema, f"{tmp_path}/in", 2)
    for _ in range(2):
        stream = source(spark, f"{tmp_path}/in", declared)
        stream_convert(
            stream, f"{tmp_path}/out", f"{tmp_path}/checkpoint", output_format="text"
        ).awaitTermination()
    columns = ["path", "status", "error_message", "source_hash", "content"]
    got = sorted(map(tuple, read_batches(spark, f"{tmp_path}/out").select(columns).collect()))
    want = convert_corpus(spark.createDataFrame(rows, schema), "text").select(columns)
    assert got == sorted(map(tuple, want.collect()))


def test_usage_metrics_close_windows(spark, usage, tmp_path):
    # Shuffled inside a minute, which the delay covers.
    rng = random.Random(2)
    rows = sorted(usage, key=lambda r: r[2] + timedelta(seconds=rng.randrange(60)))
    schema = write_parts(spark, rows, USAGE, f"{tmp_path}/in", 4)
    stream_usage_metrics(
        source(spark, f"{tmp_path}/in", schema), f"{tmp_path}/out", f"{tmp_path}/checkpoint", "2 minutes", "60 seconds"
    ).awaitTermination()
    got = read_batches(spark, f"{tmp_path}/out").drop("batch")
    last = max(r[2] for r in usage) - timedelta(seconds=60)
    want = request_metrics(spark.createDataFrame(rows, USAGE), "2 minutes").withColumn("bucket", F.col("bucket").cast("timestamp_ntz"))
    want = want.where(F.col("bucket") + F.expr("INTERVAL 2 MINUTES") <= F.lit(last)).select(*got.columns)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect())) and got.count() > 8


def test_window_counts(spark, usage, tmp_path):
    schema = write_parts(spark, usage, USAGE, f"{tmp_path}/in", 2)
    counts = stream_window_counts(source(spark, f"{tmp_path}/in", schema))
    path = run(counts.select(F.col("window.start").alias("start"), "token_id", "requests"), str(tmp_path))
    rows = read_batches(spark, path).collect()
    assert rows and sum(r.requests for r in rows) <= len(usage)
