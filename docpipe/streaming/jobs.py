"""Job state and conversion on streams."""

from __future__ import annotations

import os
from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Row, SparkSession, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.types import StructType

from docpipe.plans.convert import convert_corpus
from docpipe.schemas import CANCELLABLE_STATUSES, TERMINAL_STATUSES
from docpipe.session import scratch_path
from docpipe.sources.blobs import qualified_path
from docpipe.sources.folder_files import stream_folder_files
from docpipe.streaming.sink import latest_rows, read_batches, write_batches

STATE = "status string, started_at timestamp_ntz, completed_at timestamp_ntz, result_path string, error_message string"


def _order(event: tuple) -> tuple:
    """Place of an event in its job's log: (event_time, seq), nulls first."""
    at, seq = event[:2]
    return (at is not None, at), (seq is not None, seq)


def _fold(state: tuple, events: list[tuple]) -> tuple:
    """State of a job after more events, which are in order."""
    status, started, completed, result, error = state
    for at, _, event, path, message in events:
        if event == "CANCEL":
            if status not in CANCELLABLE_STATUSES:
                continue
            event = "CANCELLED"
        status = event
        if event == "RUNNING":
            started = at
        elif event in TERMINAL_STATUSES:
            completed, result, error = at, path, message
    return status, started, completed, result, error


class _JobState(StatefulProcessor):
    """What a job's log comes to, in a few values and a short tail.

    An outcome (COMPLETED, FAILED, CANCELLED) takes effect whatever came
    before, so of the events up to the last of them only the latest start
    counts. Events after it are kept, as a CANCEL depends on the one before.
    Those that the watermark has passed are folded to one state as well; a late
    event that belongs among them is counted, and may still be the latest start."""

    def __init__(self, seq_type: str):
        self.seq_type = seq_type

    def init(self, handle: StatefulProcessorHandle) -> None:
        place = f"event_time timestamp_ntz, seq {self.seq_type}"
        # The state after the folded events, the place of the last of them, and
        # whether that is an outcome, before which nothing matters.
        self.folded = handle.getValueState("folded", f"{STATE}, {place}, is_outcome boolean")
        self.rest = handle.getValueState("rest", f"started_at timestamp_ntz, late_events bigint, {', '.join(f'shown_{c}' for c in STATE.split(', '))}")
        self.tail = handle.getListState("tail", f"{place}, event string, result_path string, error_message string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        mark_ms = timerValues.getCurrentWatermarkInMs()
        mark = (True, datetime(1970, 1, 1) + timedelta(milliseconds=mark_ms)) if mark_ms > 0 else None
        folded = tuple(self.folded.get()) if self.folded.exists() else None
        started, late, *shown = self.rest.get() if self.rest.exists() else (None, 0, *(None,) * 5)
        tail = [tuple(e) for e in self.tail.get()] if self.tail.exists() else []
        last = _order(folded[5:7]) if folded else None
        for r in rows:
            event = (r.event_time, r.seq, r.event, r.result_path, r.error_message)
            if r.event == "RUNNING" and r.event_time is not None and (started is None or r.event_time > started):
                started = r.event_time
            if last is None or _order(event) > last:
                tail.append(event)
            elif not folded[7]:
                late += 1
        tail.sort(key=_order)
        final = max((i for i, e in enumerate(tail) if e[2] in TERMINAL_STATUSES), default=-1)
        closed = final + 1
        while mark and closed < len(tail) and _order(tail[closed])[0] < mark:
            closed += 1
        if closed:
            folded = (*_fold(folded[:5] if folded else (None,) * 5, tail[:closed]), *tail[closed - 1][:2], closed == final + 1)
            self.folded.update(folded)
            tail = tail[closed:]
        status, _, completed, result, error = _fold(folded[:5] if folded else (None,) * 5, tail)
        after = (status, started, completed, result, error)
        if tail:
            self.tail.put(tail)
        else:
            self.tail.clear()
        self.rest.update((started, late, *after))
        if after != tuple(shown):
            yield Row(job_id=key[0], status=status, started_at=started, completed_at=completed, result_path=result,
                      error_message=error, late_events=late)

    def close(self) -> None:
        pass


def stream_job_state(events: DataFrame, delay: str | None = None) -> DataFrame:
    """Changed job rows per micro-batch (update mode), in whatever order and
    batches the events arrive; ``late_events`` counts those that came too late.

    A job's state is its last outcome and the events since then. With a
    ``delay`` only those of them that the watermark hasn't passed are kept.
    Without one all are, and no event is late: any order of events gives the
    state of `fold_job_state`."""
    schema = StructType([events.schema["job_id"], *StructType.fromDDL(f"{STATE}, late_events bigint").fields])
    processor = _JobState(events.schema["seq"].dataType.simpleString())
    slim = events.select("job_id", "seq", "event_time", "event", "result_path", "error_message")
    if delay is None:
        return slim.groupBy("job_id").transformWithState(processor, schema, "update", "none")
    timed = slim.withColumn("mark", F.col("event_time").cast("timestamp")).withWatermark("mark", delay).drop("mark")
    return timed.groupBy("job_id").transformWithState(processor, schema, "update", "eventTime")


def latest_job_state(spark, path: str) -> DataFrame:
    """Last written row of each job."""
    return latest_rows(read_batches(spark, path), ["job_id"]).drop("batch")


def stream_convert(files: DataFrame, path: str, checkpoint: str, available_now: bool = True,
                   interval: str = "10 seconds", **options) -> StreamingQuery:
    """Converts a stream of files with `convert_corpus`. Bad files are FAILED
    rows; they do not stop the stream.

    An outcome is keyed by (path, source_hash), nulls being equal: a file that
    comes twice in a batch, or again in a later one, adds no row. The keys are
    state of the stream, kept on the executors by their hash, so a batch looks
    up its own files and reads nothing of what was written before."""
    outcomes = convert_corpus(files, **options).dropDuplicates(["path", "source_hash"])
    return write_batches(outcomes, path, checkpoint, available_now=available_now, interval=interval, drop_empty=True)


FILES = "path string, modificationTime timestamp, length bigint, content binary"
MANIFEST = "path string, size bigint, modified timestamp_ntz"


def _local_path(spark: SparkSession, path: str) -> str | None:
    """The path as the operating system has it; None for those of other stores."""
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    store = location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    uri = store.makeQualified(location).toUri()
    return uri.getPath() if uri.getScheme() == "file" else None


def _polled(spark: SparkSession, folder: str) -> tuple[str, str] | None:
    """Folder and place of the listings, if executors can list and read it."""
    if any(c in folder for c in "{}[]*?\\") or not ((inbox := _local_path(spark, folder)) and os.path.isdir(inbox)):
        return None
    try:
        log = _local_path(spark, scratch_path(spark, "listings"))
    except ValueError:
        return None
    return (inbox, log) if log else None


def stream_files(spark: SparkSession, folder: str, manifests: str | None = None, glob: str | None = None,
                 recursive: bool = False, max_files: int | None = None) -> DataFrame:
    """The files that appear in a folder, as a stream of file rows ``path, size,
    modified, content``; each poll gives the new ones, ``max_files`` at most.

    A folder of a file system that all machines mount is polled by
    `stream_folder_files`, if the shared folder is on one too: the driver keeps
    nothing of a file. Other stores, patterns of folders and ``max_files`` take
    Spark's file source, for which the driver lists all files, remembers them
    and plans with those of a poll: 300,000 new ones fill a heap of 750 MB. A
    checkpoint of one of the two sources can't be continued with the other.

    Spark's reader never returns empty files and names that start with an
    underscore or a dot. They come from ``manifests``, a folder of Parquet files
    ``path, size, modified`` that is watched as well: the entries that the
    reader would leave out become rows with null content, the others are left
    to the reader, so a file is not told twice. An entry listed again is."""
    if max_files is None and (polled := _polled(spark, folder)):
        found = stream_folder_files(spark, *polled, glob, recursive)
    else:
        reader = spark.readStream.format("binaryFile").schema(FILES)
        for name, value in (("pathGlobFilter", glob), ("recursiveFileLookup", recursive and "true"), ("maxFilesPerTrigger", max_files)):
            if value:
                reader = reader.option(name, str(value))
        found = reader.load(folder).select(
            "path", F.col("length").alias("size"), F.col("modificationTime").cast("timestamp_ntz").alias("modified"), "content")
    if manifests is None:
        return found
    listed = spark.readStream.schema(MANIFEST).parquet(manifests).withColumn("path", qualified_path(spark, F.col("path")))
    unread = (F.coalesce("size", F.lit(0)) == 0) | F.element_at(F.split("path", "/"), -1).rlike("^[_.]")
    return found.unionByName(listed.where(unread).withColumn("content", F.lit(None).cast("binary")))
