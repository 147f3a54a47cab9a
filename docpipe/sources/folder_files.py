"""New files of a folder as a stream whose driver keeps nothing of any file.

Each micro-batch is a poll: one task writes the names of the folder's files to
a file of the shared folder, some thousands at a time, and tells them. A task
that is tried again tells what that file has, so all of a batch sees the same
names. Which of them are new is state of the stream; their contents are read by
the tasks that hold it.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, functions as F

#: Names of one batch of a listing.
NAMES = 4096
#: Bytes of contents after which a task hands on what it has read.
READ_BYTES = 1 << 22
#: A file as it is read; ``modified`` in milliseconds.
READ = "path string, size bigint, modified bigint, content binary"


def _hidden(name: bytes) -> bool:
    """The names that Spark's readers leave out."""
    return name.startswith(b".") or name.startswith(b"_") and b"=" not in name or name.endswith(b"._COPYING_")


def _names(folder: str, pattern: str | None, recursive: bool) -> Iterator[bytes]:
    """Files of a folder, and of those in it called ``key=value``."""
    import os
    import re

    wanted = re.compile(pattern, re.DOTALL).fullmatch if pattern else None
    left = [top := os.fsencode(folder)]
    while left:
        try:
            entries = os.scandir(at := left.pop())
        except FileNotFoundError:
            if at == top:
                raise
            continue
        with entries:
            for entry in entries:
                if _hidden(entry.name):
                    continue
                if entry.is_dir():
                    if recursive or b"=" in entry.name:
                        left.append(entry.path)
                elif entry.is_file() and (wanted is None or wanted(entry.name.decode("utf-8", "replace"))):
                    yield entry.path


def _write_listing(listing: str, before: str, names: Iterator[bytes]) -> None:
    """Writes the names, or none if they are those of the poll before."""
    import os
    import uuid
    from itertools import islice

    import pyarrow as pa

    schema, count, total, part = pa.schema([("name", pa.binary())]), 0, 0, f"{listing}.{uuid.uuid4().hex}"
    with pa.OSFile(part, "wb") as out, pa.ipc.new_stream(out, schema) as log:
        while some := list(islice(names, NAMES)):
            log.write_batch(pa.record_batch([pa.array(some, pa.binary())], schema=schema))
            count, total = count + len(some), (total + sum(map(hash, some))) % (1 << 64)
    told = f"{count} {total}"
    if os.path.exists(f"{before}.sum"):
        with open(f"{before}.sum") as file:
            if file.read() == told:
                with pa.OSFile(part, "wb") as out:
                    pa.ipc.new_stream(out, schema).close()
    with open(f"{part}.sum", "w") as file:
        file.write(told)
    os.replace(f"{part}.sum", f"{listing}.sum")
    if os.path.exists(listing):
        os.unlink(part)
    else:
        os.replace(part, listing)


def _poll(folder: str, log: str, pattern: str | None, recursive: bool):
    """The task of a poll: a batch of one row gives the names of the folder."""

    def told(ticks: Iterator) -> Iterator:
        import os

        import pyarrow as pa

        if not any(tick.num_rows for tick in ticks):
            return
        context = TaskContext.get()
        home, number = f"{log}/{context.getLocalProperty('sql.streaming.queryId')}", int(context.getLocalProperty("streaming.sql.batchId"))
        listing = f"{home}/{number}"
        if not os.path.exists(listing):
            os.makedirs(home, exist_ok=True)
            _write_listing(listing, f"{home}/{number - 1}", _names(folder, pattern, recursive))
            # Its batch is done: nothing reads it again.
            if os.path.exists(f"{home}/{number - 1}"):
                os.unlink(f"{home}/{number - 1}")
        with pa.OSFile(listing) as source:
            yield from pa.ipc.open_stream(source)

    return told


def _read(batches: Iterator) -> Iterator:
    """The files of names, but for those that are empty or gone since."""
    import os

    import pyarrow as pa

    kinds = [pa.string(), pa.int64(), pa.int64(), pa.binary()]
    columns = ["path", "size", "modified", "content"]

    def told(rows: list[tuple]):
        values = zip(*rows) if rows else [[]] * len(columns)
        return pa.record_batch([pa.array(v, k) for v, k in zip(values, kinds)], names=columns)

    rows, held = [], 0
    for batch in batches:
        for name in batch.column(0).to_pylist():
            try:
                with open(name, "rb") as file:
                    content, at = file.read(), os.fstat(file.fileno()).st_mtime_ns // 1_000_000
            except FileNotFoundError:
                continue
            if content:
                rows.append((f"file:{name.decode('utf-8', 'replace')}", len(content), at, content))
                held += len(content)
            if held >= READ_BYTES:
                yield told(rows)
                rows, held = [], 0
    yield told(rows)


def stream_folder_files(spark: SparkSession, folder: str, log: str, glob: str | None, recursive: bool) -> DataFrame:
    """New files of a folder that all machines have at the same place, as
    ``path, size, modified, content``; ``log`` is such a folder too. Every
    trigger polls, so one that finds nothing is a batch without rows."""
    pattern = None
    if glob is not None:
        pattern = spark.sparkContext._jvm.org.apache.hadoop.fs.GlobPattern(glob).compiled().toString()
    ticks = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
    names = ticks.select("value").mapInArrow(_poll(folder, log, pattern, recursive), "name binary").dropDuplicates(["name"])
    return names.mapInArrow(_read, READ).withColumn("modified", F.timestamp_millis("modified").cast("timestamp_ntz"))
