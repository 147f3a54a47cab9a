"""Starting streams, writing their batches and keeping them few."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from docpipe.session import STATE_STORE

STATE_STORE_KEY = "spark.sql.streaming.stateStore.providerClass"
#: A stream has a store for each shuffle partition and step with state; space
#: set aside for each is more than what most of them hold.
SET_ASIDE = "spark.sql.streaming.stateStore.rocksdb.allowFAllocate"


def write_batches(
    stream: DataFrame, path: str, checkpoint: str, output_mode: str = "append",
    transform: Callable[[DataFrame], DataFrame] | None = None, available_now: bool = True,
    interval: str = "10 seconds", compact_every: int | None = None, keys: Sequence[str] | None = None,
    drop_empty: bool = False,
) -> StreamingQuery:
    """Writes each micro-batch to ``path/batch=N``, replacing what an earlier
    try of the same batch left there: a replayed batch changes nothing. What
    is written is not read again, unless every ``compact_every`` batches by
    `compact_batches`. With ``drop_empty`` a batch without rows leaves no folder
    beside others."""
    spark = stream.sparkSession
    spark.conf.set(STATE_STORE_KEY, STATE_STORE)
    spark.conf.set(SET_ASIDE, "false")

    def write(batch: DataFrame, batch_id: int) -> None:
        snapshot, _ = _written(batch.sparkSession, path)
        if snapshot is not None and batch_id <= snapshot:
            return
        rows = transform(batch) if transform is not None else batch
        target = f"{path.rstrip('/')}/batch={batch_id}"
        rows.write.mode("overwrite").parquet(target)
        if drop_empty and len(_written(batch.sparkSession, path)[1]) > 1 and batch.sparkSession.read.parquet(target).isEmpty():
            location, store = _folder(batch.sparkSession, target)
            store.delete(location, True)
        if compact_every and batch_id % compact_every == compact_every - 1:
            compact_batches(batch.sparkSession, path, keys)

    writer = stream.writeStream.foreachBatch(write).outputMode(output_mode).option(
        "checkpointLocation", checkpoint
    )
    trigger = {"availableNow": True} if available_now else {"processingTime": interval}
    return writer.trigger(**trigger).start()


def _folder(spark: SparkSession, path: str):
    """The Java path and its file system."""
    location = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return location, location.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def _written(spark: SparkSession, path: str) -> tuple[int | None, list[int]]:
    """The last batch of the newest whole snapshot, and all batches that have a
    folder. A snapshot is whole once Spark's commit put its mark there, which
    is the one step in which readers go over to it."""
    location, store = _folder(spark, path)
    if not store.exists(location):
        return None, []
    names = [f.getPath().getName() for f in store.listStatus(location)]
    numbers = {kind: sorted(int(n.partition("=")[2]) for n in names if n.startswith(f"{kind}=")) for kind in ("snapshot", "batch")}
    for number in reversed(numbers["snapshot"]):
        mark, _ = _folder(spark, f"{path.rstrip('/')}/snapshot={number}/_SUCCESS")
        if store.exists(mark):
            return number, numbers["batch"]
    return None, numbers["batch"]


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """All written batches, with the number of each in ``batch``: the newest
    snapshot and the batches after it."""
    base = path.rstrip("/")
    snapshot, batches = _written(spark, path)
    tail = [f"{base}/batch={n}" for n in batches if snapshot is None or n > snapshot]
    parts = []
    if snapshot is not None:
        parts.append(spark.read.parquet(f"{base}/snapshot={snapshot}"))
    if tail or not parts:
        rows = spark.read.option("basePath", base).parquet(*tail) if tail else spark.read.option("basePath", base).parquet(f"{base}/batch=*")
        parts.append(rows.withColumn("batch", F.col("batch").cast("bigint")))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def latest_rows(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The row of each key from its last batch; ``batch`` stays."""
    fields = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*fields), "batch").alias("__row")).select(*keys, "__row.*")


def compact_batches(spark: SparkSession, path: str, keys: Sequence[str] | None = None, keep: int = 1) -> None:
    """Writes a snapshot of all batches so far and deletes what it replaces but
    for the ``keep`` snapshots before it and their batches, which readers that
    began earlier may still read. With ``keys`` only the last row of each key
    stays. The stream that writes the batches calls it between two of them, or
    it runs while the stream is stopped."""
    base = path.rstrip("/")
    snapshot, batches = _written(spark, path)
    if not batches or batches[-1] == snapshot:
        return
    rows = read_batches(spark, path)
    rows = latest_rows(rows, keys) if keys else rows.hint("rebalance")
    rows.write.mode("overwrite").parquet(f"{base}/snapshot={batches[-1]}")
    location, store = _folder(spark, path)
    names = [f.getPath().getName() for f in store.listStatus(location)]
    old = sorted(int(n.partition("=")[2]) for n in names if n.startswith("snapshot="))[: -1 - keep]
    for number in old:
        store.delete(_folder(spark, f"{base}/snapshot={number}")[0], True)
    for number in batches:
        if old and number <= old[-1] or keep == 0:
            store.delete(_folder(spark, f"{base}/batch={number}")[0], True)
