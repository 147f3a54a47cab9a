"""Helpers of the operators: intermediate tables, work on Arrow batches."""

from __future__ import annotations

import pickle
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark import Broadcast, cloudpickle
from pyspark.sql import DataFrame, SparkSession

from docpipe.session import shared_dir

#: Bytes of text that numpy code handles at once, so temporaries stay small.
SLICE_BYTES = 1 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write once to the shared folder and read back. Cuts lineage, survives the
    loss of executors, and gives later joins a known size."""
    path = f"{shared_dir(df.sparkSession).rstrip('/')}/llm-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes tables of ``materialize`` that nothing reads any more: what was
    made of them is written. Shuffle files of finished queries go when the
    driver collects its garbage, so that is asked for as well."""
    for df in tables:
        jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
        for folder in {f.rpartition("/")[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(folder))
            path.getFileSystem(conf).delete(path, True)
        jvm.System.gc()


#: Spark's run-time join filters: a Bloom filter of at most 8 MB, made of the
#: smaller side's keys whatever its size, on any scan. Beyond about 4 million
#: keys it holds fewer rows back; the join after it is exact at any size.
FILTERED = {
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1t",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "0",
    "spark.sql.optimizer.runtime.bloomFilter.maxNumBits": str(1 << 26),
}


@contextmanager
def filtered_joins(spark: SparkSession):
    """Queries that run inside filter the larger side of a selective join
    before it is shuffled. The session's own settings come back afterwards."""
    before = {key: spark.conf.get(key, None) for key in FILTERED}
    for key, value in FILTERED.items():
        spark.conf.set(key, value)
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value) if value is not None else spark.conf.unset(key)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions", "200"))


def slices(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``limit`` bytes of text; a longer text
    is a batch of its own."""
    for batch in batches:
        lengths = pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0).to_pylist()
        start = size = 0
        for i, n in enumerate(lengths):
            if size and size + n > limit:
                yield batch.slice(start, i - start)
                start, size = i, 0
            size += n
        if len(lengths) > start:
            yield batch.slice(start)


def share(spark: SparkSession, value) -> Broadcast:
    """Broadcasts an object of this package, with its class, so that workers
    need not have the package."""
    return spark.sparkContext.broadcast({"packed": cloudpickle.dumps(value)})


def once(held: Broadcast, build: Callable | None = None):
    """The shared object, or what ``build`` makes of it; made once in a worker
    process, which keeps broadcast values from task to task."""
    kept = held.value
    if "made" not in kept:
        value = pickle.loads(kept["packed"])
        kept["made"] = build(value) if build else value
    return kept["made"]
