"""Session settings and the shared folder used for intermediate tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession

#: Settings every docpipe session wants. AQE sizes the shuffles and splits
#: skewed join partitions at run time, so no partition count is fixed here.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}

#: Sizes that a session may set itself. Sorted keys shrink by a factor of twenty
#: and more on their way, so 64 MB of them are gigabytes in a task's maps and
#: sorts. Small files cost little to open; at 4 MB each a task had but 32 of
#: them, and a listing in 10,000 tasks a file or two.
SIZES = {
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "8m",
    "spark.sql.files.openCostInBytes": "256k",
    "spark.sql.sources.parallelPartitionDiscovery.parallelism": "256",
}

#: Needed by the streaming operators only.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def build_session(app_name: str = "docpipe", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **SIZES, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def set_sizes(spark: SparkSession) -> None:
    """Gives a session the sizes that it has not set."""
    for key, value in SIZES.items():
        if spark.conf.get(key, None) is None:
            spark.conf.set(key, value)


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and all executors can reach: the one the cluster
    names in ``spark.checkpoint.dir``, or the session's checkpoint folder. Only
    a local master, which has one machine, gets a temporary folder where none
    is set; elsewhere that is an error, as executors could not read each
    other's part."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base:
        return base
    master = spark.sparkContext.master
    if not (master == "local" or master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = tempfile.mkdtemp(prefix="docpipe-")
    spark.sparkContext.setCheckpointDir(base)
    return base


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark).rstrip('/')}/docpipe-{label}-{uuid.uuid4().hex}"
