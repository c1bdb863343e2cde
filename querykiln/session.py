"""Session helpers: the settings the jobs rely on, and the shared scratch folder."""

from __future__ import annotations

import atexit
import functools
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# AQE does the run-time work these jobs count on: size-checked broadcast joins,
# splitting of skewed join partitions and coalescing of small shuffle partitions.
DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    # Stream state on local disk with changelogs in the checkpoint, not in executor memory.
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
}


def build_session(app: str = "querykiln", master: str | None = None,
                  shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """Session with the defaults above; on a cluster leave `master` to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession, purpose: str) -> str:
    """A new folder below `spark.checkpoint.dir`, the storage every executor can reach.

    Where the session names none, a temporary folder serves a local master until the process
    ends; a cluster needs the setting, since its executors do not share a local disk.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local_scratch()
    return f"{base.rstrip('/')}/querykiln/{purpose}-{uuid.uuid4().hex}"


def kept(rows: DataFrame, purpose: str) -> DataFrame:
    """`rows` written to the shared storage and read back: what follows does not compute them again."""
    path = shared_folder(rows.sparkSession, purpose)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


@functools.cache
def _local_scratch() -> str:
    folder = tempfile.mkdtemp(prefix="querykiln-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder
