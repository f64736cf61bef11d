"""Session settings this library relies on."""

from __future__ import annotations

import atexit
import os
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}


def local_session(
    cores: int | str = 8, shuffle_partitions: int = 8, memory: str = "8g", more: dict[str, str] | None = None
) -> SparkSession:
    """A local session for tests and the benchmark. On a cluster use the cluster's own session."""
    builder = SparkSession.builder.master(f"local[{cores}]").appName("claimlens")
    for key, value in {**SETTINGS, **(more or {})}.items():
        builder = builder.config(key, value)
    spark = (
        builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def workers_see_library(spark: SparkSession) -> None:
    """Let Python workers import this package from the folder it was imported from.

    On a cluster without that folder the package is installed or sent with --py-files as usual.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    workers = spark.sparkContext.environment
    if root not in workers.get("PYTHONPATH", "").split(":"):
        workers["PYTHONPATH"] = ":".join(p for p in (workers.get("PYTHONPATH", ""), root) if p)


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder of the cluster; a scratch folder only for local runs without one."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        folder = configured
    elif re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        folder = _local.setdefault(spark.sparkContext.applicationId, None) or tempfile.mkdtemp(prefix="claimlens-checkpoint-")
        _local[spark.sparkContext.applicationId] = folder
    else:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


_local: dict[str, str | None] = {}


def _scratch_root(spark: SparkSession) -> str:
    return f"{ensure_checkpoint_dir(spark)}/claimlens-{spark.sparkContext.applicationId}"


def scratch_folder(spark: SparkSession) -> str:
    """A new folder name beside the checkpoints, which all executors share.

    All such folders of a session lie in one place, which :func:`clear_scratch` deletes; that happens at the
    latest when Python ends while the session still runs.
    """
    if not _cleaning:
        _cleaning.append(True)
        atexit.register(_clear_at_exit)
    return f"{_scratch_root(spark)}/{uuid.uuid4().hex}"


_cleaning: list[bool] = []


def clear_scratch(spark: SparkSession) -> None:
    """Delete the session's stored frames. Frames that read them can't be used afterwards."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_scratch_root(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _clear_at_exit() -> None:
    spark = SparkSession.getActiveSession()
    if spark is not None and spark.sparkContext._jsc is not None:
        clear_scratch(spark)


#: Deletes the shuffle files of a job when it ends, instead of when the driver happens to collect garbage.
SHUFFLES_END = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_ending: dict[str, object] = {"writes": 0, "before": None}
_ending_lock = threading.Lock()


@contextmanager
def _shuffles_end_with_the_write(spark: SparkSession) -> Iterator[None]:
    """Set ``SHUFFLES_END`` while any thread writes, then give the session its own setting back."""
    with _ending_lock:
        if not _ending["writes"]:
            _ending["before"] = spark.conf.get(SHUFFLES_END, None)
            spark.conf.set(SHUFFLES_END, "true")
        _ending["writes"] += 1
    try:
        yield
    finally:
        with _ending_lock:
            _ending["writes"] -= 1
            if not _ending["writes"]:
                if _ending["before"] is None:
                    spark.conf.unset(SHUFFLES_END)
                else:
                    spark.conf.set(SHUFFLES_END, _ending["before"])


def stored(df: DataFrame, by: str | None = None) -> DataFrame:
    """Write a frame that is read many times as a parquet table and read it back.

    ``by`` names a column with few values that gets a folder for each, so a filter on it reads its rows only.

    Unlike a cache it outlives lost executors, and unlike a checkpoint later reads are pruned to
    the columns they need. The write's shuffle files go when it ends: the table stands for them.
    """
    folder = scratch_folder(df.sparkSession)
    with _shuffles_end_with_the_write(df.sparkSession):
        (df.write.partitionBy(by) if by else df.write).parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)
