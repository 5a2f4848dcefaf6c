"""Session settings the library relies on."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings that change results or that the scale design counts on.
RESULT_SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
}
SCALE_SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
}
STATE_STORE = {
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def create_session(app_name: str = "rtshop", master: str | None = None, **extra: str) -> SparkSession:
    """Build a session with the settings above. ``extra`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    settings = {**RESULT_SETTINGS, **SCALE_SETTINGS, **STATE_STORE}
    settings.update({key.replace("__", "."): value for key, value in extra.items()})
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the result settings to a session made elsewhere."""
    for key, value in RESULT_SETTINGS.items():
        spark.conf.set(key, value)
    return spark


# Whether the files of a shuffle go when the action that wrote them ends. Else they stay until the driver collects its
# garbage, so that steps of a job which follow each other hold the disk of all of them.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_dropped(spark: SparkSession) -> Iterator[None]:
    """Actions that begin in here leave no shuffle files. For frames that are computed once; cached ones keep theirs."""
    before = spark.conf.get(DROP_SHUFFLES, "false")
    spark.conf.set(DROP_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(DROP_SHUFFLES, before)


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, for written intermediate tables and checkpoints.

    It is the one the cluster names in ``spark.checkpoint.dir``. Where that is unset, a temporary folder is made for
    a local master, as in tests; on a cluster this raises, since each machine would write to its own disk. What is
    written there belongs to the caller, who empties it when no reader is left.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
    made = tempfile.mkdtemp(prefix="rtshop-")
    spark.conf.set("spark.checkpoint.dir", made)
    return made
