"""Batch-keyed writers for topics, changelogs and day tables (K1-K6)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rtshop.session import shuffles_dropped

# Half the size of Spark's default or less where values are in order, at the same speed.
CODEC = "zstd"


def replace_batch(df: DataFrame, path: str, batch_id: int, folders: Sequence[str]) -> None:
    """Write ``df`` as the only content of this batch; other batches stay.

    A repeated batch first loses what it wrote before, in all folders: it may have no rows for some of them now.
    """
    spark = df.sparkSession
    old = spark._jvm.org.apache.hadoop.fs.Path("/".join([path, *[f"{name}=*" for name in folders],
                                                         f"_batch_id={int(batch_id)}"]))
    files = old.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    for status in files.globStatus(old) or ():
        files.delete(status.getPath(), True)
    with shuffles_dropped(spark):
        (df.withColumn("_batch_id", F.lit(batch_id).cast("bigint")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy(*folders, "_batch_id").parquet(path, compression=CODEC))


def save_daily(df: DataFrame, path: str, batch_id: int) -> None:
    """K4-K6: save rows under their ``dt``. Reading with ``daily_table`` shows the last save of each key.

    ``_order`` settles which of two rows of a key in one batch is the last: the one that arrived later where the rows
    have an ``offset``, else that of the larger hash, so that repeated reads and repeated batches agree. Rows of a day come
    to few tasks, a large day to as many as its size asks for: files do not multiply with the tasks that hold the rows.
    """
    order = F.col("offset") if "offset" in df.columns else F.xxhash64(*df.columns)
    replace_batch(df.withColumn("_order", order).hint("rebalance", "dt"), path, batch_id, ["dt"])


def save_rejects(records: DataFrame, path: str, batch_id: int) -> None:
    """Save records that a job leaves out, as they came."""
    replace_batch(records, path, batch_id, [])


def with_partition(messages: DataFrame, partitions: int) -> DataFrame:
    """K1, K2: topic partition of each message: the same for equal keys, spread for messages without a key."""
    keyed = F.pmod(F.xxhash64("key"), F.lit(partitions))
    return messages.withColumn("partition", F.when(F.col("key").isNotNull(), keyed).otherwise(
        F.pmod(F.xxhash64("value"), F.lit(partitions))).cast("int"))


def write_topic_files(messages: DataFrame, path: str, batch_id: int, partitions: int = 4) -> None:
    """K1, K2 without a broker: Parquet files of the record shape, in the ``topic_folder`` of each topic.

    Tasks write what they hold; nothing is shuffled, so a topic or key with most messages has no task of its own.
    """
    rows = with_partition(messages, partitions)
    if "offset" not in rows.columns:
        rows = rows.withColumn("offset", F.lit(None).cast("bigint"))
    if "timestamp" not in rows.columns:
        rows = rows.withColumn("timestamp", F.current_timestamp())
    rows = rows.select("key", "value", "topic", "partition", "offset", "timestamp", F.col("topic").alias("_topic"))
    replace_batch(rows, path, batch_id, ["_topic"])


def topic_folder(path: str, topic: str) -> str:
    """Folder of one topic below the path given to ``write_topic_files``."""
    return f"{path}/_topic={topic}"


def write_topics(messages: DataFrame, servers: str) -> None:
    """K1, K2: publish ``topic, key, value``; the broker client places equal keys in one partition."""
    (messages.select("topic", "key", "value").write.format("kafka")
     .option("kafka.bootstrap.servers", servers).option("kafka.enable.idempotence", "true").save())
