"""Daily active devices as a stream (A1, A10, K5)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from rtshop.operators.logs import device_rows, first_page_views, normalize_logs, rejected_devices
from rtshop.schemas import DAU_COLUMNS
from rtshop.sinks.batches import save_daily
from rtshop.streaming.runtime import keep_rejects, start_job

# How long after its last record's arrival a device is remembered, and how far behind a source partition may be.
SEEN_FOR = "24 hours"
ARRIVAL = ("timestamp", "partition", "offset")


def dau_stream(records: DataFrame, strict: bool = False, seen_for: str = SEEN_FOR) -> DataFrame:
    """A1: each device once per day, with the view that arrived first. For update mode.

    The clock is the arrival of records, never the time a client claims: a device with a wrong clock is a row of a
    strange day and ages nothing. State is one row per device, day and day of arrival, and holds the first view; rows
    are combined before they are shuffled, so a busy device needs no salt. A key is passed on in the batch that first
    met it: there the first and the last moment it was met are the same.
    """
    views = first_page_views(normalize_logs(records, strict)).observe(
        "first_page_views", F.count(F.lit(1)).alias("cnt"))
    payload = [name for name in DAU_COLUMNS if name not in ("dt", "mid")]
    rows = device_rows(views).select(*DAU_COLUMNS, *ARRIVAL, F.current_timestamp().alias("met"))
    rows = rows.withWatermark("timestamp", seen_for)
    met = rows.groupBy(F.window("timestamp", "1 day"), "dt", "mid").agg(
        F.min(F.struct(*ARRIVAL, *payload)).alias("first"), F.min("met").alias("since"),
        F.max("met").alias("now"))
    return met.filter("since = now").select(
        *[F.col(name) if name in ("dt", "mid") else F.col(f"first.{name}").alias(name) for name in DAU_COLUMNS])


def run_dau(records: DataFrame, table: str, checkpoint: str, interval: str | None = "5 seconds",
            strict: bool = False, partitions: int | None = None, seen_for: str = SEEN_FOR,
            rejects: str | None = None, progress: str | None = None) -> StreamingQuery:
    """K5: keep the day table of active devices; its key is ``mid``, and the first save of a key is the one to read.

    ``rejects`` is a folder for records that cannot be read or name no device, ``progress`` one for lines about batches.
    """
    keep_rejects(rejected_devices(records), rejects, checkpoint, "dau", interval)
    return start_job(dau_stream(records, strict, seen_for), lambda batch, batch_id: save_daily(batch, table, batch_id),
                     checkpoint, "dau", interval, partitions, mode="update", strict=strict, progress=progress)
