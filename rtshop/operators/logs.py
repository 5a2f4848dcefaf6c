"""Application logs to daily active devices."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rtshop.functions.parsing import with_parsed
from rtshop.functions.scalars import day_of_millis, hour_of_millis
from rtshop.schemas import APP_LOG, CORRUPT, DAU_COLUMNS


def _is_readable() -> Column:
    log = F.col("_log")
    return log.isNotNull() & log[CORRUPT].isNull() & log["ts"].try_cast("bigint").isNotNull()


def normalize_logs(records: DataFrame, strict: bool = False) -> DataFrame:
    """Parse log messages and add ``ts, dt, hr``; other columns of the records are kept.

    Malformed messages and messages without a time are left out (see ``rejected_logs``); with ``strict`` they raise.
    """
    parsed = with_parsed(records, APP_LOG, "_log")
    if strict:
        ts = F.when(_is_readable(), F.col("_log.ts").try_cast("bigint")).otherwise(
            F.raise_error(F.concat(F.lit("unreadable log record: "), F.coalesce("value", F.lit("null")))))
    else:
        parsed = parsed.filter(_is_readable())
        ts = F.col("_log.ts").try_cast("bigint")
    kept = [F.col(f"`{name}`") for name in records.columns if name != "value"]
    rows = parsed.select(*kept, F.col("_log.common").alias("common"), F.col("_log.page").alias("page"),
                         ts.alias("ts"))
    return rows.withColumns({"dt": day_of_millis(F.col("ts")), "hr": hour_of_millis(F.col("ts"))})


def rejected_logs(records: DataFrame) -> DataFrame:
    """The records that ``normalize_logs`` leaves out, as they came."""
    return with_parsed(records, APP_LOG, "_log").filter(~_is_readable()).drop("_log")


def rejected_devices(records: DataFrame) -> DataFrame:
    """The records that the device table leaves out though they should be in it: unreadable ones, and views that open
    a session without naming a device."""
    page = F.col("_log.page")
    opens = page.isNotNull() & (F.coalesce(page["last_page_id"], F.lit("")) == "")
    nameless = opens & F.col("_log.common.mid").isNull()
    parsed = with_parsed(records, APP_LOG, "_log")
    return parsed.filter(~_is_readable() | F.coalesce(nameless, F.lit(False))).drop("_log")


def first_page_views(logs: DataFrame) -> DataFrame:
    """page views that open a session: a page is present and names no page before it."""
    return logs.filter(F.col("page").isNotNull() & (F.coalesce(F.col("page.last_page_id"), F.lit("")) == ""))


def device_rows(logs: DataFrame) -> DataFrame:
    """P5: flat device rows. Rows without a device are dropped here, so null never becomes a shuffle key."""
    extra = [F.col(name) for name in logs.columns if name not in ("common", "page", "ts", "dt", "hr")]
    flat = logs.select("common.mid", "common.uid", "common.ar", "common.ch", "common.vc", "dt", "hr", "ts", *extra)
    return flat.filter(F.col("mid").isNotNull())


def daily_active_devices(logs: DataFrame, arrival: Sequence[str] = ("ts",),
                         columns: Sequence[str] = DAU_COLUMNS) -> DataFrame:
    """A1: the first session-opening view of each device and day, by the ``arrival`` columns. Batch.

    One aggregation by day and device. Spark combines rows before the shuffle, so a device with much of the data
    reaches its reducer as one row per map task. ``columns`` names what is wanted of the view: only that is shuffled,
    and a mere count of devices shuffles none of it.
    """
    payload = [name for name in columns if name not in ("dt", "mid", *arrival)]
    rows = device_rows(first_page_views(logs))
    first = rows.groupBy("dt", "mid").agg(F.min(F.struct(*arrival, *payload)).alias("_first"))
    return first.select(*[F.col(name) if name in ("dt", "mid") else F.col(f"_first.{name}").alias(name)
                          for name in columns])


def count_by_interval(logs: DataFrame, interval: str = "5 seconds") -> DataFrame:
    """A10: number of rows per interval of event time; only intervals that have rows."""
    counted = logs.groupBy(F.window(F.timestamp_millis("ts"), interval).alias("w")).agg(
        F.count(F.lit(1)).alias("cnt"))
    return counted.select(F.unix_millis("w.start").alias("window_start"), "cnt")
