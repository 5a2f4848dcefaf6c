"""The registered queries: each takes a session and a folder of sample tables and reads them whole."""

from __future__ import annotations

import datetime
import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rtshop import fixtures as X
from rtshop.functions import scalars
from rtshop.operators import as_of, changes, dau, dims, logs, orders, sales, search
from rtshop.plans.reports import ShopReports
from rtshop.schemas import DAU_COLUMNS, ORDER_DETAIL, ORDER_INFO, ORDER_WIDE
from rtshop.session import prepare, shared_dir
from rtshop.sinks.batches import save_daily, topic_folder, with_partition
from rtshop.sources.bootstrap import bootstrap_messages
from rtshop.sources.daily import daily_table, expire_days, rejected_table, roll_days
from rtshop.sources.dim_store import changelog, changelog_reader, expire_dims, roll_dims
from rtshop.sources.records import file_stream, record_table
from rtshop.sources.search_index import indexed_hits, kept_cube, roll_index, save_indexed
from rtshop.streaming.dau import run_dau
from rtshop.streaming.hot_orders import HOT, heavy_orders, spread_hot
from rtshop.streaming.order_wide import run_order_wide
from rtshop.streaming.router import run_router
from rtshop.streaming.runtime import await_job, progress_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

KEYWORD = "red widget"
USER_COLUMNS = ("id", "name", "gender", "segment")


def register(query: Query) -> Query:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return query(prepare(spark), sf_dir)
    run.__name__, run.__doc__ = query.__name__, query.__doc__
    QUERIES[query.__name__] = run
    return query


# ---- inputs ----------------------------------------------------------------------------------------------------

def _logs(spark: SparkSession, sf: str) -> DataFrame:
    return logs.normalize_logs(X.log_records(X.table(spark, sf, "events")))


def _log_columns(df: DataFrame) -> DataFrame:
    return df.select(F.col("offset").alias("event_id"), "common.mid", "common.uid", "common.ar", "common.ch",
                     "common.vc", F.col("page").isNotNull().alias("has_page"), "page.last_page_id", "ts", "dt", "hr")


def _dau(spark: SparkSession, sf: str, columns: Sequence[str] = DAU_COLUMNS) -> DataFrame:
    return logs.daily_active_devices(_logs(spark, sf), ["ts", "offset"], columns)


def _orders(spark: SparkSession, sf: str) -> DataFrame:
    return X.order_info(X.table(spark, sf, "orders"))


def _details(spark: SparkSession, sf: str) -> DataFrame:
    return X.order_detail(X.table(spark, sf, "lineitem"), X.table(spark, sf, "part"))


def _users(spark: SparkSession, sf: str) -> DataFrame:
    return X.user_info(X.table(spark, sf, "customer"))


def _provinces(spark: SparkSession, sf: str) -> DataFrame:
    return X.base_province(X.table(spark, sf, "nation"))


def _wide(spark: SparkSession, sf: str, users: bool = True, provinces: bool = True) -> DataFrame:
    """Order-wide rows with the dimensions that a question asks for."""
    return orders.order_wide(_orders(spark, sf), _details(spark, sf), _users(spark, sf) if users else None,
                             _provinces(spark, sf) if provinces else None, X.AS_OF)


def _cube(spark: SparkSession, sf: str) -> DataFrame:
    return sales.sale_cube(sales.sale_hits(_wide(spark, sf, provinces=False), KEYWORD))


def _dim_changelog(spark: SparkSession, sf: str) -> DataFrame:
    records = X.dim_change_records(X.table(spark, sf, "customer"))
    return changes.dim_changes(changes.row_changes(records), order=["offset"])


def _work_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


# ---- logs and active devices -----------------------------------------------------------------------------------

@register
def log_normalize(spark: SparkSession, sf: str) -> DataFrame:
    """P1, P3."""
    return _log_columns(_logs(spark, sf))


@register
def first_page_views(spark: SparkSession, sf: str) -> DataFrame:
    """F1."""
    return _log_columns(logs.first_page_views(_logs(spark, sf)))


@register
def first_page_window_count(spark: SparkSession, sf: str) -> DataFrame:
    """A10."""
    return logs.count_by_interval(logs.first_page_views(_logs(spark, sf)))


@register
def dau_detail(spark: SparkSession, sf: str) -> DataFrame:
    """A1, P5."""
    return _dau(spark, sf)


@register
def dau_total(spark: SparkSession, sf: str) -> DataFrame:
    """A3."""
    return dau.dau_total(_dau(spark, sf))


@register
def dau_hourly(spark: SparkSession, sf: str) -> DataFrame:
    """A4."""
    return dau.dau_hourly(_dau(spark, sf, ("dt", "mid", "hr")))


@register
def dau_hourly_compare(spark: SparkSession, sf: str) -> DataFrame:
    """J6, A11, P12."""
    return dau.dau_hourly_compare(_dau(spark, sf, ("dt", "mid", "hr")))


# ---- change log ------------------------------------------------------------------------------------------------

@register
def cdc_route_facts(spark: SparkSession, sf: str) -> DataFrame:
    """F2, F3, P7, P10, P16, K1."""
    records = X.fact_change_records(X.table(spark, sf, "orders"), X.table(spark, sf, "lineitem"))
    return changes.fact_messages(changes.row_changes(records)).select("topic", "key", "value")


@register
def topic_partitions(spark: SparkSession, sf: str) -> DataFrame:
    """K1: keys and messages per topic; ``split_keys`` counts keys found in more than one partition."""
    records = X.fact_change_records(X.table(spark, sf, "orders"), X.table(spark, sf, "lineitem"))
    placed = with_partition(changes.fact_messages(changes.row_changes(records)), 4)
    by_key = placed.groupBy("topic", "key").agg(F.count(F.lit(1)).alias("n"), F.min("partition").alias("low"),
                                                F.max("partition").alias("high"))
    return by_key.groupBy("topic").agg(
        F.count(F.lit(1)).alias("topic_keys"), F.sum("n").alias("messages"),
        F.count(F.when(F.col("low") != F.col("high"), 1)).alias("split_keys"))


@register
def dim_merge_latest(spark: SparkSession, sf: str) -> DataFrame:
    """K3, F6, P8."""
    return dims.dim_rows(_dim_changelog(spark, sf), "DIM_USER_INFO", USER_COLUMNS)


@register
def dim_merge_deletes(spark: SparkSession, sf: str) -> DataFrame:
    """K3 with deletes taken at their word."""
    return dims.dim_rows(_dim_changelog(spark, sf), "DIM_USER_INFO", USER_COLUMNS, honor_deletes=True)


@register
def dim_merge_compacted(spark: SparkSession, sf: str) -> DataFrame:
    """K3: the same state from a compacted changelog, deletes honored: a deleted key stays deleted."""
    base = dims.compacted(_dim_changelog(spark, sf), honor_deletes=True)
    return dims.dim_rows(base, "DIM_USER_INFO", USER_COLUMNS, honor_deletes=True)


@register
def dim_merge_open(spark: SparkSession, sf: str) -> DataFrame:
    """K3 without declared columns; one row per key and column."""
    merged = dims.merge_dim_open(_dim_changelog(spark, sf))
    return merged.select("dim_table", "rowkey", F.explode("row").alias("name", "cell"))


@register
def dim_rowkey(spark: SparkSession, sf: str) -> DataFrame:
    """P9."""
    return X.table(spark, sf, "customer").select("c_custkey", scalars.dim_rowkey(F.col("c_custkey")).alias("rowkey"))


@register
def bootstrap_envelope(spark: SparkSession, sf: str) -> DataFrame:
    """The envelopes, decoded and counted; ``oversized`` counts those above the chunk size."""
    tables = {"user_info": _users(spark, sf), "base_province": _provinces(spark, sf)}
    messages = bootstrap_messages(tables, X.DATABASE, chunk_rows=500)
    fields = "database string, table string, type string, pkNames array<string>, data array<map<string,string>>"
    decoded = messages.select(F.from_json("value", fields).alias("m")).select("m.*")
    sizes = F.size("data")
    ids = F.aggregate("data", F.lit(0).cast("bigint"), lambda total, row: total + row["id"].cast("bigint"))
    return decoded.groupBy("database", "table", "type", F.get("pkNames", F.lit(0)).alias("pk")).agg(
        F.sum(sizes).cast("bigint").alias("row_count"), F.sum(ids).alias("id_sum"),
        F.count(F.when(sizes > 500, 1)).alias("oversized"))


# ---- orders ----------------------------------------------------------------------------------------------------

@register
def order_typed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """P2, P4 on messages whose numbers are texts and whose nulls are absent."""
    messages = X.fact_records(_orders(spark, sf), "DWD_ORDER_INFO_I", "id")
    typed = orders.order_rows(messages)
    return typed.select(*ORDER_INFO.names, "create_date", "create_hour")


@register
def detail_typed_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Details whose absent amounts become 0."""
    messages = X.fact_records(_details(spark, sf).drop("split_activity_amount", "split_coupon_amount"),
                              "DWD_ORDER_DETAIL_I", "order_id")
    return orders.detail_rows(messages).select(*ORDER_DETAIL.names)


@register
def detail_set_collapse(spark: SparkSession, sf: str) -> DataFrame:
    """A2: all details, those of returned lines sent again."""
    lines = X.table(spark, sf, "lineitem")
    sent = lines.unionByName(lines.filter(F.col("l_returnflag") == "R"))
    details = X.order_detail(sent, X.table(spark, sf, "part"))
    return orders.distinct_details(details).select("id", "order_id", "sku_id", "sku_num", "split_total_amount")


@register
def order_with_user(spark: SparkSession, sf: str) -> DataFrame:
    """J1, P11."""
    joined = orders.with_user(_orders(spark, sf), _users(spark, sf), X.AS_OF)
    return joined.select("id", "user_id", "total_amount", "user_age", "user_gender")


@register
def order_user_as_of(spark: SparkSession, sf: str) -> DataFrame:
    """Users change twice between orders; each order has the attributes of its arrival, its age on that day."""
    records = X.timed_user_changes(X.table(spark, sf, "customer"))
    log = changes.dim_changes(changes.row_changes(records), order=["timestamp", "partition", "offset"])
    joined = as_of.with_user_as_of(_orders(spark, sf), log)
    return joined.select("id", "user_id", "user_age", "user_gender")


@register
def snapshot_handoff(spark: SparkSession, sf: str) -> DataFrame:
    """A snapshot that was read before some changes and after others, and sent after all of them.

    Two segments are updated after the snapshot's mark, a third one before it: only the first two keep the feed's name.
    """
    customer = X.table(spark, sf, "customer")
    early = customer.filter(F.col("c_mktsegment") == "BUILDING").withColumn("c_mktsegment", F.lit("HOUSEHOLD"))
    mark = datetime.datetime.fromisoformat(str(X.START)) + datetime.timedelta(hours=1)
    moved = lambda records, hours: records.withColumn(
        "timestamp", F.col("timestamp") + F.make_dt_interval(hours=F.lit(hours)))
    feed = moved(X.dim_change_records(customer).filter("offset = 1"), 2)
    old = moved(X.dim_change_records(early).filter("offset = 1"), 0)
    snapshot = bootstrap_messages({"user_info": _users(spark, sf)}, X.DATABASE, ["user_info"], as_of={"user_info": mark})
    sent = snapshot.select("key", "value", "topic", F.lit(0).alias("partition"), F.lit(10 ** 6).cast("bigint").alias("offset"),
                           F.lit(X.START).cast("timestamp").alias("timestamp"))
    records = feed.unionByName(old).unionByName(moved(sent, 9))
    log = changes.dim_changes(changes.row_changes(records), order=["timestamp", "partition", "offset"])
    return dims.dim_rows(log, "DIM_USER_INFO", ("id", "name", "gender"))


@register
def order_with_province(spark: SparkSession, sf: str) -> DataFrame:
    """J2, S5."""
    joined = orders.with_province(_orders(spark, sf), _provinces(spark, sf))
    return joined.select("id", "province_id", "province_name", "province_area_code", "province_3166_2_code",
                         "province_iso_code")


@register
def order_detail_full_outer(spark: SparkSession, sf: str) -> DataFrame:
    """J3."""
    joined = orders.order_detail_full_outer(orders.one_row_per_order(_orders(spark, sf)), _details(spark, sf))
    return joined.select(F.coalesce("o_id", "d_order_id").alias("order_id"), F.col("d_id").alias("detail_id"),
                         "match")


@register
def order_detail_interval(spark: SparkSession, sf: str) -> DataFrame:
    """J4."""
    pairs = orders.order_detail_interval(orders.one_row_per_order(_orders(spark, sf)), _details(spark, sf))
    lag = F.unix_seconds("d_timestamp") - F.unix_seconds("o_timestamp")
    return pairs.select(F.col("o_id").alias("order_id"), F.col("d_id").alias("detail_id"), lag.alias("lag_seconds"))


@register
def order_detail_hot(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the largest orders spread, as hot from the middle of the arrivals on."""
    left, right = orders.one_row_per_order(_orders(spark, sf)), _details(spark, sf)
    first, last = right.agg(F.min("timestamp"), F.max("timestamp")).first()
    since = None if first is None else first + (last - first) / 2
    hot = spark.createDataFrame([(r["order_id"], since) for r in heavy_orders(right, 1 / 20_000, 1).collect()], HOT)
    pairs = orders.order_detail_interval(*spread_hot(left, right, hot))
    lag = F.unix_seconds("d_timestamp") - F.unix_seconds("o_timestamp")
    return pairs.select(F.col("o_id").alias("order_id"), F.col("d_id").alias("detail_id"), lag.alias("lag_seconds"))


@register
def order_wide(spark: SparkSession, sf: str) -> DataFrame:
    """P4, P6, J1, J2, J5."""
    return _wide(spark, sf)


@register
def upsert_latest_by_id(spark: SparkSession, sf: str) -> DataFrame:
    """K4: three saves of orders, one of them repeated; the last save of each id and day remains.

    The second save first holds all orders, as of a batch that is repeated after a failure with fewer of them.
    """
    folder = _work_folder(spark, "upsert")
    source = X.table(spark, sf, "orders")
    closed, low = source.filter(F.col("o_orderstatus") == "F"), source.filter(F.col("o_orderpriority") == "5-LOW")
    for save, rows, status in ((0, source, F.col("order_status")), (1, source, F.lit("FAILED")),
                               (1, closed, F.lit("CLOSED")), (2, low, F.lit("DROPPED"))):
        saved = X.order_info(rows).withColumns({"order_status": status, "save": F.lit(save).cast("bigint")})
        save_daily(saved.withColumnRenamed("create_date", "dt"), folder, save)
    return daily_table(spark, folder, ["id"]).select("dt", "id", "order_status", "total_amount", "save")


# ---- sales -----------------------------------------------------------------------------------------------------

@register
def sale_search_total(spark: SparkSession, sf: str) -> DataFrame:
    """F4, A9."""
    return sales.hit_counts(sales.sale_hits(_wide(spark, sf, users=False, provinces=False), KEYWORD))


@register
def sale_search_page(spark: SparkSession, sf: str) -> DataFrame:
    """F4, T1, T4."""
    hits = sales.sale_hits(_wide(spark, sf, users=False, provinces=False), KEYWORD)
    # Dimensions are for the rows of the page, not for all hits.
    page = sales.sale_page(hits, page=sales.page_of_offset(20, 20), size=20)
    with_users = orders.with_user(page, _users(spark, sf), X.AS_OF)
    return orders.with_province(with_users, _provinces(spark, sf)).select(*ORDER_WIDE, "dt")


@register
def sale_age_agg(spark: SparkSession, sf: str) -> DataFrame:
    """A5, T3."""
    return sales.age_sums(_cube(spark, sf))


@register
def sale_gender_agg(spark: SparkSession, sf: str) -> DataFrame:
    """A6, T3."""
    return sales.gender_sums(_cube(spark, sf))


@register
def sale_age_share(spark: SparkSession, sf: str) -> DataFrame:
    """A7, P13, P15."""
    return sales.age_shares(_cube(spark, sf))


@register
def sale_gender_share(spark: SparkSession, sf: str) -> DataFrame:
    """A8, P14, P15."""
    return sales.gender_shares(_cube(spark, sf))


@register
def province_sales(spark: SparkSession, sf: str) -> DataFrame:
    """Z1."""
    return sales.province_sales(_wide(spark, sf, users=False))


@register
def search_topk_highlight(spark: SparkSession, sf: str) -> DataFrame:
    """F5, T2, P17, P18."""
    return search.search_top(X.table(spark, sf, "part"), "p_name", KEYWORD, sort_by="p_retailprice",
                             key="p_partkey", fields=["p_name", "p_retailprice"], size=2)


# ---- reports over day tables -----------------------------------------------------------------------------------

REPORT_DAY = "2024-01-10"


@register
def report_realtime_hour(spark: SparkSession, sf: str) -> DataFrame:
    """Devices saved into a day table, then asked by day."""
    folder = _work_folder(spark, "report_dau")
    save_daily(_dau(spark, sf), folder, 0)
    return ShopReports(spark, folder, "").realtime_hour(REPORT_DAY)


@register
def report_sale_stat(spark: SparkSession, sf: str) -> DataFrame:
    """Order-wide rows saved into a day table, then searched by day."""
    folder = _work_folder(spark, "report_wide")
    save_daily(_wide(spark, sf), folder, 0)
    return ShopReports(spark, "", folder).sale_detail(REPORT_DAY.replace("-", ""), KEYWORD).stat


def _indexed_sales(spark: SparkSession, sf: str, name: str) -> ShopReports:
    """Order-wide rows with their index after corrections: lines of odd numbers are renamed and doubled, some of those
    set right again by a batch that is repeated. The index is rolled between."""
    folder = _work_folder(spark, name)
    # Computed once, by the first save.
    rows = _wide(spark, sf)
    save_indexed(rows, f"{folder}/wide", f"{folder}/index", 0)
    first = spark.read.option("basePath", f"{folder}/wide").parquet(f"{folder}/wide/dt=*/_batch_id=0")
    wide = first.select(*[F.col(name).cast(kind).alias(name) for name, kind in rows.dtypes])
    odd, back = F.col("sku_num") % 2 == 1, F.col("sku_num") % 4 == 1
    renamed = wide.filter(odd).withColumns(
        {"sku_name": F.lit("green gizmo"), "split_total_amount": 2 * F.col("split_total_amount")})
    save_indexed(renamed, f"{folder}/wide", f"{folder}/index", 1)
    for _ in range(2):
        save_indexed(wide.filter(back), f"{folder}/wide", f"{folder}/index", 2)
    roll_days(spark, f"{folder}/wide", ["detail_id"])
    roll_index(spark, f"{folder}/wide", f"{folder}/index")
    return ShopReports(spark, "", f"{folder}/wide", index=f"{folder}/index")


@register
def sale_hits_index(spark: SparkSession, sf: str) -> DataFrame:
    """A day's hits by postings, after corrections."""
    reports = _indexed_sales(spark, sf, "sale_hits_index")
    return indexed_hits(spark, reports.wide_table, reports.index, KEYWORD, REPORT_DAY).select(
        "dt", "detail_id", "sku_name", "sku_num", "split_total_amount")


@register
def sale_page_index(spark: SparkSession, sf: str) -> DataFrame:
    """Rows 41 to 60 of a day's hits in order of id, found by kept counts of id ranges, after corrections."""
    detail = _indexed_sales(spark, sf, "sale_page_index").table_page(40, 20, REPORT_DAY, "gizmo").detail
    return detail.select("dt", "detail_id", "sku_name", "sku_num", "split_total_amount")


@register
def sale_relevant_page(spark: SparkSession, sf: str) -> DataFrame:
    """The second page of a day's hits with any word of the keyword, in order of relevance."""
    page = _indexed_sales(spark, sf, "sale_relevant_page").relevant_page(REPORT_DAY, "red gizmo", 2, 20, any_word=True)
    return page.select("detail_id", "sku_name", "score")


@register
def sale_cube_kept(spark: SparkSession, sf: str) -> DataFrame:
    """Rows and amount by day, age and gender of a keyword, from sums that were kept through corrections."""
    reports = _indexed_sales(spark, sf, "sale_cube_kept")
    cube = kept_cube(spark, reports.index, keyword=KEYWORD)
    return cube.withColumn("amount", F.col("amount").cast("double"))


# ---- streams ---------------------------------------------------------------------------------------------------

FILES_PER_BATCH = 1000
# Spans of sending time that a table is cut into; a job is started anew for each.
SPANS = 3
# Every fifth key comes by a source partition that is so far behind the others.
BEHIND_SECONDS = 1800


def _stream(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A sample table as a file stream. The pattern matches a single file as well as a folder of files."""
    shape = spark.read.parquet(f"{sf}/{name}.parquet").schema
    rows = (spark.readStream.schema(shape).option("maxFilesPerTrigger", FILES_PER_BATCH)
            .parquet(f"{sf}/{name}.parquet*"))
    return rows.select(*[F.col(c).cast("timestamp").alias(c) if kind == "timestamp_ntz" else F.col(c)
                         for c, kind in rows.dtypes])


def _state_partitions(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism


def _sent(records: DataFrame) -> Column:
    """When a record is delivered, in seconds: on arrival, or later by the partition that is behind."""
    late = F.pmod(F.xxhash64("key"), F.lit(5)) == 0
    return F.unix_seconds("timestamp") + F.when(late, BEHIND_SECONDS).otherwise(0)


def _cuts(*sources: DataFrame) -> list[int]:
    """Inner limits of ``SPANS`` equal spans of the sources' sending time."""
    ends = [source.agg(F.min(_sent(source)).alias("a"), F.max(_sent(source)).alias("b")).first() for source in sources]
    known = [(low, high) for low, high in ends if low is not None] or [(0, 0)]
    low, high = min(e[0] for e in known), max(e[1] for e in known)
    return [low + (high - low) * i // SPANS for i in range(1, SPANS)]


def _deliver(records: DataFrame, cuts: Sequence[int], span: int, folder: str) -> None:
    """Append the records of one span to the folder of a file stream."""
    low, high = [None, *cuts][span], [*cuts, None][span]
    sent = _sent(records)
    inside = (F.lit(True) if low is None else sent >= low) & (F.lit(True) if high is None else sent < high)
    records.filter(inside).write.mode("append").parquet(folder)


# A client whose clock is years ahead: a device of a day of its own, which must not age out any other.
WRONG_CLOCK = ('{"common":{"mid":"ahead","uid":"u","ar":"1","ch":"web","vc":"v1"},"page":{"page_id":"home"},'
               '"ts":4070908800000}')


def _log_source(spark: SparkSession, sf: str) -> DataFrame:
    records = X.log_records(X.table(spark, sf, "events"))
    first = records.agg(F.min("timestamp").alias("timestamp")).filter("timestamp is not null")
    ahead = first.select(F.lit("ahead").alias("key"), F.lit(WRONG_CLOCK).alias("value"), F.lit("ODS_BASE_LOG").alias("topic"),
                         F.lit(0).alias("partition"), F.lit(-1).cast("bigint").alias("offset"), "timestamp")
    return records.unionByName(ahead)


@register
def stream_dau(spark: SparkSession, sf: str) -> DataFrame:
    """The device stream into its day table, which is then read back.

    Messages come in spans of time, a fifth of the devices half an hour behind; one client's clock is years ahead. The
    first span is sent once more with the second, and the job is started anew for each span.
    """
    folder = _work_folder(spark, "stream_dau")
    records = _log_source(spark, sf)
    cuts = _cuts(records)
    for span in range(SPANS):
        for part in (span, 0) if span == 1 else (span,):
            _deliver(records, cuts, part, f"{folder}/in")
        run_dau(file_stream(spark, f"{folder}/in", FILES_PER_BATCH), f"{folder}/dau", f"{folder}/checkpoint",
                interval=None, partitions=_state_partitions(spark)).awaitTermination()
    return daily_table(spark, f"{folder}/dau", ["mid"], first=True).select(*DAU_COLUMNS)


@register
def stream_rejects(spark: SparkSession, sf: str) -> DataFrame:
    """Log messages, every tenth broken; the devices and the rejects that the job keeps, counted.

    Good and rejected records together are all that came.
    """
    folder = _work_folder(spark, "stream_rejects")
    records = X.log_records(X.table(spark, sf, "events"))
    broken = F.when(F.col("offset") % 20 == 0, F.concat(F.lit("{"), "value")).when(
        F.col("offset") % 20 == 10, F.regexp_replace("value", '"mid":"[^"]*",', ""))
    records.withColumn("value", F.coalesce(broken, "value")).write.parquet(f"{folder}/in")
    run_dau(file_stream(spark, f"{folder}/in", FILES_PER_BATCH), f"{folder}/dau", f"{folder}/checkpoint", interval=None,
            partitions=_state_partitions(spark), rejects=f"{folder}/rejects").awaitTermination()
    devices = daily_table(spark, f"{folder}/dau", ["mid"], first=True).agg(F.count(F.lit(1)).alias("cnt"))
    rejects = rejected_table(spark, f"{folder}/rejects").agg(F.count(F.lit(1)).alias("cnt"))
    return devices.select(F.lit("devices").alias("what"), "cnt").unionByName(
        rejects.select(F.lit("rejects").alias("what"), "cnt"))


@register
def stream_cdc_route(spark: SparkSession, sf: str) -> DataFrame:
    """The change stream into topics; messages per topic as read back."""
    folder = _work_folder(spark, "stream_cdc_route")
    records = X.fact_change_records(_stream(spark, sf, "orders"), _stream(spark, sf, "lineitem"))
    job = run_router(records, f"{folder}/topics", f"{folder}/dims", f"{folder}/checkpoint", interval=None)
    job.awaitTermination()
    return record_table(spark, f"{folder}/topics").select("topic", "key", "value")


@register
def stream_dim_merge(spark: SparkSession, sf: str) -> DataFrame:
    """The change stream of a dimension into its changelog, merged as read back.

    One start of the job for the inserts, one for the updates, one for the deletes, which are then sent once more.
    """
    folder = _work_folder(spark, "stream_dim_merge")
    records = X.dim_change_records(X.table(spark, sf, "customer"))
    for offset in (0, 1, 2, 2):
        records.filter(F.col("offset") == offset).write.mode("append").parquet(f"{folder}/in")
        run_router(file_stream(spark, f"{folder}/in", FILES_PER_BATCH), f"{folder}/topics", f"{folder}/dims",
                   f"{folder}/checkpoint", interval=None).awaitTermination()
    return dims.dim_rows(changelog(spark, f"{folder}/dims"), "DIM_USER_INFO", USER_COLUMNS)


@register
def stream_dim_roll(spark: SparkSession, sf: str) -> DataFrame:
    """A dimension looked up by key while its changelog is rolled, after that, and in the end.

    The router saves inserts, updates and deletes in three starts. One reader opens the store before it is rolled and reads
    afterwards; two more rolls and the removal of what they replaced follow the last start, which is sent twice.
    """
    folder = _work_folder(spark, "stream_dim_roll")
    records = X.dim_change_records(X.table(spark, sf, "customer"))

    def route(offset: int) -> None:
        records.filter(F.col("offset") == offset).write.mode("append").parquet(f"{folder}/in")
        run_router(file_stream(spark, f"{folder}/in", FILES_PER_BATCH), f"{folder}/topics", f"{folder}/dims",
                   f"{folder}/checkpoint", interval=None).awaitTermination()

    read = changelog_reader(f"{folder}/dims", "DIM_USER_INFO", USER_COLUMNS)
    keys = X.table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    def note(phase: str, rows: DataFrame) -> None:
        rows.write.parquet(f"{folder}/seen/phase={phase}")

    route(0), route(1)
    meanwhile = read(spark, keys)
    roll_dims(spark, f"{folder}/dims")
    note("meanwhile", meanwhile)
    note("rolled", read(spark, keys))
    for _ in range(2):
        route(2)
        roll_dims(spark, f"{folder}/dims")
    # All earlier readers have read: nothing but the last base and the batch after it stays.
    expire_dims(spark, f"{folder}/dims", keep=1)
    note("end", read(spark, keys))
    return spark.read.parquet(f"{folder}/seen").select("phase", *USER_COLUMNS)


@register
def day_table_roll(spark: SparkSession, sf: str) -> DataFrame:
    """Orders saved four times, read while and after their days are rolled, and when old folders are gone."""
    folder = _work_folder(spark, "day_table_roll")
    source = X.table(spark, sf, "orders")
    low = source.filter(F.col("o_orderpriority") == "5-LOW")

    def save(batch: int, rows: DataFrame, status: Column) -> None:
        save_daily(X.order_info(rows).withColumn("order_status", status).withColumnRenamed("create_date", "dt"), folder, batch)

    def note(phase: str, rows: DataFrame) -> None:
        counts = rows.groupBy("dt", "order_status").agg(F.count(F.lit(1)).alias("cnt"))
        counts.write.parquet(f"{folder}-seen/phase={phase}")

    save(0, source, F.col("order_status"))
    save(1, source.filter(F.col("o_orderstatus") == "F"), F.lit("CLOSED"))
    meanwhile = daily_table(spark, folder, ["id"])
    roll_days(spark, folder, ["id"])
    note("meanwhile", meanwhile)
    note("rolled", daily_table(spark, folder, ["id"]))
    # Two more rolls: what the first base replaced may go then.
    for batch in (2, 3):
        save(batch, low, F.lit("DROPPED"))
        roll_days(spark, folder, ["id"])
    expire_days(spark, folder, keep=2)
    note("end", daily_table(spark, folder, ["id"]))
    return spark.read.parquet(f"{folder}-seen").select("phase", "dt", "order_status", "cnt")


@register
def stream_order_wide(spark: SparkSession, sf: str) -> DataFrame:
    """Both fact streams into the order-wide day table, which is then read back.

    The dimensions come through the change router and are read for each batch. Orders and details come in spans of
    time, a fifth of the keys half an hour behind, the first once more with the second; the job is started anew for each.
    """
    folder = _work_folder(spark, "stream_order_wide")
    snapshot = bootstrap_messages({"user_info": _users(spark, sf), "base_province": _provinces(spark, sf)}, X.DATABASE)
    snapshot.select("key", "value", "topic", F.lit(0).alias("partition"), F.monotonically_increasing_id().alias("offset"),
                    F.lit(X.START).cast("timestamp").alias("timestamp")).write.parquet(f"{folder}/changes")
    run_router(file_stream(spark, f"{folder}/changes", FILES_PER_BATCH), f"{folder}/topics", f"{folder}/dims",
               f"{folder}/router", interval=None).awaitTermination()
    users = changelog_reader(f"{folder}/dims", "DIM_USER_INFO", ("id", "birthday", "gender"))
    provinces = changelog_reader(f"{folder}/dims", "DIM_BASE_PROVINCE",
                                 ("id", "name", "area_code", "iso_code", "iso_3166_2"))
    # Written once; the spans are cut from what is written.
    sent = {}
    for name, rows, key in (("ORDER_INFO", _orders(spark, sf), "id"), ("ORDER_DETAIL", _details(spark, sf), "order_id")):
        X.fact_records(rows, f"DWD_{name}_I", key).write.parquet(f"{folder}/{name}")
        sent[name] = spark.read.parquet(f"{folder}/{name}")
    order_records, detail_records = sent["ORDER_INFO"], sent["ORDER_DETAIL"]
    cuts = _cuts(order_records, detail_records)
    for span in range(SPANS):
        for part in (span, 0) if span == 1 else (span,):
            _deliver(order_records, cuts, part, f"{folder}/orders")
            _deliver(detail_records, cuts, part, f"{folder}/details")
        run_order_wide(file_stream(spark, f"{folder}/orders", FILES_PER_BATCH),
                       file_stream(spark, f"{folder}/details", FILES_PER_BATCH), users, provinces, f"{folder}/wide",
                       f"{folder}/checkpoint", as_of=X.AS_OF, interval=None,
                       partitions=_state_partitions(spark)).awaitTermination()
        # The dimensions are rolled while the job's tables stay as they are: later spans read the base.
        roll_dims(spark, f"{folder}/dims")
    return daily_table(spark, f"{folder}/wide", ["detail_id"])


@register
def stream_chain(spark: SparkSession, sf: str) -> DataFrame:
    """One change feed of orders and details, routed to topics by one job and joined by the next."""
    folder = _work_folder(spark, "stream_chain")
    feed = X.insert_envelopes(_orders(spark, sf), "order_info").unionByName(
        X.insert_envelopes(_details(spark, sf), "order_detail"))
    dimensions = bootstrap_messages({"user_info": _users(spark, sf), "base_province": _provinces(spark, sf)}, X.DATABASE)
    feed.unionByName(dimensions.select("key", "value", "topic", F.lit(0).alias("partition"), F.lit(0).cast("bigint").alias("offset"),
                                       F.lit(X.START).cast("timestamp").alias("timestamp"))).write.parquet(f"{folder}/in")
    await_job(run_router(file_stream(spark, f"{folder}/in", FILES_PER_BATCH), f"{folder}/topics", f"{folder}/dims",
                         f"{folder}/router", interval=None))
    users = changelog_reader(f"{folder}/dims", "DIM_USER_INFO", ("id", "birthday", "gender"))
    provinces = changelog_reader(f"{folder}/dims", "DIM_BASE_PROVINCE", ("id", "name", "area_code", "iso_code", "iso_3166_2"))
    topics = [file_stream(spark, topic_folder(f"{folder}/topics", f"DWD_{name}_I"), FILES_PER_BATCH)
              for name in ("ORDER_INFO", "ORDER_DETAIL")]
    await_job(run_order_wide(*topics, users, provinces, f"{folder}/wide", f"{folder}/checkpoint", as_of=X.AS_OF, interval=None,
                             partitions=_state_partitions(spark)))
    return daily_table(spark, f"{folder}/wide", ["detail_id"]).select(
        "dt", "detail_id", "order_id", "sku_name", "split_total_amount", "user_age", "user_gender", "province_name")


@register
def stream_progress(spark: SparkSession, sf: str) -> DataFrame:
    """A job's own account of its batches over three starts: messages taken, batches that do not begin where the
    one before ended, rows refused for being late."""
    folder = _work_folder(spark, "stream_progress")
    records = X.log_records(X.table(spark, sf, "events"))
    low, high = records.agg(F.min("timestamp"), F.max("timestamp")).first()
    span = F.floor((F.unix_micros("timestamp") - F.unix_micros(F.lit(low))) * SPANS / (
        F.unix_micros(F.lit(high)) - F.unix_micros(F.lit(low)) + 1))
    for part in range(SPANS):
        records.filter(span == part).write.mode("append").parquet(f"{folder}/in")
        await_job(run_dau(file_stream(spark, f"{folder}/in", FILES_PER_BATCH), f"{folder}/dau", f"{folder}/checkpoint",
                          interval=None, partitions=_state_partitions(spark), progress=f"{folder}/progress"))
    lines = progress_table(spark, f"{folder}/progress")
    order = Window.partitionBy("job").orderBy("batch")
    ends = F.lag(F.get("offsets", F.lit(0))["end"]).over(order)
    start = F.get("offsets", F.lit(0))["start"]
    told = lines.withColumn("gap", (F.coalesce(ends, F.lit("null")) != start).cast("int"))
    return told.groupBy("job").agg(F.sum("input_rows").alias("input_rows"), F.sum("gap").cast("long").alias("gaps"),
                                   F.sum("refused").alias("refused"))
