"""Shop inputs derived from the sample tables, so that every query has data and a SQL counterpart.

Each frame is a projection of a given table (plus the product table for details), so it grows with it. The sample
lines have no key: a detail id is made of the order key and a mix of the other numbers of the line, which needs no
window and no counter.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rtshop.operators.orders import with_order_day

# Fixed values of the derivation; plans/oracle.py states the same ones in SQL.
START = "2024-01-01 00:00:00"
START_SECONDS = 1704067200
SPREAD_SECONDS = 30 * 86400
ORDER_STEP = 7919
DETAILS_PER_ORDER = 1_000_000_000
AS_OF = "2024-01-01"
DATABASE = "shop"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A sample table; its zone-less timestamps become timestamps of the session zone."""
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*[F.col(c).cast("timestamp").alias(c) if kind == "timestamp_ntz" else F.col(c)
                       for c, kind in df.dtypes])


def as_text(moment: Column) -> Column:
    return F.date_format(moment, "yyyy-MM-dd HH:mm:ss")


def order_seconds(order_id: Column) -> Column:
    """When an order reached the stream, in seconds of the epoch: spread over thirty days by its key."""
    return F.lit(START_SECONDS) + (order_id * ORDER_STEP) % SPREAD_SECONDS


def log_records(events: DataFrame) -> DataFrame:
    """Application log messages, one per event; ``offset`` is the arrival order."""
    k = F.get_json_object("props", "$.k").cast("int")
    page = F.when(F.col("event_type") != "error", F.struct(
        F.when(k % 3 == 0, F.lit(None).cast("string")).when(k % 3 == 1, "")
        .otherwise(F.concat(F.lit("p"), k.cast("string"))).alias("last_page_id")))
    user = F.col("user_id").cast("string")
    common = F.struct(
        F.concat(F.lit("mid_"), user).alias("mid"), user.alias("uid"),
        (F.col("user_id") % 7).cast("string").alias("ar"), F.col("event_type").alias("ch"),
        F.concat(F.lit("v"), (k % 5).cast("string")).alias("vc"))
    value = F.to_json(F.struct(common.alias("common"), page.alias("page"), F.unix_millis("ts").alias("ts")))
    return events.select(
        F.col("user_id").cast("string").alias("key"), value.alias("value"), F.lit("ODS_BASE_LOG").alias("topic"),
        F.lit(0).alias("partition"), F.col("event_id").alias("offset"), F.col("ts").alias("timestamp"))


def order_info(orders: DataFrame) -> DataFrame:
    """Orders; province 25 has no dimension row."""
    seconds = order_seconds(F.col("o_orderkey"))
    none = F.lit(0.0)
    return with_order_day(orders.select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 26).alias("province_id"),
        F.col("o_orderstatus").alias("order_status"), F.col("o_custkey").alias("user_id"),
        F.col("o_totalprice").alias("total_amount"), none.alias("activity_reduce_amount"),
        none.alias("coupon_reduce_amount"), F.col("o_totalprice").alias("original_total_amount"),
        none.alias("feight_fee"), none.alias("feight_fee_reduce"),
        as_text(F.timestamp_seconds(seconds + 900)).alias("expire_time"),
        F.lit(None).cast("string").alias("refundable_time"), as_text(F.timestamp_seconds(seconds)).alias("create_time"),
        as_text(F.col("o_orderdate")).alias("operate_time"), F.timestamp_seconds(seconds).alias("timestamp")))


def order_detail(lineitem: DataFrame, part: DataFrame) -> DataFrame:
    """Order details; they arrive from 5 minutes before to 20 minutes after their order."""
    quantity = F.col("l_quantity").cast("bigint")
    mixed = (F.col("l_partkey") * 7919 + F.col("l_suppkey") * 104729 + F.col("l_linenumber") * 1299709
             + quantity * 15485863) % DETAILS_PER_ORDER
    lag = (F.col("l_partkey") * 7 + F.col("l_suppkey") * 13 + F.col("l_linenumber") * 131) % 1501 - 300
    arrival = F.timestamp_seconds(order_seconds(F.col("l_orderkey")) + lag)
    lines = lineitem.select(
        (F.col("l_orderkey") * DETAILS_PER_ORDER + mixed).alias("id"), F.col("l_orderkey").alias("order_id"),
        F.col("l_partkey").alias("sku_id"), quantity.alias("sku_num"), as_text(arrival).alias("create_time"),
        F.col("l_extendedprice").alias("split_total_amount"), arrival.alias("timestamp"))
    joined = lines.join(part.select("p_partkey", "p_retailprice", "p_name"), F.col("sku_id") == F.col("p_partkey"),
                        "left")
    return joined.select(
        "id", "order_id", "sku_id", F.col("p_retailprice").alias("order_price"), "sku_num",
        F.col("p_name").alias("sku_name"), "create_time", "split_total_amount",
        F.lit(0.0).alias("split_activity_amount"), F.lit(0.0).alias("split_coupon_amount"), "timestamp")


def user_info(customer: DataFrame) -> DataFrame:
    key = F.col("c_custkey")
    birthday = F.date_add(F.lit("1965-01-01").cast("date"), (key * 37 % 16000).cast("int"))
    gender = F.when(key % 50 == 7, F.lit(None).cast("string")).when(key % 3 == 0, "F").otherwise("M")
    return customer.select(key.alias("id"), F.col("c_name").alias("name"),
                           F.date_format(birthday, "yyyy-MM-dd").alias("birthday"), gender.alias("gender"))


def base_province(nation: DataFrame) -> DataFrame:
    key = F.col("n_nationkey")
    return nation.select(
        key.cast("bigint").alias("id"), F.col("n_name").alias("name"),
        (key * 1000 + 110000).cast("string").alias("area_code"),
        F.concat(F.lit("CN-"), F.lpad(key.cast("string"), 2, "0")).alias("iso_code"),
        F.concat(F.lit("CN-P"), key.cast("string")).alias("iso_3166_2"))


def _texts(**cells: Column) -> Column:
    """A row as a map of texts, as a change log delivers it."""
    return F.create_map(*[item for name, cell in cells.items() for item in (F.lit(name), cell.cast("string"))])


def _envelope(name: str, operation: str, *rows: Column) -> Column:
    return F.to_json(F.struct(
        F.lit(DATABASE).alias("database"), F.lit(name).alias("table"), F.lit(operation).alias("type"),
        F.array(F.lit("id")).alias("pkNames"), F.array(*rows).alias("data")))


def _change_records(df: DataFrame, *changes: tuple[Column | None, str, str, int, tuple[Column, ...]]) -> DataFrame:
    """Change records of each row of ``df``: (condition or None for all, table, operation, sequence, changed rows).

    One pass: the changes of a row are an array of it, so that a table with seven kinds of changes is read once.
    """
    messages = []
    for condition, name, operation, seq, rows in changes:
        message = F.struct(_envelope(name, operation, *rows).alias("value"), F.lit(seq).cast("bigint").alias("offset"))
        messages.append(message if condition is None else F.when(condition, message))
    sent = df.select(F.explode(F.array(*messages)).alias("m")).filter("m is not null")
    return sent.select(F.lit(None).cast("string").alias("key"), "m.value", F.lit("ODS_BASE_DB_C").alias("topic"),
                       F.lit(0).alias("partition"), "m.offset", F.lit(START).cast("timestamp").alias("timestamp"))


def dim_change_records(customer: DataFrame) -> DataFrame:
    """Changes of ``user_info``: all inserted; two segments updated with an empty cell; one deleted with a null."""
    key, name, segment = F.col("c_custkey"), F.col("c_name"), F.col("c_mktsegment")
    null = F.lit(None).cast("string")
    insert = _texts(id=key, name=name, gender=F.lit("M"), segment=segment)
    first = _texts(id=key, name=F.concat(name, F.lit("_t")), gender=F.lit(""))
    second = _texts(id=key, name=F.concat(name, F.lit("_u")), gender=F.lit(""))
    last = _texts(id=key, name=F.concat(name, F.lit("_d")), gender=null)
    return _change_records(
        customer, (None, "user_info", "INSERT", 0, (insert,)),
        (segment.isin("HOUSEHOLD", "MACHINERY"), "user_info", "UPDATE", 1, (first, second)),
        (segment == "MACHINERY", "user_info", "DELETE", 2, (last,)))


def fact_change_records(orders: DataFrame, lineitem: DataFrame) -> DataFrame:
    """Changes of the fact tables, with other tables and operations among them that routing drops."""
    order = _texts(id=F.col("o_orderkey"), user_id=F.col("o_custkey"), order_status=F.col("o_orderstatus"),
                   total_amount=F.col("o_totalprice").cast("decimal(18,2)"))
    closed = _texts(id=F.col("o_orderkey"), order_status=F.lit("CLOSED"))
    detail = _texts(id=F.concat_ws("-", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"),
                    order_id=F.col("l_orderkey"), sku_id=F.col("l_partkey"),
                    split_total_amount=F.col("l_extendedprice").cast("decimal(18,2)"))
    filled, low = F.col("o_orderstatus") == "F", F.col("o_orderpriority") == "5-LOW"
    return _change_records(
        orders, (None, "order_info", "INSERT", 0, (order,)), (filled, "order_info", "UPDATE", 1, (order, closed)),
        (low, "order_info", "DELETE", 2, (order,)), (None, "sku_info", "INSERT", 0, (order,)),
        (filled, "order_info", "CREATE", 0, (order,)),
    ).unionByName(_change_records(
        lineitem, (None, "order_detail", "INSERT", 0, (detail,)),
        (F.col("l_returnflag") == "R", "order_detail", "UPDATE", 1, (detail,))))


def fact_records(rows: DataFrame, topic: str, key: str) -> DataFrame:
    """Typed rows as messages of a fact topic, every number as text, nulls left out."""
    payload = [F.col(c).cast("decimal(18,2)").cast("string").alias(c) if kind == "double"
               else F.col(c).cast("string").alias(c)
               for c, kind in rows.dtypes if c not in ("timestamp", "create_date", "create_hour")]
    return rows.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*payload)).alias("value"),
                       F.lit(topic).alias("topic"), F.lit(0).alias("partition"),
                       F.col(key).cast("bigint").alias("offset"), "timestamp")


HALF_SPAN = 1_296_000


def timed_user_changes(customer: DataFrame) -> DataFrame:
    """Changes of ``user_info`` over the time of the orders: inserted at its start as of gender M, then, at moments that
    follow from the key, F in the first half of the time and X in the second; each third key never changes."""
    key = F.col("c_custkey")
    moments = [F.lit(0), key * 7919 % HALF_SPAN, key * 104729 % HALF_SPAN + HALF_SPAN]
    birthday = F.date_format(F.date_add(F.lit("1965-01-01").cast("date"), (key * 37 % 16000).cast("int")), "yyyy-MM-dd")
    rows = [_texts(id=key, birthday=birthday, gender=F.lit("M")), _texts(id=key, gender=F.lit("F")),
            _texts(id=key, gender=F.lit("X"))]
    messages = [F.struct(F.timestamp_seconds(F.unix_seconds(F.lit(START).cast("timestamp")) + at).alias("timestamp"),
                         F.lit(i).cast("bigint").alias("offset"), _envelope("user_info", "INSERT" if not i else "UPDATE", row).alias("value"))
                for i, (at, row) in enumerate(zip(moments, rows))]
    sent = customer.select(F.explode(F.filter(F.array(*[F.when((key % 3 != 0) | (F.lit(i) == 0), m) for i, m in enumerate(messages)]),
                                              lambda m: m.isNotNull())).alias("m"))
    return sent.select(F.lit(None).cast("string").alias("key"), "m.value", F.lit("ODS_BASE_DB_C").alias("topic"),
                       F.lit(0).alias("partition"), "m.offset", "m.timestamp")


def insert_envelopes(rows: DataFrame, name: str) -> DataFrame:
    """Typed rows as inserts of a change log, a message for each row, with the arrival of the row."""
    payload = [(c, F.col(c).cast("decimal(18,2)") if kind == "double" else F.col(c))
               for c, kind in rows.dtypes if c not in ("timestamp", "create_date", "create_hour")]
    row = F.map_filter(_texts(**dict(payload)), lambda _, cell: cell.isNotNull())
    return rows.select(F.lit(None).cast("string").alias("key"), _envelope(name, "INSERT", row).alias("value"),
                       F.lit("ODS_BASE_DB_C").alias("topic"), F.lit(0).alias("partition"),
                       F.col("id").cast("bigint").alias("offset"), "timestamp")
