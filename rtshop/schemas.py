"""Row shapes of the inputs and results."""

from __future__ import annotations

from pyspark.sql import types as T

# One message of a keyed text stream.
RECORD = T.StructType([
    T.StructField("key", T.StringType()),
    T.StructField("value", T.StringType()),
    T.StructField("topic", T.StringType()),
    T.StructField("partition", T.IntegerType()),
    T.StructField("offset", T.LongType()),
    T.StructField("timestamp", T.TimestampType()),
])

CORRUPT = "_corrupt_record"

# Application log. Scalars are read as text so that numbers given as strings are accepted, and cast afterwards.
LOG_COMMON = T.StructType([T.StructField(n, T.StringType()) for n in ("mid", "uid", "ar", "ch", "vc")])
LOG_PAGE = T.StructType([T.StructField("last_page_id", T.StringType())])
APP_LOG = T.StructType([
    T.StructField("common", LOG_COMMON),
    T.StructField("page", LOG_PAGE),
    T.StructField("ts", T.StringType()),
    T.StructField(CORRUPT, T.StringType()),
])

# Change-log envelope: one message, any number of changed rows, every cell as text.
CHANGE_ENVELOPE = T.StructType([
    T.StructField("database", T.StringType()),
    T.StructField("table", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("pkNames", T.ArrayType(T.StringType())),
    T.StructField("data", T.ArrayType(T.MapType(T.StringType(), T.StringType()))),
    # Of a snapshot: when its reading began, in epoch milliseconds.
    T.StructField("as_of", T.LongType()),
    T.StructField(CORRUPT, T.StringType()),
])

DAU_COLUMNS = ("mid", "uid", "ar", "ch", "vc", "dt", "hr", "ts")

# Source columns of the two fact streams; numbers that are absent become 0, texts stay null.
ORDER_INFO = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("province_id", T.LongType()),
    T.StructField("order_status", T.StringType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("total_amount", T.DoubleType()),
    T.StructField("activity_reduce_amount", T.DoubleType()),
    T.StructField("coupon_reduce_amount", T.DoubleType()),
    T.StructField("original_total_amount", T.DoubleType()),
    T.StructField("feight_fee", T.DoubleType()),
    T.StructField("feight_fee_reduce", T.DoubleType()),
    T.StructField("expire_time", T.StringType()),
    T.StructField("refundable_time", T.StringType()),
    T.StructField("create_time", T.StringType()),
    T.StructField("operate_time", T.StringType()),
])
ORDER_DETAIL = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("order_id", T.LongType()),
    T.StructField("sku_id", T.LongType()),
    T.StructField("order_price", T.DoubleType()),
    T.StructField("sku_num", T.LongType()),
    T.StructField("sku_name", T.StringType()),
    T.StructField("create_time", T.StringType()),
    T.StructField("split_total_amount", T.DoubleType()),
    T.StructField("split_activity_amount", T.DoubleType()),
    T.StructField("split_coupon_amount", T.DoubleType()),
])

# Order-wide row, in column order; the sources of its columns are below.
ORDER_WIDE = (
    "detail_id", "order_id", "sku_id", "order_price", "sku_num", "sku_name", "split_total_amount",
    "split_activity_amount", "split_coupon_amount", "province_id", "order_status", "user_id", "total_amount",
    "activity_reduce_amount", "coupon_reduce_amount", "original_total_amount", "feight_fee", "feight_fee_reduce",
    "expire_time", "refundable_time", "create_time", "operate_time", "create_date", "create_hour", "province_name",
    "province_area_code", "province_3166_2_code", "province_iso_code", "user_age", "user_gender",
)
WIDE_FROM_DIMS = ORDER_WIDE[-6:]
