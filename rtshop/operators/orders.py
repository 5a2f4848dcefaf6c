"""Orders and their details to order-wide rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rtshop.functions.joins import broadcast_if_small
from rtshop.functions.parsing import with_parsed
from rtshop.functions.scalars import age_in_years, date_of_text, hour_of_text
from rtshop.operators.keyed import first_by_key
from rtshop.schemas import CORRUPT, ORDER_DETAIL, ORDER_INFO, ORDER_WIDE, WIDE_FROM_DIMS

# Fixed value: how far apart an order and its detail may arrive.
MATCH_SECONDS = 600
# What a row is known and joined by; a message without it is unreadable.
ORDER_KEYS, DETAIL_KEYS = ("id",), ("id", "order_id")


# ---- typed rows ------------------------------------------------------------------------------------------------

def _text_shape(shape: T.StructType) -> T.StructType:
    """The shape with every field as text, so that numbers given as text can be read and bad ones be told apart."""
    return T.StructType([T.StructField(name, T.StringType()) for name in (*shape.names, CORRUPT)])


def _numbers(shape: T.StructType) -> list[T.StructField]:
    return [field for field in shape if not isinstance(field.dataType, T.StringType)]


def _is_readable(shape: T.StructType, keys: Sequence[str]) -> Column:
    ok = F.col("_row").isNotNull() & F.col(f"_row.{CORRUPT}").isNull()
    for field in _numbers(shape):
        cell = F.col(f"_row.{field.name}")
        number = cell.try_cast(field.dataType).isNotNull()
        ok = ok & (number if field.name in keys else F.coalesce(cell, F.lit("")).eqNullSafe("") | number)
    return ok


def typed_rows(records: DataFrame, shape: T.StructType, strict: bool = False, keys: Sequence[str] = ()) -> DataFrame:
    """Typed rows from JSON text. Absent or empty numbers become 0, numbers given as text are accepted.

    Messages that are no object, lack one of the ``keys``, or hold a text where a number belongs, are left out (see
    ``rejected_rows``); with ``strict`` they raise. Record columns other than ``key, value, topic`` are kept.
    """
    parsed = with_parsed(records, _text_shape(shape), "_row")
    if strict:
        parsed = parsed.withColumn("_row", F.when(_is_readable(shape, keys), F.col("_row")).otherwise(
            F.raise_error(F.concat(F.lit("unreadable row: "), F.coalesce("value", F.lit("null"))))))
    else:
        parsed = parsed.filter(_is_readable(shape, keys))
    columns = [F.col(name) for name in records.columns if name not in ("key", "value", "topic")]
    numbers = {field.name for field in _numbers(shape)}
    for field in shape:
        cell = F.col(f"_row.{field.name}")
        if field.name in numbers:
            cell = F.coalesce(cell.try_cast(field.dataType), F.lit(0).cast(field.dataType))
        columns.append(cell.alias(field.name))
    return parsed.select(*columns)


def rejected_rows(records: DataFrame, shape: T.StructType, keys: Sequence[str] = ()) -> DataFrame:
    """The records that ``typed_rows`` leaves out, as they came."""
    return with_parsed(records, _text_shape(shape), "_row").filter(~_is_readable(shape, keys)).drop("_row")


def order_rows(records: DataFrame, strict: bool = False) -> DataFrame:
    """Typed orders with ``create_date`` and ``create_hour``. An order has an id."""
    return with_order_day(typed_rows(records, ORDER_INFO, strict, ORDER_KEYS))


def detail_rows(records: DataFrame, strict: bool = False) -> DataFrame:
    """Typed order details. A detail has an id and names its order."""
    return typed_rows(records, ORDER_DETAIL, strict, DETAIL_KEYS)


def rejected_orders(records: DataFrame) -> DataFrame:
    """The records that ``order_rows`` leaves out."""
    return rejected_rows(records, ORDER_INFO, ORDER_KEYS)


def rejected_details(records: DataFrame) -> DataFrame:
    """The records that ``detail_rows`` leaves out."""
    return rejected_rows(records, ORDER_DETAIL, DETAIL_KEYS)


def with_order_day(orders: DataFrame) -> DataFrame:
    """Add ``create_date`` and ``create_hour`` from ``create_time``."""
    return orders.withColumns({"create_date": date_of_text(F.col("create_time")),
                               "create_hour": hour_of_text(F.col("create_time"))})


# ---- copies ----------------------------------------------------------------------------------------------------

def one_row_per_order(orders: DataFrame, arrival: Sequence[str] = ("timestamp", "partition", "offset")) -> DataFrame:
    """Drop repeated copies of an order: the one that arrived first stays, by those of ``arrival`` it has. Batch.

    Makes every join with details many-to-one, whatever was replayed. The key also holds a column that follows from
    ``id``: with it the result is not laid out by ``id`` alone, so a join by order id gets an exchange of its own on
    both sides, and AQE may split that exchange when one order holds much of the details. The price is a second
    shuffle of all orders.
    """
    laid_out = orders.withColumn("_layout", F.pmod("id", F.lit(2)))
    present = [name for name in arrival if name in orders.columns]
    return first_by_key(laid_out, ["id", "_layout"], present).drop("_layout")


def distinct_details(details: DataFrame) -> DataFrame:
    """A2: set-collapse of identical detail rows; the arrival that is kept is the first. Batch.

    Record columns are not part of the row. Hash aggregation that combines before the shuffle.
    """
    columns = [name for name in details.columns if name not in ("partition", "offset", "timestamp")]
    if "timestamp" not in details.columns:
        return details.select(*columns).distinct()
    return details.groupBy(*columns).agg(F.min("timestamp").alias("timestamp"))


# ---- dimensions ------------------------------------------------------------------------------------------------

def _require_match(found: Column, value: Column, what: str, key: str, strict: bool) -> Column:
    if not strict:
        return value
    message = F.concat(F.lit(f"no {what} for "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    return F.when(found, value).otherwise(F.raise_error(message))


def with_user(orders: DataFrame, users: DataFrame, as_of, strict: bool = False) -> DataFrame:
    """Add ``user_age`` and ``user_gender``. Unknown users give nulls, or raise with ``strict``.

    An equi-join left to the optimizer: users grow with the data. Both sides reach it by an exchange on the numeric
    key, which AQE splits when one user holds much of the orders.
    """
    side = users.select(F.col("id").try_cast("bigint").alias("_user"), "birthday", "gender")
    joined = orders.join(side, orders["user_id"] == side["_user"], "left")
    found = F.col("_user").isNotNull()
    return joined.select(
        *[F.col(name) for name in orders.columns],
        _require_match(found, age_in_years(F.col("birthday"), as_of), "user", "user_id", strict).alias("user_age"),
        F.col("gender").alias("user_gender"))


def with_province(orders: DataFrame, provinces: DataFrame, strict: bool = False) -> DataFrame:
    """Add the four province attributes. The province side is measured before it is broadcast."""
    side = provinces.select(
        F.col("id").try_cast("bigint").alias("_province"), F.col("name").alias("province_name"),
        F.col("area_code").alias("province_area_code"), F.col("iso_3166_2").alias("province_3166_2_code"),
        F.col("iso_code").alias("province_iso_code"))
    side = broadcast_if_small(side)
    joined = orders.join(side, orders["province_id"] == side["_province"], "left")
    found = F.col("_province").isNotNull()
    name = _require_match(found, F.col("province_name"), "province", "province_id", strict)
    return joined.select(*[F.col(c) for c in orders.columns], name.alias("province_name"), "province_area_code",
                         "province_3166_2_code", "province_iso_code")


# ---- order with detail -----------------------------------------------------------------------------------------

def _prefixed(df: DataFrame, prefix: str) -> DataFrame:
    return df.select(*[F.col(name).alias(f"{prefix}{name}") for name in df.columns])


def order_detail_pairs(orders: DataFrame, details: DataFrame) -> DataFrame:
    """Every detail with its order; columns come prefixed ``o_`` and ``d_``. Expects one row per order."""
    left, right = _prefixed(details, "d_"), _prefixed(orders, "o_")
    return left.join(right, left["d_order_id"] == right["o_id"], "inner")


def order_detail_full_outer(orders: DataFrame, details: DataFrame) -> DataFrame:
    """Full outer join by order id; prefixed columns and ``match`` (``both``, ``order``, ``detail``).

    Spark cannot split a hot key of a full outer join. The same rows come from a left join of the details, which it
    can split, and the orders whose id no detail names; the ids are made distinct before they are shuffled.
    """
    left, right = _prefixed(details, "d_"), _prefixed(orders, "o_")
    with_detail = left.join(right, left["d_order_id"] == right["o_id"], "left")
    named = left.select(F.col("d_order_id").alias("_named")).distinct()
    without_detail = right.join(named, right["o_id"] == named["_named"], "left_anti")
    match = F.when(F.col("o_id").isNotNull(), "both").otherwise("detail")
    return (with_detail.withColumn("match", match)
            .unionByName(without_detail.withColumn("match", F.lit("order")), allowMissingColumns=True))


def order_detail_interval(orders: DataFrame, details: DataFrame, seconds: int = MATCH_SECONDS) -> DataFrame:
    """Pairs whose order and detail arrived within ``seconds`` of each other, whichever came first.

    Expects one row per order. The comparison is on the record column ``timestamp``; both bounds are included. Where
    both sides carry a ``_salt`` column it is part of the key.
    """
    left, right = _prefixed(details, "d_"), _prefixed(orders, "o_")
    reach = F.make_dt_interval(secs=F.lit(seconds))
    same = left["d_order_id"] == right["o_id"]
    if "_salt" in details.columns and "_salt" in orders.columns:
        same = same & (left["d__salt"] == right["o__salt"])
    near = ((left["d_timestamp"] >= right["o_timestamp"] - reach)
            & (left["d_timestamp"] <= right["o_timestamp"] + reach))
    return left.join(right, same & near, "inner")


def wide_rows(pairs: DataFrame, arrival: bool = False) -> DataFrame:
    """Order-wide rows from prefixed pairs.

    Where both rows have a column the detail's value is taken, so ``create_time`` is the detail's, while
    ``create_date`` and ``create_hour`` are the order's. Dimension columns are there if the orders had them. ``dt``,
    added last, is the day the row is stored under. With ``arrival`` the order's arrival comes along as ``arrived``.
    """
    present = set(pairs.columns)
    columns = []
    for name in ORDER_WIDE:
        source = {"detail_id": "d_id", "order_id": "o_id"}.get(name)
        if source is None:
            source = f"d_{name}" if f"d_{name}" in present else f"o_{name}"
        if source in present or name not in WIDE_FROM_DIMS:
            columns.append(F.col(source).alias(name))
    arrived = [F.col("o_timestamp").alias("arrived")] if arrival else []
    return pairs.select(*columns, *arrived, F.col("o_create_date").alias("dt"))


def order_wide(orders: DataFrame, details: DataFrame, users: DataFrame | None, provinces: DataFrame | None, as_of=None,
               strict: bool = False) -> DataFrame:
    """The whole pipeline over tables. Dimensions join the orders, the smaller side, first. Batch.

    A dimension given as None is not joined, and its columns are not there: for questions that do not ask for it.
    """
    enriched = one_row_per_order(orders)
    if users is not None:
        enriched = with_user(enriched, users, as_of, strict)
    if provinces is not None:
        enriched = with_province(enriched, provinces, strict)
    return wide_rows(order_detail_pairs(enriched, details))
