from __future__ import annotations

import pytest
from helpers import at, detail_message, order_message, rows_of

from rtshop.operators import keyed, orders
from rtshop.schemas import ORDER_DETAIL, ORDER_INFO, ORDER_WIDE

AS_OF = "2024-01-10"


@pytest.fixture(scope="module")
def users(spark):
    rows = [("1", "ann", "2004-01-16", "F"), ("2", "bob", "1990-01-01", "M"), ("3", "cat", "", None)]
    return spark.createDataFrame(rows, "id string, name string, birthday string, gender string")


@pytest.fixture(scope="module")
def provinces(spark):
    return spark.createDataFrame([("1", "north", "110000", "CN-01", "CN-N")],
                                 "id string, name string, area_code string, iso_code string, iso_3166_2 string")


def test_typed_rows_have_defaults_and_accept_texts(records):
    source = records(['{"id":"12","total_amount":"7.25","user_id":3,"order_status":"P","feight_fee":""}'])
    row = orders.typed_rows(source, ORDER_INFO).first()
    assert (row["id"], row["total_amount"], row["user_id"], row["order_status"]) == (12, 7.25, 3, "P")
    assert (row["feight_fee"], row["province_id"], row["create_time"]) == (0.0, 0, None)
    detail = orders.detail_rows(records(['{"id":1,"order_id":2}'])).first()
    assert (detail["split_total_amount"], detail["sku_name"]) == (0.0, None)


def test_bad_rows_are_set_aside(records):
    source = records([order_message(1), "{", None, "[1]", '{"id":"x1"}'])
    assert rows_of(orders.order_rows(source), "id") == [(1,)]
    assert orders.rejected_rows(source, ORDER_INFO).count() == 4
    with pytest.raises(Exception, match="unreadable row"):
        orders.order_rows(source, strict=True).collect()


def test_day_and_hour_of_order(records):
    source = records([order_message(1), order_message(2, create_time=None), order_message(3, create_time="2024-02-03")])
    assert rows_of(orders.order_rows(source), "id", "create_date", "create_hour") == [
        (1, "2024-01-10", "12"), (2, None, None), (3, "2024-02-03", None)]


def test_first_copy_of_an_order_stays(records):
    source = records([(order_message(1, order_status="second"), 9), (order_message(1, order_status="first"), 2),
                      (order_message(2, order_status="only"), 1)])
    rows = orders.one_row_per_order(orders.order_rows(source))
    assert rows_of(rows, "id", "order_status") == [(1, "first"), (2, "only")]
    assert rows.columns == orders.order_rows(source).columns


def test_identical_details_collapse(records):
    source = records([(detail_message(1, 1), 5), (detail_message(1, 1), 3), (detail_message(2, 1), 4)])
    rows = orders.distinct_details(orders.detail_rows(source))
    assert [(r["id"], r["timestamp"].second) for r in rows.orderBy("id").collect()] == [(1, 3), (2, 4)]


def test_user_attributes(records, users):
    source = orders.order_rows(records([order_message(1, user=1), order_message(2, user=2),
                                        order_message(3, user=3), order_message(4, user=99)]))
    joined = orders.with_user(source, users, AS_OF)
    assert rows_of(joined, "id", "user_age", "user_gender") == [
        (1, 19, "F"), (2, 34, "M"), (3, None, None), (4, None, None)]
    with pytest.raises(Exception, match="no user for 99"):
        orders.with_user(source, users, AS_OF, strict=True).collect()


def test_province_attributes(records, provinces):
    source = orders.order_rows(records([order_message(1, province=1), order_message(2, province=7)]))
    columns = ("id", "province_name", "province_area_code", "province_iso_code", "province_3166_2_code")
    assert rows_of(orders.with_province(source, provinces), *columns) == [
        (1, "north", "110000", "CN-01", "CN-N"), (2, None, None, None, None)]
    with pytest.raises(Exception, match="no province for 7"):
        orders.with_province(source, provinces, strict=True).collect()


def sides(records, order_list, detail_list):
    return orders.order_rows(records(order_list)), orders.detail_rows(records(detail_list))


def test_full_outer(records):
    left, right = sides(records, [order_message(1), order_message(2)],
                        [detail_message(10, 1), detail_message(11, 1), detail_message(12, 3)])
    rows = orders.order_detail_full_outer(left, right)
    assert rows_of(rows, "o_id", "d_id", "match") == [
        (1, 10, "both"), (1, 11, "both"), (2, None, "order"), (None, 12, "detail")]


@pytest.mark.parametrize("order_at", [0, 1000])
def test_interval_bounds(records, order_at):
    offsets = (-601, -600, -1, 0, 1, 600, 601)
    left, right = sides(records, [(order_message(1), order_at)],
                        [(detail_message(i, 1), order_at + s) for i, s in enumerate(offsets)])
    assert rows_of(orders.order_detail_interval(left, right), "d_id") == [(1,), (2,), (3,), (4,), (5,)]


def test_interval_needs_the_same_order(records):
    left, right = sides(records, [(order_message(1), 0)], [(detail_message(1, 2), 0)])
    assert orders.order_detail_interval(left, right).count() == 0


def test_order_wide(records, users, provinces):
    left, right = sides(
        records, [(order_message(1, user=2, order_status="P"), 0), (order_message(1, user=2, order_status="P"), 5),
                  order_message(2)],
        [detail_message(10, 1, amount=3.5), detail_message(11, 1, sku_name="x"), detail_message(12, 9)])
    wide = orders.order_wide(left, right, users, provinces, AS_OF)
    assert tuple(wide.columns) == (*ORDER_WIDE, "dt")
    assert rows_of(wide, "detail_id", "order_id", "split_total_amount", "user_age", "province_name") == [
        (10, 1, 3.5, 34, "north"), (11, 1, 5.0, 34, "north")]
    row = wide.filter("detail_id = 10").first()
    # The detail's create_time wins; the day and hour are the order's.
    assert (row["create_time"], row["create_date"], row["create_hour"], row["dt"]) == (
        "2024-01-10 12:00:30", "2024-01-10", "12", "2024-01-10")
    assert (row["total_amount"], row["order_status"], row["sku_num"]) == (10.5, "P", 2)


def test_wide_types(records, users, provinces):
    left, right = sides(records, [order_message(1)], [detail_message(1, 1)])
    types = dict(orders.order_wide(left, right, users, provinces, AS_OF).dtypes)
    source = {**dict(orders.typed_rows(records([]), ORDER_INFO).dtypes),
              **dict(orders.typed_rows(records([]), ORDER_DETAIL).dtypes)}
    for name, kind in types.items():
        if name in source:
            assert kind == source[name], name
    assert types["user_age"] == "int" and types["detail_id"] == types["order_id"] == "bigint"


def test_latest_and_first_by_key(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 3, "y"), ("a", 2, "z"), ("b", 1, None)], "k string, n int, v string")
    assert rows_of(keyed.latest_by_key(df, ["k"], ["n"])) == [("a", 3, "y"), ("b", 1, None)]
    assert rows_of(keyed.first_by_key(df, ["k"], ["n"])) == [("a", 1, "x"), ("b", 1, None)]


def test_moments_are_kept(records):
    rows = orders.order_rows(records([(order_message(1), 42)])).collect()
    assert rows[0]["timestamp"] == at(42).replace(tzinfo=None)
