from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from rtshop.functions import scalars as S
from rtshop.functions import text as X
from rtshop.functions.joins import broadcast_if_small


def one(spark, column):
    return spark.range(1).select(column.alias("c")).first()["c"]


@pytest.mark.parametrize(("key", "rowkey"), [
    ("1", "1000000000"), ("10", "0100000000"), ("1234567890", "0987654321"), ("123456789012", "210987654321"),
])
def test_rowkey_pads_but_never_cuts(spark, key, rowkey):
    assert one(spark, S.dim_rowkey(F.lit(key))) == rowkey


def test_rowkey_of_number(spark):
    assert one(spark, S.dim_rowkey(F.lit(42))) == "2400000000"


@pytest.mark.parametrize(("ts", "day", "hour"), [
    (1704931199999, "2024-01-10", "23"), (1704931200000, "2024-01-11", "00"), (0, "1970-01-01", "00"),
])
def test_day_and_hour_of_millis(spark, ts, day, hour):
    row = spark.range(1).select(S.day_of_millis(F.lit(ts)), S.hour_of_millis(F.lit(ts))).first()
    assert tuple(row) == (day, hour)


@pytest.mark.parametrize(("text", "day", "hour"), [
    ("2024-01-10 09:30:00", "2024-01-10", "09"), ("2024-01-10", "2024-01-10", None), (None, None, None),
])
def test_day_and_hour_of_text(spark, text, day, hour):
    value = F.lit(text).cast("string")
    assert tuple(spark.range(1).select(S.date_of_text(value), S.hour_of_text(value)).first()) == (day, hour)


@pytest.mark.parametrize(("birthday", "age"), [
    ("2004-01-15", 20),     # exactly 20 times 365 days
    ("2004-01-16", 19), ("2024-01-10", 0), ("2024-06-01", 0), ("2026-01-10", -2), ("", None), (None, None),
    ("nonsense", None), ("2003-01-10 00:00:00", 21),
])
def test_age_counts_years_of_365_days(spark, birthday, age):
    assert one(spark, S.age_in_years(F.lit(birthday).cast("string"), "2024-01-10")) == age


def test_age_boundary_day(spark):
    # Exactly 365 days, and one day less.
    assert one(spark, S.age_in_years(F.lit("2023-01-10"), "2024-01-10")) == 1
    assert one(spark, S.age_in_years(F.lit("2023-01-11"), "2024-01-10")) == 0


@pytest.mark.parametrize(("age", "band"), [(19, 0), (20, 1), (29, 1), (30, 2), (99, 2)])
def test_age_band(spark, age, band):
    assert one(spark, S.age_band(F.lit(age))) == S.AGE_BANDS[band]


def test_age_band_of_null(spark):
    assert one(spark, S.age_band(F.lit(None).cast("int"))) is None


@pytest.mark.parametrize(("gender", "label"), [("M", "男"), ("F", "女"), ("X", "女"), (None, None)])
def test_gender_label(spark, gender, label):
    assert one(spark, S.gender_label(F.lit(gender).cast("string"))) == label


@pytest.mark.parametrize(("part", "total", "share"), [
    (1.0, 3.0, 33.3), (2.0, 3.0, 66.7), (1.0, 2000.0, 0.1), (0.0, 5.0, 0.0), (5.0, 5.0, 100.0), (0.0, 0.0, 0.0),
    (None, None, 0.0), (1.0, 800.0, 0.1), (3.0, 2000.0, 0.2),
])
def test_percent(spark, part, total, share):
    assert one(spark, S.percent(F.lit(part).cast("double"), F.lit(total).cast("double"))) == share


def test_topic_and_table_names(spark):
    names = [one(spark, S.fact_topic_name(F.lit("order_info"), F.lit(kind)))
             for kind in ("INSERT", "UPDATE", "DELETE", "CREATE")]
    assert names == ["DWD_ORDER_INFO_I", "DWD_ORDER_INFO_U", "DWD_ORDER_INFO_D", None]
    assert one(spark, S.dim_table_name(F.lit("user_info"))) == "DIM_USER_INFO"


def test_day_arguments():
    assert S.day_text("20240110") == S.day_text("2024-01-10") == "2024-01-10"
    assert S.day_before("2024-03-01") == "2024-02-29"
    with pytest.raises(ValueError):
        S.day_text("10/01/2024")


@pytest.mark.parametrize(("text", "expected"), [
    ("Apple 手机 X-100", ["apple", "手", "机", "x", "100"]), ("", []), ("--", []), ("Ünï 9", ["ünï", "9"]),
])
def test_words(spark, text, expected):
    assert one(spark, X.words(F.lit(text))) == expected


@pytest.mark.parametrize(("text", "query", "every", "some"), [
    ("red widget", "red widget", True, True), ("red widget", "widget red", True, True),
    ("red widget", "RED", True, True), ("red widget", "red gear", False, True), ("red widget", "gear", False, False),
    ("red widget", "", False, False), ("红色手机", "手机", True, True), ("reds widget", "red", False, False),
    ("red widget", "red red", True, True),
])
def test_matching(spark, text, query, every, some):
    row = spark.range(1).select(X.matches_all(F.lit(text), query), X.matches_any(F.lit(text), query)).first()
    assert tuple(row) == (every, some)


def test_null_text_matches_nothing(spark):
    df = spark.createDataFrame([(None,), ("red",)], "name string")
    assert df.filter(X.matches_all(F.col("name"), "red")).count() == 1
    assert df.filter(X.matches_any(F.col("name"), "red")).count() == 1


@pytest.mark.parametrize(("text", "query", "marked"), [
    ("Operation Red Sea", "red sea", "Operation <span>Red</span> <span>Sea</span>"),
    ("no hit", "red", "no hit"), ("red-hot, red!", "red", "<span>red</span>-hot, <span>red</span>!"),
    ("reds", "red", "reds"), ("红手机", "手", "红<span>手</span>机"), ("a $1 \\ b", "b", "a $1 \\ <span>b</span>"),
])
def test_highlight(spark, text, query, marked):
    assert one(spark, X.highlight(F.lit(text), query)) == marked


def test_highlight_tags(spark):
    assert one(spark, X.highlight(F.lit("a b"), "b", "<em>", "</em>")) == "a <em>b</em>"


def test_broadcast_only_when_measured_small(spark):
    side = spark.range(100).withColumnRenamed("id", "k")

    def hinted(df):
        return "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(broadcast_if_small(side))
    assert not hinted(broadcast_if_small(side, max_rows=99))
    assert not hinted(broadcast_if_small(side, max_bytes=10))
