"""Scalar column functions over dates, keys, names and shares."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names, labels and limits that results must carry.
DIM_PREFIX = "DIM_"
FACT_PREFIX = "DWD_"
OPERATION_LETTERS = {"INSERT": "I", "UPDATE": "U", "DELETE": "D"}
ROWKEY_WIDTH = 10
MILLIS_PER_YEAR = 365 * 24 * 60 * 60 * 1000
AGE_BANDS = ("20岁以下", "20岁到30岁", "30岁以上")
GENDER_MALE, GENDER_FEMALE = "男", "女"
AGE_TITLE, GENDER_TITLE = "用户年龄占比", "用户性别占比"


def day_of_millis(ts: Column) -> Column:
    """Epoch milliseconds to ``yyyy-MM-dd`` in the session time zone."""
    return F.date_format(F.timestamp_millis(ts), "yyyy-MM-dd")


def hour_of_millis(ts: Column) -> Column:
    """Epoch milliseconds to a two-digit hour."""
    return F.date_format(F.timestamp_millis(ts), "HH")


def date_of_text(create_time: Column) -> Column:
    """The part before the blank of ``yyyy-MM-dd HH:mm:ss``."""
    return F.get(F.split(create_time, " "), F.lit(0))


def hour_of_text(create_time: Column) -> Column:
    """The hour of ``yyyy-MM-dd HH:mm:ss``; null when there is no time part."""
    return F.get(F.split(F.get(F.split(create_time, " "), F.lit(1)), ":"), F.lit(0))


def dim_rowkey(pk: Column) -> Column:
    """The key padded with zeros on the left to ten characters, then reversed. Longer keys are not cut."""
    text = pk.cast("string")
    padded = F.when(F.length(text) < ROWKEY_WIDTH, F.lpad(text, ROWKEY_WIDTH, "0")).otherwise(text)
    return F.reverse(padded)


def dim_table_name(table: Column) -> Column:
    """P10: name of the dimension table fed by a source table."""
    return F.concat(F.lit(DIM_PREFIX), F.upper(table))


def fact_topic_name(table: Column, operation: Column) -> Column:
    """P10: name of the topic for one source table and operation; null for other operations."""
    letter = F.lit(None).cast("string")
    for name, short in OPERATION_LETTERS.items():
        letter = F.when(operation == name, F.lit(short)).otherwise(letter)
    return F.concat(F.lit(FACT_PREFIX), F.upper(table), F.lit("_"), letter)


def age_in_years(birthday: Column, as_of: str | dt.date | dt.datetime | Column) -> Column:
    """Whole 365-day years between a birthday text and ``as_of``; null for an unreadable birthday."""
    moment = as_of if isinstance(as_of, Column) else F.lit(str(as_of))
    lived = F.unix_millis(moment.cast("timestamp")) - F.unix_millis(birthday.try_cast("timestamp"))
    return F.call_function("div", lived, F.lit(MILLIS_PER_YEAR)).cast("int")


def day_text(value: str | dt.date) -> str:
    """A day argument with or without dashes as ``yyyy-MM-dd``."""
    text = str(value)
    if len(text) == 8 and text.isdigit():
        return f"{text[:4]}-{text[4:6]}-{text[6:]}"
    return dt.date.fromisoformat(text).isoformat()


def day_before(value: str | dt.date) -> str:
    """The previous day."""
    return (dt.date.fromisoformat(day_text(value)) - dt.timedelta(days=1)).isoformat()


def age_band(age: Column) -> Column:
    """Label of the age band; null age has none."""
    return (F.when(age < 20, AGE_BANDS[0])
            .when(age < 30, AGE_BANDS[1])
            .when(age.isNotNull(), AGE_BANDS[2]))


def gender_label(gender: Column) -> Column:
    """``M`` is male, any other given value counts as female; null has none."""
    return F.when(gender == "M", GENDER_MALE).when(gender.isNotNull(), GENDER_FEMALE)


def percent(part: Column, total: Column) -> Column:
    """Share in percent, halves rounded up to one decimal; 0.0 when there is no total."""
    return F.coalesce(F.floor(F.try_divide(part, total) * 1000 + 0.5) / 10, F.lit(0.0))


def exact_sum(amount: Column) -> Column:
    """Sum of a money column that does not depend on row order: decimals inside, double outside."""
    return F.sum(amount.cast("decimal(18,2)")).cast("double")
