from __future__ import annotations

import pytest
from helpers import at, log_message, rows_of

from rtshop.operators import dau, logs

DAY = 86400


def test_normalize_adds_day_and_hour(records):
    rows = logs.normalize_logs(records([log_message("m1", at(0)), log_message("m2", at(12 * 3600 - 0.001)),
                                        log_message("m3", at(12 * 3600))]))
    assert rows_of(rows, "common.mid", "dt", "hr") == [
        ("m1", "2024-01-10", "12"), ("m2", "2024-01-10", "23"), ("m3", "2024-01-11", "00")]


def test_unreadable_logs_are_set_aside(records):
    bad = ["{broken", "", None, '{"common":{"mid":"x"}}', '{"common":{"mid":"x"},"ts":"soon"}', '"text"']
    source = records([log_message("m1", at(0)), *bad])
    assert logs.normalize_logs(source).count() == 1
    assert sorted(r["value"] or "" for r in logs.rejected_logs(source).collect()) == sorted(b or "" for b in bad)


def test_strict_raises(records):
    with pytest.raises(Exception, match="unreadable log record"):
        logs.normalize_logs(records(["{broken"]), strict=True).collect()
    assert logs.normalize_logs(records([log_message("m1", at(0))]), strict=True).count() == 1


def test_time_given_as_text(records):
    assert logs.normalize_logs(records(['{"common":{"mid":"m"},"ts":"1704888000000"}'])).first()["ts"] == 1704888000000


def test_first_page_views(records):
    rows = logs.normalize_logs(records([
        log_message("none", at(0), page=None), log_message("opening", at(0)), log_message("empty", at(0), page=""),
        log_message("later", at(0), page="home")]))
    assert rows_of(logs.first_page_views(rows), "common.mid") == [("empty",), ("opening",)]


def test_one_row_per_device_and_day(records):
    source = records([
        log_message("m1", at(10), uid="b"), log_message("m1", at(5), uid="a"), log_message("m1", at(7200)),
        log_message("m1", at(DAY)), log_message("m2", at(5)), log_message(None, at(5)),
        log_message("m3", at(1), page="home")])
    rows = logs.daily_active_devices(logs.normalize_logs(source), ["ts", "offset"])
    assert rows_of(rows, "dt", "mid", "uid", "hr") == [
        ("2024-01-10", "m1", "a", "12"), ("2024-01-10", "m2", "u", "12"), ("2024-01-11", "m1", "u", "12")]
    hours = logs.daily_active_devices(logs.normalize_logs(source), ["ts", "offset"], ["mid", "hr"])
    assert rows_of(hours) == [("m1", "12"), ("m1", "12"), ("m2", "12")]
    by_arrival = logs.daily_active_devices(logs.normalize_logs(source), ["offset"])
    assert ("2024-01-10", "m1", "b") in rows_of(by_arrival, "dt", "mid", "uid")


def test_counts_per_interval(records):
    rows = logs.normalize_logs(records([log_message("a", at(0)), log_message("b", at(4.999)),
                                        log_message("c", at(5)), log_message("d", at(60))]))
    start = 1704888000000
    assert rows_of(logs.count_by_interval(rows)) == [(start, 2), (start + 5000, 1), (start + 60000, 1)]


@pytest.fixture(scope="module")
def devices(spark):
    rows = [("a", "2024-01-10", "09"), ("b", "2024-01-10", "09"), ("c", "2024-01-10", "23"),
            ("a", "2024-01-09", "09"), ("d", "2024-01-09", "00"), ("e", "2024-01-07", "05")]
    return spark.createDataFrame(rows, "mid string, dt string, hr string")


def test_total(devices):
    assert rows_of(dau.dau_total(devices)) == [("2024-01-07", 1), ("2024-01-09", 2), ("2024-01-10", 3)]
    assert rows_of(dau.dau_total(devices, "20240110")) == [("2024-01-10", 3)]
    assert rows_of(dau.dau_total(devices, "2024-01-08")) == [("2024-01-08", 0)]


def test_hourly(devices):
    assert rows_of(dau.dau_hourly(devices, "2024-01-10"), "hr", "cnt") == [("09", 2), ("23", 1)]


def test_hourly_compare_fills_all_hours(devices):
    rows = {r["hr"]: (r["today"], r["yesterday"]) for r in dau.dau_hourly_compare(devices, "2024-01-10").collect()}
    assert sorted(rows) == [f"{h:02d}" for h in range(24)]
    assert {h: v for h, v in rows.items() if v != (0, 0)} == {"09": (2, 1), "23": (1, 0), "00": (0, 1)}


def test_hourly_compare_without_data(devices):
    rows = dau.dau_hourly_compare(devices, "2023-05-05").collect()
    assert len(rows) == 24 and all((r["today"], r["yesterday"]) == (0, 0) for r in rows)


def test_hourly_compare_of_all_days(devices):
    rows = dau.dau_hourly_compare(devices)
    assert rows.count() == 3 * 24
    seen = {(r["dt"], r["hr"]): (r["today"], r["yesterday"]) for r in rows.collect()}
    for day in ("2024-01-10", "2024-01-07"):
        single = {(day, r["hr"]): (r["today"], r["yesterday"])
                  for r in dau.dau_hourly_compare(devices, day).collect()}
        assert single == {key: value for key, value in seen.items() if key[0] == day}
