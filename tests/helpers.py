"""Helpers of the tests: messages, rows, plans."""

from __future__ import annotations

import datetime as dt
import json

START = dt.datetime(2024, 1, 10, 12, 0, 0, tzinfo=dt.timezone.utc)


def at(seconds: float) -> dt.datetime:
    """A moment ``seconds`` after the start of the test day."""
    return START + dt.timedelta(seconds=seconds)


def millis(moment: dt.datetime) -> int:
    return int(moment.timestamp() * 1000)


def as_value(message) -> str | None:
    return message if message is None or isinstance(message, str) else json.dumps(message, ensure_ascii=False)


def rows_of(df, *columns) -> list[tuple]:
    """Rows as sorted tuples, of the named columns or of all."""
    return sorted((tuple(row) for row in (df.select(*columns) if columns else df).collect()), key=repr)


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def log_message(mid, moment, page="first", **common) -> dict:
    """An application log message; ``page`` is ``None``, ``"first"``, or the page before."""
    message = {"common": {"mid": mid, "uid": "u", "ar": "1", "ch": "web", "vc": "v1", **common},
               "ts": millis(moment)}
    if page == "first":
        message["page"] = {"page_id": "home"}
    elif page is not None:
        message["page"] = {"page_id": "home", "last_page_id": page}
    return message


def change(table, kind, *rows, pk=("id",)) -> dict:
    return {"database": "shop", "table": table, "type": kind, "pkNames": list(pk), "data": list(rows)}


def order_message(order_id, user=1, province=1, **more) -> dict:
    return {"id": order_id, "user_id": user, "province_id": province, "total_amount": 10.5,
            "create_time": "2024-01-10 12:00:00", **more}


def detail_message(detail_id, order_id, amount=5.0, name="red widget", **more) -> dict:
    return {"id": detail_id, "order_id": order_id, "sku_id": 7, "order_price": 2.5, "sku_num": 2, "sku_name": name,
            "create_time": "2024-01-10 12:00:30", "split_total_amount": amount, **more}
