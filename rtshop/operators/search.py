"""Ranked search over a text field."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rtshop.functions.text import highlight, matches_any


def search_top(df: DataFrame, text: str, query: str, sort_by: str, key: str, fields: Sequence[str], size: int = 2,
               start: int = 0, pre: str = "<span>", post: str = "</span>") -> DataFrame:
    """Rows that hold any word of the query, largest ``sort_by`` first (ties by ``key``), from ``start`` on.

    Only ``fields`` are returned, with the marked text as ``highlight``, which is made for the returned rows only.
    """
    hits = df.filter(matches_any(F.col(text), query)).select(*dict.fromkeys([*fields, text, sort_by, key]))
    top = hits.orderBy(F.desc(sort_by), F.asc(key))
    top = (top.offset(start) if start else top).limit(size)
    return top.select(*fields, highlight(F.col(text), query, pre, post).alias("highlight"))
