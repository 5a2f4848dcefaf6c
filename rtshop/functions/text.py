"""Keyword matching and highlighting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A word is one Han character, or a run of other letters and digits.
_WORD = r"[\p{IsHan}]|[\p{L}\p{N}&&[^\p{IsHan}]]+"
_PIECE = rf"{_WORD}|[^\p{{L}}\p{{N}}]+"


def words(text: Column) -> Column:
    """Lower-cased words of a text, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"({_WORD})"))


def matches_all(text: Column, query: str) -> Column:
    """every word of the query occurs in the text. A query without words matches nothing."""
    wanted = words(F.lit(query))
    return (F.size(wanted) > 0) & (F.size(F.array_except(wanted, words(text))) == 0)


def matches_any(text: Column, query: str) -> Column:
    """at least one word of the query occurs in the text."""
    return F.arrays_overlap(words(F.lit(query)), words(text))


def highlight(text: Column, query: str, pre: str = "<span>", post: str = "</span>") -> Column:
    """Wrap each word of the text that the query names; everything else stays as it was."""
    wanted = words(F.lit(query))
    pieces = F.regexp_extract_all(text, F.lit(f"({_PIECE})"))
    marked = F.transform(
        pieces,
        lambda piece: F.when(
            F.array_contains(wanted, F.lower(piece)), F.concat(F.lit(pre), piece, F.lit(post)),
        ).otherwise(piece),
    )
    return F.array_join(marked, "")
