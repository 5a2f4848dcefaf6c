"""Reading JSON messages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rtshop.schemas import CORRUPT


def with_parsed(records: DataFrame, shape: T.StructType, name: str) -> DataFrame:
    """Add the parsed ``value`` as column ``name``; what cannot be read is in its ``_corrupt_record`` field.

    The struct goes through a one-element explode. A filter on it would otherwise be pushed below the projection and
    parse the text again for each of its conditions; it cannot pass the explode, so each text is parsed once.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": CORRUPT}
    parsed = F.from_json("value", shape, options)
    return records.select("*", F.explode_outer(F.array(parsed)).alias(name))
