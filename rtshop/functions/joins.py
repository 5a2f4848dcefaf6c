"""Join helpers that keep broadcasts bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_ROWS = 20_000
BROADCAST_BYTES = 8 * 1024 * 1024


def broadcast_if_small(df: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only when the side was measured and is small; otherwise leave the choice to the optimizer.

    The measurement reads at most ``max_rows + 1`` rows, so it stays cheap when the side turns out to be large.
    """
    width = F.octet_length(F.to_json(F.struct(*[F.col(f"`{name}`") for name in df.columns])))
    size = (df.limit(max_rows + 1)
            .agg(F.count(F.lit(1)).alias("rows"), F.coalesce(F.sum(width), F.lit(0)).alias("bytes"))
            .first())
    if size["rows"] <= max_rows and size["bytes"] <= max_bytes:
        return F.broadcast(df)
    return df
