"""Broadcasts behind a check of the side's size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 32 << 20


def small_side(df: DataFrame, limit: int | None = None, hashed: bool = False) -> DataFrame:
    """``df``, a stored table, marked for broadcast when its rows, measured as
    JSON text, have at most ``limit`` bytes (else ``BROADCAST_BYTES``).  A larger one is joined by a
    shuffle of two plain exchanges, whose hot partitions AQE splits; ``hashed`` for a side with far fewer
    rows than the other: a task then holds its share of this side and streams the other, which a merge would sort whole."""
    size = df.select(F.sum(F.length(F.to_json(F.struct(*df.columns)))).alias("n")).first()["n"]
    if (size or 0) <= (BROADCAST_BYTES if limit is None else limit):
        return F.broadcast(df)
    return df.hint("shuffle_hash") if hashed else df
