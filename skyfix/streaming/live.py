"""Live feeds: watermarked rates per aircraft, and a pin that locks, holds and lets go."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

#: Share of a new measurement in the smoothed value; misses after which a pin lets go.
SHARE, MISSES = 0.6, 10


def windowed(feed: DataFrame, key: str, ts: str, value: str, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count, mean and range per key and window; rows later than the watermark are dropped."""
    w = F.window(ts, width)
    return feed.withWatermark(ts, late).groupBy(w, key).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"))


def pins(feed: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """Smoothed value of each pin over its measurements (null is a miss): ``lock``, ``hold``
    while it misses, ``lost`` after ten misses in a row; state lives with the key."""

    def step(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        smooth, misses = state.get if state.exists else (None, 0)
        rows = pd.concat(list(batches)).sort_values(order, kind="stable")
        out = []
        for at, v in zip(rows[order], rows[value]):
            if pd.notna(v):
                smooth, misses = (v if smooth is None else smooth + SHARE * (v - smooth)), 0
            else:
                misses += 1
                smooth = None if misses >= MISSES else smooth
            mode = "lost" if smooth is None else "hold" if misses else "lock"
            out.append((k[0], at, smooth, mode))
        state.update((smooth, misses))
        yield pd.DataFrame(out, columns=[key, order, "smooth", "mode"])

    kinds = {c: feed.schema[c].dataType.simpleString() for c in (key, order)}
    return feed.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {order} {kinds[order]}, smooth double, mode string", "smooth double, misses int", "append", GroupStateTimeout.NoTimeout)
