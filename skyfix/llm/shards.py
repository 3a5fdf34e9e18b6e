"""Sharding by sampled splitters: shards of nearly equal bytes over one global key order.

Records are ordered by the hash of their text, then of their id, so copies of one text are
neighbours. A group of copies that is no larger than the largest record, or than a fortieth of
a shard, is never cut; larger ones are cut where a shard must end inside them. Keys are
sampled with a chance in proportion to their size (a bounded sample, whatever the input),
and their quantiles split the order into many fine ranges. Ranges that still hold too many
rows (many tiny records) are sampled again, row by row, and subdivided. Inside a range a
running sum, and before it the sum of all earlier ranges, give each record its exact place
among all bytes: the shard is the part of the total in which the middle of the record, or of
its uncut group, lies, so two shards differ by about one of these. Only keys, sizes and checksums are shuffled.

Defined results: a null text has no bytes and, like the empty one, checksum 0; a null id is
ordered by its hash; repeated rows (equal in id and text) are neighbours, each in a place of
its own, so that many of them can be subdivided like any other group; no rows give no shards; other columns
are ignored by ``assign``.
"""

from __future__ import annotations

import bisect
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .membership import bitmap, marked
from .shared import columns, written

LAW = "bytes"
#: Bytes that every record has besides its text.
RECORD_BYTES = 8
#: Fine ranges, at least and at most, rows for one of them, and keys sampled for each.
RANGES, MOST_RANGES, RANGE_ROWS, SAMPLED = 768, 16_384, 1_000_000, 16
#: The part of a shard up to which a group of copies is not cut.
WHOLE = 1 / 40
LEAST = -(2**63)
#: A range is overfull with more rows than so many times the mean.
OVERFULL = 2


def _drawn(keys: DataFrame, chance: F.Column) -> list[tuple[int, int]]:
    """Keys drawn with the given chance, which depends on nothing but the row."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit("drawn"), "k", "o"), 11).cast("double")) / float(1 << 53)
    return sorted((r.k, r.o) for r in keys.where(u < chance).select("k", "o").distinct().collect())


def _in_ranges(keys: DataFrame, splitters: list[tuple[int, int]]) -> DataFrame:
    """Adds ``r``: how many splitters are at or before a row's key."""
    first = np.array([k for k, _ in splitters], np.int64)
    second = np.array([o for _, o in splitters], np.int64)

    @F.pandas_udf("int")
    def place(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for k, o in batches:
            k, o = k.to_numpy(np.int64), o.to_numpy(np.int64)
            low, high = np.searchsorted(first, k, "left"), np.searchsorted(first, k, "right")
            for tied in np.unique(low[low < high]):  # splitters inside a group of copies
                rows = np.flatnonzero((low == tied) & (high > low))
                end = high[rows[0]]
                low[rows] = tied + np.searchsorted(second[tied:end], o[rows], "right")
            yield pd.Series(low.astype(np.int32))

    return keys.withColumn("r", place("k", "o"))


def splitters_of(keys: DataFrame) -> list[tuple[int, int]]:
    """Splitters of about equal bytes, more where ranges would hold too many rows."""
    total, rows = keys.agg(F.sum("size"), F.count("*")).first()
    if not rows:
        return []
    ranges = min(MOST_RANGES, max(RANGES, rows // RANGE_ROWS))
    drawn = _drawn(keys, F.col("size") * (ranges * SAMPLED / total))
    found = sorted({drawn[i * len(drawn) // ranges] for i in range(1, ranges)}) if drawn else []
    counted = {r.r: r.n for r in _in_ranges(keys, found).groupBy("r").agg(F.count("*").alias("n")).collect()}
    mean = rows / ranges
    over = [r for r, n in counted.items() if n > OVERFULL * mean]
    if over:
        again = _drawn(_in_ranges(keys, found).where(F.col("r").isin(over)), F.lit(ranges * SAMPLED / rows))
        by_range: dict[int, list] = {}
        for key in again:
            by_range.setdefault(bisect.bisect_right(found, key), []).append(key)
        for r, own in by_range.items():
            parts = max(1, round(counted[r] / mean))
            found = found + [own[i * len(own) // parts] for i in range(1, parts)]
    # A splitter inside a group goes to the group's start, but where a group has several.
    often = Counter(k for k, _ in set(found))
    return sorted({(k, o if often[k] > 1 else LEAST) for k, o in found})


def _apart(keys: DataFrame) -> DataFrame:
    """Keys, written, of which no two are equal."""
    twice = written(keys.groupBy("k", "o").agg(F.count("*").alias("n")).where("n > 1").select("k", "o"), "twice")
    if twice.isEmpty():
        return keys
    split = marked(keys, ["k", "o"], bitmap(twice, ["k", "o"]))
    own = F.when(F.col("_maybe"), F.xxhash64("o", F.monotonically_increasing_id())).otherwise(F.col("o"))
    return written(split.withColumn("o", own).drop("_maybe"), "keys-apart")


def assign(df: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, size, text_crc32, shard, slot`` of every row; slots are gapless from 0."""
    rows = columns(df, doc_id=id_col, text=text_col).withColumn("place", F.lit(None).cast("long"))
    return _assigned(rows, shards).drop("place")


def _assigned(rows: DataFrame, shards: int) -> DataFrame:
    """The same for rows ``doc_id, text, place``; ``place`` is handed on."""
    rows = rows.withColumn("text", F.coalesce("text", F.lit("")))
    keys = rows.select(
        "doc_id", "place", F.xxhash64("text").alias("k"), F.xxhash64("doc_id").alias("o"),
        (F.octet_length("text") + F.lit(RECORD_BYTES)).cast("long").alias("size"), F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
    )
    keys = _apart(written(keys, "keys"))
    ranged = written(_in_ranges(keys, splitters_of(keys)), "ranged")
    # One row per range, at most MOST_RANGES and their subdivisions: the driver adds them up.
    at, before, places, largest = 0, 0, [], 0
    for r in sorted(ranged.groupBy("r").agg(F.sum("size").alias("size"), F.count("*").alias("n"), F.max("size").alias("most")).collect()):
        places.append((r.r, before, at))
        before, at, largest = before + r.size, at + r.n, max(largest, r.most)
    offsets = rows.sparkSession.createDataFrame(places, "r int, bytes_before long, rows_before long")
    w = Window.partitionBy("r").orderBy("k", "o")
    until, ends = w.rowsBetween(Window.unboundedPreceding, Window.currentRow), Window.partitionBy("r").orderBy("k")  # equal keys together
    placed = ranged.withColumns({"sum": F.sum("size").over(until), "row": F.row_number().over(w), "group_end": F.sum("size").over(ends)})
    # The end of the group before is seen by a group's first row, and is the greatest so far.
    placed = placed.withColumn("own_begin", F.when(F.lag("k").over(w).isNull() | (F.lag("k").over(w) != F.col("k")), F.col("sum") - F.col("size")))
    placed = placed.withColumn("group_begin", F.max("own_begin").over(until))
    placed = placed.join(F.broadcast(offsets), "r")
    whole = F.col("group_end") - F.col("group_begin")
    fits = whole <= max(largest, before * WHOLE / shards)
    middle = F.col("bytes_before") + F.when(fits, (F.col("group_begin") + F.col("group_end")) / 2).otherwise(F.col("sum") - F.col("size") / 2)
    placed = placed.select("doc_id", "place", "size", "text_crc32", F.least(F.lit(shards - 1), F.floor(middle * (shards / max(before, 1)))).cast("int").alias("shard"), (F.col("rows_before") + F.col("row") - 1).alias("row"))
    placed = written(placed, "placed")
    first = placed.groupBy("shard").agg(F.min("row").alias("first"))  # a row per shard
    return placed.join(F.broadcast(first), "shard").select("doc_id", "place", "size", "text_crc32", "shard", (F.col("row") - F.col("first")).alias("slot"))


def write_shards(df: DataFrame, path: str, shards: int, id_col: str = "doc_id", text_col: str = "text") -> None:
    """The records themselves as Parquet, a folder per shard, each in the order of its slots, with
    their own columns beside ``shard`` and ``slot``; own columns of these names get underscores."""
    names: list[str] = []
    for name in df.columns:
        while name.lower() in {"shard", "slot", *map(str.lower, names)}:
            name += "_"
        names.append(name)
    rows = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), F.monotonically_increasing_id().alias("place"))
    rows = written(rows, "records")
    keys = rows.select(F.col(f"row.`{id_col}`").alias("doc_id"), F.col(f"row.`{text_col}`").alias("text"), "place")
    placed = rows.join(_assigned(keys, shards).select("place", "shard", "slot"), "place").repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot")
    own = [F.col(f"row.`{c}`").alias(new) for c, new in zip(df.columns, names)]
    placed.select(*own, "shard", "slot").write.partitionBy("shard").parquet(path)
