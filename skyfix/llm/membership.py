"""A bitmap of hashed keys as a table of bounded size: which rows surely have no partner.

The table has a row of 64 bits for about each key, and at most 2**SLOT_BITS rows, so it can
always be broadcast. Rows it rules out need no shuffle; the others go to an exact join.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import ceil, log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import merged

#: At most 2**20 rows of two longs: 16 MB.
SLOT_BITS = 20


@dataclass(frozen=True)
class Known:
    slots: int
    bits: DataFrame


def row_key(id_col: str, text_col: str) -> Column:
    """128 hashed bits of a row's id and text: what makes two rows the same document."""
    both = [F.col(f"`{id_col}`"), F.col(f"`{text_col}`")]
    return F.struct(F.xxhash64(F.lit(1), *both).alias("a"), F.xxhash64(F.lit(2), *both).alias("b"))


def packed(df: DataFrame, key: Column) -> DataFrame:
    """``df`` as ``row, key``, so that no column of it can clash with an operator's own."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"), key.alias("key"))


def _slot(keys: list[str], slots: int) -> Column:
    return F.xxhash64(F.lit("slot"), *keys).bitwiseAND(slots - 1)


def _bit(keys: list[str]) -> Column:
    return F.xxhash64(F.lit("bit"), *keys).bitwiseAND(63).cast("int")


def bitmap(df: DataFrame, keys: list[str]) -> Known:
    """The keys of a written table; its row count gives the size."""
    slots = 1 << min(SLOT_BITS, max(12, ceil(log2(df.count() + 1))))
    bit = F.expr("shiftleft(1L, _bit)")
    return Known(slots, df.select(_slot(keys, slots).alias("_slot"), _bit(keys).alias("_bit")).groupBy("_slot").agg(F.bit_or(bit).alias("_bits")))


def marked(df: DataFrame, keys: list[str], known: Known) -> DataFrame:
    """An operator's own rows with ``_maybe``: false where ``known``'s source lacks these keys."""
    out = df.withColumn("_slot", _slot(keys, known.slots)).withColumn("_bit", _bit(keys)).join(F.broadcast(known.bits), "_slot", "left")
    held = F.coalesce(F.expr("shiftright(_bits, _bit) & 1"), F.lit(0)) == 1
    return out.withColumn("_maybe", held).drop("_slot", "_bit", "_bits")


def without(df: DataFrame, gone: DataFrame, key: Column) -> DataFrame:
    """``df`` less the rows whose key is in ``gone`` (a written table with a column ``key``)."""
    split = marked(packed(df, key), ["key"], bitmap(gone, ["key"]))
    rest = merged(split.where("_maybe").select("row", "key"), gone, "key", "left_anti")
    return split.where("not _maybe").select("row").unionByName(rest.select("row")).select("row.*")


def one_of_each(df: DataFrame, repeated: DataFrame, key: Column) -> DataFrame:
    """``df`` with one row for each key of ``repeated`` (a written table with a column ``key``):
    the least by its columns; a hot key is reduced before the shuffle."""
    split = marked(packed(df, key), ["key"], bitmap(repeated, ["key"]))
    maybe = split.where("_maybe").select("row", "key")
    alone = split.where("not _maybe").select("row").unionByName(merged(maybe, repeated, "key", "left_anti").select("row"))
    one = merged(maybe, repeated, "key", "left_semi").groupBy("key").agg(F.min("row").alias("row"))
    return alone.unionByName(one.select("row")).select("row.*")
