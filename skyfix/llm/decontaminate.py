"""Benchmark decontamination by spaced seeds.

Tokens are lower-cased runs of word characters. A seed is a fixed mask over a span of tokens
that ignores some positions; hashes of what it keeps are joined between test and training
texts. Around every hit the aligned tokens of both sides are compared: an overlap counts when
some ``OVERLAP`` (13) tokens in a row, or a whole shorter item, agree in at least 80 %.

* Items of 13 tokens or more: two masks over 8 tokens, chosen so that any 13 aligned tokens
  with at most two substitutions hold a hit of one of them, wherever the substitutions are.
* Shorter items: masks over the whole item, one set for each length that the benchmark has.
  Up to 4 tokens nothing may differ, and the mask keeps all. Up to 9 tokens one may, and each
  mask ignores one position. Up to 12 two may: the positions are cut into five parts and each
  mask ignores two of them, which holds any two positions.

Items of fewer than ``LEAST_TOKENS`` tokens say too little to convict a document (the item "the"
would convict all); they match nothing, and ``short_items`` lists them.

So every overlap that verification would accept has a seed. A bitmap of the test hashes, 8 MB
or for a very large benchmark up to 32 MB, goes to the tasks that read the training texts: positions
it rules out have no partner, and nothing of them leaves the task. The rest meets the test
hashes in shuffled joins, never a broadcast of the benchmark. Equal contexts are merged before
the join, so a passage that many documents or items share is verified once; documents and
items are joined back to what agreed.

Defined results: null or blank texts match nothing; repeated items each give their rows;
repeated ids give one row per id and item; rows with a null id are not reported (but ``clean``
judges them by their text); an empty benchmark matches nothing; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations
from math import ceil, log2

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .membership import row_key, without
from .rolling import ByteHash, mixed, spans
from .shared import columns, sliced, written

TOKEN = re.compile(r"\w+")
SPAN = 8
MASKS = ((0, 1, 2, 3, 6, 7), (0, 1, 3, 5, 6, 7))
OVERLAP = 13
SIMILARITY = 0.8
#: Tokens that an item must have to be looked for.
LEAST_TOKENS = 5
#: The bitmap has 2**20 words of 64 bits, up to 2**22 where there are more hashes than words.
SLOT_BITS = (20, 22)
#: Parts of an item of which two may hold substitutions.
PARTS = 5


def masks_of(size: int) -> tuple[tuple[int, ...], ...]:
    """The masks over items of ``size`` tokens; those of ``OVERLAP`` or more share one set."""
    if size >= OVERLAP:
        return MASKS
    changes = size - ceil(SIMILARITY * size)
    if not changes:
        return (tuple(range(size)),)
    parts = size if changes == 1 else PARTS
    return tuple(tuple(i for i in range(size) if i * parts // size not in gone) for gone in combinations(range(parts), changes))


def token_hashes(text: str | None, hasher: ByteHash) -> np.ndarray:
    tokens = [t.encode("utf-8", "surrogatepass") for t in TOKEN.findall((text or "").lower())]
    flat, first, end = spans(tokens)
    return hasher.ranges(flat, first, end) if tokens else np.zeros(0, np.uint64)


def seeds(tokens: np.ndarray, size: int = OVERLAP) -> list[np.ndarray]:
    """For each mask over items of ``size`` tokens the hash at every position."""
    n = len(tokens) - min(size, SPAN if size >= OVERLAP else size) + 1
    out = []
    for k, mask in enumerate(masks_of(size)):
        h = np.full(max(n, 0), (min(size, OVERLAP) << 8) + k, np.uint64)
        for offset in mask:
            h = h * np.uint64(0x100000001B3) + tokens[offset : offset + n] if n > 0 else h
        out.append(mixed(h))
    return out


def contexts(tokens: np.ndarray, at: np.ndarray, filler: int) -> np.ndarray:
    """Low halves of the tokens from ``OVERLAP`` before each position to ``OVERLAP`` after its span."""
    padded = np.concatenate([np.full(OVERLAP, filler, np.int32), tokens.astype(np.uint32).view(np.int32), np.full(OVERLAP + SPAN, filler, np.int32)])
    return padded[at[:, None] + np.arange(2 * OVERLAP + SPAN)]


def _seeded(rows: DataFrame, filler: int, sizes: list[int] | None, held: np.ndarray | None) -> DataFrame:
    """``id, key, size, context`` of every seed: of an item, by its own length (``sizes`` is
    None); of a text, by each of ``sizes`` and where the bitmap has it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = ByteHash()
        for batch in sliced(batches):
            out: list[list] = [[] for _ in range(4)]
            for i, text in enumerate(batch.column(1).to_pylist()):
                tokens = token_hashes(text, hasher)
                if not len(tokens):
                    continue
                for size in [min(len(tokens), OVERLAP)] if sizes is None else sizes:
                    for keys in seeds(tokens, size):
                        at = np.arange(len(keys))
                        if held is not None:
                            at = np.flatnonzero((held[(keys >> np.uint64(6)) & np.uint64(len(held) - 1)] >> (keys & np.uint64(63))) & np.uint64(1))
                        if len(at):
                            for x, v in zip(out, (np.full(len(at), i), keys[at].view(np.int64), np.full(len(at), size), contexts(tokens, at, filler))):
                                x.append(v)
            n = sum(map(len, out[0]))
            owner, key, size = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in out[:3])
            flat = np.concatenate(out[3]).ravel() if n else np.zeros(0, np.int32)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * (2 * OVERLAP + SPAN), pa.int32()), pa.array(flat, pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), pa.array(key, pa.int64()), pa.array(size, pa.int64()), lists], names=["id", "key", "size", "context"])

    made = rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, key long, size long, context array<int>")
    return made.withColumn("print", F.xxhash64("context"))


def short_items(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text", least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """``item_id, n_tokens`` of the items that are too short to be looked for."""
    rows = columns(benchmark, item_id=item_col, text=text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            n = pa.array([len(TOKEN.findall((t or "").lower())) for t in batch.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), n], names=["item_id", "n_tokens"])

    counted = rows.mapInArrow(run, f"item_id {rows.schema['item_id'].dataType.simpleString()}, n_tokens long")
    return counted.where(F.col("n_tokens") < least_tokens)


def _bitmap(test: DataFrame, count: int) -> np.ndarray:
    """At most 2**22 words come to the driver, as Arrow, whatever the benchmark's size."""
    low, high = SLOT_BITS
    words = 1 << min(high, max(low, ceil(log2(count + 1))))
    slot = F.shiftrightunsigned("key", 6).bitwiseAND(words - 1)
    bits = test.select(slot.alias("slot"), F.expr("shiftleft(1L, cast(key & 63 as int))").alias("bit")).groupBy("slot").agg(F.bit_or("bit").alias("bits")).toArrow()
    out = np.zeros(words, np.int64)
    out[bits["slot"].to_numpy()] = bits["bits"].to_numpy()
    return out.view(np.uint64)


def _verified(pairs: DataFrame) -> DataFrame:
    """Pairs of contexts ``l`` and ``r`` that agree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = 2 * OVERLAP + SPAN
        for batch in sliced(batches, 4096):
            left, right = (np.asarray(batch.column(i).flatten()).reshape(-1, width) for i in (4, 5))
            same = np.cumsum(np.concatenate([np.zeros((len(left), 1), np.int64), left == right], axis=1), axis=1)
            best = (same[:, OVERLAP:] - same[:, :-OVERLAP]).max(axis=1, initial=0)
            full = np.asarray(batch.column(1))
            good = best >= np.ceil(SIMILARITY * full)
            made = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), batch.column(3), pa.array(best, pa.int64())], names=["key", "size", "train", "test", "n_same"])
            yield made.filter(pa.array(good))

    return pairs.select("key", "size", "train", "test", "l", "r").mapInArrow(run, "key long, size long, train long, test long, n_same long")


def overlaps(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """One row per contaminated document and item: ``doc_id, item_id, n_same, n_compared, n_hits``.

    ``n_same`` of ``n_compared`` aligned tokens agree in the best stretch; ``n_hits`` counts seeds.
    """
    test = written(_seeded(columns(benchmark, id=item_col, text=item_text_col), -1, None, None).where(F.col("size") >= min(least_tokens, OVERLAP)), "test-seeds")
    counted = {r["size"]: r["n"] for r in test.groupBy("size").agg(F.count("*").alias("n")).collect()}  # OVERLAP rows at most
    train = columns(docs, id=id_col, text=text_col).where("id is not null")
    hits = written(_seeded(train, 0, sorted(counted), _bitmap(test, sum(counted.values()))).withColumnRenamed("id", "doc_id"), "hits")
    one = lambda df, name, text: df.groupBy("key", "size", F.col("print").alias(name)).agg(F.any_value("context").alias(text))
    agreed = written(_verified(one(hits, "train", "l").join(one(test, "test", "r"), ["key", "size"])), "agreed")
    placed = hits.select("doc_id", "key", "size", F.col("print").alias("train")).join(agreed, ["key", "size", "train"])
    items = test.select(F.col("id").alias("item_id"), "key", "size", F.col("print").alias("test"))
    found = placed.groupBy("doc_id", "key", "size", "test").agg(F.max("n_same").alias("n_same"), F.count("*").alias("n")).join(items, ["key", "size", "test"])
    best = F.max(F.struct("n_same", F.col("size").alias("n_compared")))
    return found.groupBy("doc_id", "item_id").agg(best.alias("b"), F.sum("n").alias("n_hits")).select("doc_id", "item_id", "b.n_same", "b.n_compared", "n_hits")


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_tokens: int = LEAST_TOKENS) -> DataFrame:
    """``docs`` without the contaminated ones; every other row and column stays as it is.
    Rows are judged by id and text, so a clean row stays whatever else has its id."""
    key = row_key(id_col, text_col)
    bad = overlaps(docs.select(key.alias("key"), F.col(f"`{text_col}`").alias("text")), benchmark, "key", least_tokens=least_tokens).select(F.col("doc_id").alias("key")).distinct()
    return without(docs, written(bad, "contaminated"), key)
