"""Substring dedup by prefix-partitioned suffix trees.

A window is ``WINDOW`` (50) consecutive words of one document. A word goes when a window
over it also starts in a document with a smaller id. Windows are judged on the input.

1. Every suffix has a prefix of variable length that names its group. The prefix ends with
   the suffix's anchor: of the groups of 8 words in its first 50, the one with the least hash.
   Equal windows have equal anchors at equal places, and about 22 neighbouring suffixes share
   one, so these travel as one row: a context, the words they cover. Anchors of one document
   only have no partner and end here. Equal contexts are merged map-side into one with its
   smallest document, so thousands of copies are one row in what follows.
2. Groups whose words outgrow ``GROUP_BYTES`` get longer prefixes: their suffixes are split by
   where the anchor lies in them, and each part is keyed by all the words that its suffixes
   share (8, then about 40, then all 50), until groups fit or the prefix is the whole suffix,
   that is, one deep node.
3. Inside a group the suffixes are sorted and their longest common prefixes taken, which is
   their suffix tree: the leaves below an internal node of depth 50 are a run of neighbours
   with 50 or more words in common. The node's smallest document counts for all its leaves.
4. Nodes' smallest documents are joined back to occurrences, and to documents. A bitmap of
   bounded size keeps the texts of documents without any repeat out of the shuffles. Neighbouring
   repeated windows of a document make up its maximal repeats (``passages``).

Defined results: ids are integers; null or blank text has no words; texts of fewer than 50
words lose nothing; equal ids are not smaller than each other; rows with a null id neither
lose words nor make others lose any; repeated rows stay and are searched once; other columns
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .membership import bitmap, marked
from .rolling import ByteHash, sliding_min, spans
from .shared import columns, fan_out, sliced, written

WINDOW = 50
#: Words in an anchor.
GRAM = 8
#: Bytes of words up to which a group's tree is built in one go.
GROUP_BYTES = 1 << 20
#: In how many parts the places of the anchor are cut first; the next step takes each alone.
PARTS = 4
#: Bits for a position in the keys whose least is sought.
POSITION = np.uint64((1 << 28) - 1)


def runs_of(text: bytes, hasher: ByteHash, window: int = WINDOW) -> tuple[np.ndarray, ...]:
    """Anchor hash, first suffix, number of suffixes and the anchor's place in the first suffix,
    of each run of a text."""
    words = text.split()
    if len(words) < window:
        return (np.zeros(0, np.int64), *(np.zeros(0, np.int32) for _ in range(3)))
    gram = min(GRAM, window)
    flat, first, end = spans(words)
    grams = hasher.ranges(flat, first[: len(words) - gram + 1], end[gram - 1 :])
    keys = (grams & ~POSITION) | np.arange(len(grams), dtype=np.uint64)
    at = (sliding_min(keys, window - gram + 1) & POSITION).astype(np.int64)
    begin = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    return grams[at[begin]].view(np.int64), begin.astype(np.int32), np.diff(np.append(begin, len(at))).astype(np.int32), (at[begin] - begin).astype(np.int32)


def _anchors(rows: DataFrame, window: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = ByteHash()
        for batch in sliced(batches):
            found = [runs_of(t or b"", hasher, window) for t in batch.column(2).to_pylist()]
            owner = np.repeat(np.arange(len(found)), [len(x[0]) for x in found])
            parts = [np.concatenate([x[j] for x in found]) for j in range(4)]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(owner)), batch.column(1).take(pa.array(owner)), *map(pa.array, parts)], names=["doc_id", "copy", "anchor", "start", "n", "place"])

    return rows.where("doc_id is not null").mapInArrow(run, "doc_id long, copy long, anchor long, start int, n int, place int")


def _mapped(rows: DataFrame, made: Callable[[tuple], Iterator[tuple]], names: list[str], kinds: list[str]) -> DataFrame:
    """``made`` of every row, a few thousand rows at a time."""
    arrow = [{"long": pa.int64(), "int": pa.int32(), "binary": pa.binary()}[k] for k in kinds]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            columns = [pa.array([r[j] for r in out], t) for j, t in enumerate(arrow)]
            out.clear()
            return pa.RecordBatch.from_arrays(columns, names=names)

        for batch in sliced(batches):
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                out.extend(made(row))
                if len(out) > 5_000:
                    yield batch_of()
            yield batch_of()

    return rows.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds)))


def _contexts(rows: DataFrame, window: int) -> DataFrame:
    """Of documents with their repeated runs: the words that each run's suffixes cover, and a
    digest of them and of the anchor's place."""

    def made(row: tuple) -> Iterator[tuple]:
        doc, copy, text, runs = row
        flat, first, end = spans(text.split())
        for r in runs:
            a, n, place = r["start"], r["n"], r["place"]
            words = flat[first[a] : end[a + n + window - 2]]
            yield doc, copy, a, r["anchor"], place, hashlib.blake2b(words, digest_size=16, salt=place.to_bytes(4, "little")).digest(), words

    return _mapped(rows, made, ["doc_id", "copy", "start", "anchor", "place", "context", "words"], ["long", "long", "int", "long", "int", "binary", "binary"])


def _lengthened(rows: DataFrame, parts: int, window: int) -> DataFrame:
    """Rows ``key, context, i, place, least, words``, whose suffixes from the ``i``-th on of a
    context have the anchor at ``place`` and before, cut by the anchor's place into ``parts``;
    the key of each is all that its suffixes share."""
    places = window - min(GRAM, window) + 1
    of = [j * parts // places for j in range(places)]
    low, high = {p: of.index(p) for p in of}, {p: j for j, p in enumerate(of)}

    def made(row: tuple) -> Iterator[tuple]:
        _, context, i, place, least, words = row
        flat, first, end = spans(words.split())
        n = len(first) - window + 1
        k = 0
        while k < n:
            j = place - k
            part = of[j]
            stop = min(n, k + j - low[part] + 1)  # the next suffix lies in another part
            shared = flat[first[place - low[part]] : end[place + window - high[part] - 1]] if low[part] <= place else b""
            key = hashlib.blake2b(shared, digest_size=16, salt=part.to_bytes(4, "little")).digest()
            yield key, context, i + k, j, least, flat[first[k] : end[stop + window - 2]]
            k = stop

    return _mapped(rows.select("key", "context", "i", "place", "least", "words"), made, ["key", "context", "i", "place", "least", "words"], ["binary", "binary", "int", "int", "long", "binary"])


def deep_nodes(groups: list[int], contexts: list[bytes], least: list[int], window: int = WINDOW) -> list[np.ndarray]:
    """For each suffix of each context: the smallest document below the node of its group's
    suffix tree at which the window ends."""
    number: dict[bytes, int] = {}
    ids = [np.fromiter((number.setdefault(w, len(number)) for w in c.split()), np.uint32) for c in contexts]
    many = np.array([len(x) - window + 1 for x in ids])
    leaves = np.concatenate([np.lib.stride_tricks.sliding_window_view(x, window) for x in ids])
    owner = np.repeat(np.arange(len(ids)), many)
    named = np.column_stack([np.array(groups, np.uint32)[owner], leaves]).astype(">u4")
    order = np.argsort(named.view(f"V{4 * (window + 1)}")[:, 0], kind="stable")
    in_order = named[order]
    apart = in_order[1:] != in_order[:-1]
    # Words in common with the leaf before, the group's number counted as the first.
    common = np.where(apart.any(axis=1), apart.argmax(axis=1), window + 1)
    begin = np.flatnonzero(np.concatenate([[True], common <= window]))
    node = np.minimum.reduceat(np.array(least, np.int64)[owner][order], begin)
    low = np.empty(len(order), np.int64)
    low[order] = np.repeat(node, np.diff(np.append(begin, len(order))))
    return np.split(low, np.cumsum(many)[:-1])


def _subtrees(grouped: DataFrame, window: int) -> DataFrame:
    """Rows come sorted by key, each key's rows in one partition; small groups are sorted
    together, each its own tree."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def trees() -> pa.RecordBatch:
            number: dict[bytes, int] = {}
            groups = [number.setdefault(r[0], len(number)) for r in held]
            lows = deep_nodes(groups, [r[4] for r in held], [r[3] for r in held], window) if held else []
            ends = np.cumsum([0, *map(len, lows)])
            flat = pa.array(np.concatenate([np.zeros(0, np.int64), *lows]), pa.int64())
            made = [pa.array([r[1] for r in held], pa.binary()), pa.array([r[2] for r in held], pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)]
            held.clear()
            return pa.RecordBatch.from_arrays(made, names=["context", "i", "lows"])

        for batch in sliced(batches, 2048):
            for row in zip(*(batch.column(c).to_pylist() for c in ("key", "context", "i", "least", "words"))):
                if size >= GROUP_BYTES // 2 and row[0] != held[-1][0]:
                    yield trees()
                    size = 0
                held.append(row)
                size += len(row[4])
        yield trees()

    return grouped.mapInArrow(run, "context binary, i int, lows array<long>")


def _nodes(merged: DataFrame, window: int) -> list[DataFrame]:
    """``context, i, lows`` of every suffix of the merged contexts, a table per prefix length."""
    rows, found = merged, []
    every = window - min(GRAM, window) + 1
    for parts in (min(PARTS, every), every):
        large = written(rows.groupBy("key").agg(F.sum(F.octet_length("words")).alias("size")).where(F.col("size") > GROUP_BYTES).select("key"), "large")
        small = rows.join(large, "key", "left_anti").repartition(fan_out(rows.sparkSession), "key").sortWithinPartitions("key")
        found.append(_subtrees(small, window))
        if large.isEmpty():
            return found
        rows = written(_lengthened(rows.join(large, "key", "left_semi"), parts, window), "lengthened")
    # The prefix is the whole suffix now, so all rows of a key are leaves of one node.
    nodes = written(rows.groupBy("key").agg(F.min("least").alias("low")), "nodes")
    found.append(rows.select("key", "context", "i").join(nodes, "key").select("context", "i", F.array("low").alias("lows")))
    return found


def _kept(rows: DataFrame, window: int, kind: str) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            n_words, n_removed, kept = [], [], []
            for text, starts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                words = (text or b"").split()
                gone = 0
                if starts:
                    edge = np.zeros(len(words) + 1, np.int64)
                    at = np.unique(np.array(starts))
                    edge[at] += 1
                    edge[at + window] -= 1
                    covered = np.cumsum(edge[:-1]) > 0
                    gone = int(covered.sum())
                    kept.append(b" ".join([w for w, c in zip(words, covered.tolist()) if not c]))
                else:
                    kept.append(b" ".join(words))
                n_words.append(len(words))
                n_removed.append(gone)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_words long, n_removed long, kept string")


def once(rows: DataFrame) -> DataFrame:
    """``rows`` with one of those that share ``doc_id`` and ``copy``."""
    twice = written(rows.groupBy("doc_id", "copy").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "copy"), "twice")
    split = marked(rows, ["doc_id", "copy"], bitmap(twice, ["doc_id", "copy"]))
    maybe = split.where("_maybe").drop("_maybe")
    return split.where("not _maybe").drop("_maybe").unionByName(maybe.groupBy("doc_id", "copy").agg(F.first("text").alias("text")))


def repeated_starts(rows: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, copy, starts``: where windows start that a smaller document has too."""
    rows = once(rows)
    anchors = written(_anchors(rows, window), "anchors")
    shared = written(anchors.groupBy("anchor").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi")).where("lo < hi").select("anchor"), "shared")
    runs = anchors.join(shared, "anchor").groupBy("doc_id", "copy").agg(F.collect_list(F.struct("start", "n", "anchor", "place")).alias("runs"))
    runs = written(runs, "runs")
    texts = marked(rows, ["doc_id", "copy"], bitmap(runs, ["doc_id", "copy"])).where("_maybe").drop("_maybe")
    found = written(_contexts(texts.join(runs, ["doc_id", "copy"]).select("doc_id", "copy", "text", "runs"), window), "contexts")
    merged = found.groupBy("anchor", "context").agg(F.min("doc_id").alias("least"), F.min("words").alias("words"), F.min("place").alias("place"))
    merged = written(merged.select(F.col("anchor").cast("string").cast("binary").alias("key"), "context", F.lit(0).alias("i"), "place", "least", "words"), "merged")
    placed = []
    for lows in _nodes(merged, window):
        starts = F.expr("filter(transform(lows, (low, k) -> if(low < doc_id, start + i + k, -1)), s -> s >= 0)")
        placed.append(found.select("doc_id", "copy", "start", "context").join(written(lows, "lows"), "context").select("doc_id", "copy", starts.alias("starts")).where(F.size("starts") > 0))
    return reduce(DataFrame.union, placed).groupBy("doc_id", "copy").agg(F.flatten(F.collect_list("starts")).alias("starts"))


def passages(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``doc_id, start, n_words``: the maximal runs of words that ``remove_repeats`` takes out."""
    rows = columns(df, doc_id=id_col, text=text_col)
    rows = rows.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("copy"), F.col("text").cast("binary").alias("text"))
    starts = F.explode(F.array_distinct("starts")).alias("s")
    by = Window.partitionBy("doc_id", "copy").orderBy("s")
    placed = repeated_starts(rows, window).select("doc_id", "copy", starts).withColumn("new", F.coalesce(F.col("s") > F.lag("s").over(by) + window, F.lit(True)).cast("int"))
    placed = placed.withColumn("run", F.sum("new").over(by)).groupBy("doc_id", "copy", "run").agg(F.min("s").alias("start"), F.max("s").alias("last"))
    return placed.select("doc_id", "start", (F.col("last") - F.col("start") + window).cast("long").alias("n_words"))


def remove_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept``: what is left of every text, words joined by spaces."""
    rows = columns(df, doc_id=id_col, text=text_col)
    kind = rows.schema["doc_id"].dataType.simpleString()
    rows = rows.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("copy"), F.col("text").cast("binary").alias("text"))
    starts = written(repeated_starts(rows, window), "starts")
    split = marked(rows, ["doc_id", "copy"], bitmap(starts, ["doc_id", "copy"]))
    whole = split.where("not _maybe").select("doc_id", "text", F.lit(None).cast("array<int>").alias("starts"))
    cut = split.where("_maybe").join(starts, ["doc_id", "copy"], "left").select("doc_id", "text", "starts")
    return _kept(whole.unionByName(cut), window, "long").withColumn("doc_id", F.col("doc_id").cast(kind))
