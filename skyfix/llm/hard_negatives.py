"""Hard-negative mining: near rows of other labels whose score lies in a band below a positive's.

Scores are inner products of integer vectors. Both passes, over positives and over negatives,
send every anchor to every group of rows. A group holds at most about ``GROUP_CELLS`` vector
components; the anchors stream past it. An orthogonal rotation onto principal axes (fitted on a
sample of ``SAMPLE_CELLS`` components; it changes the speed only) puts most of a vector's length
first. For a pair the product of the leading components is known up to the product of the two
residual norms and a slack for rounding. Pairs that can't come among the best so far, or into the
band, are dropped there; the others add further components, and those that are left are scored
exactly with integers.

Per anchor and group at most the wanted number of rows leaves a task; a window merges them.

Defined results: rows whose id, label or vector is null, or with a null or non-finite component,
take no part; shorter vectors end in zeros; rows with the anchor's id are not its partners;
repeated rows count as rows, but a repeated anchor counts once; components and scores
saturate at the bounds of a long and are exact in between; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import columns, fan_out, written
from .vectors import held_streams, matrix, sampled, usable

GROUP_CELLS = 1 << 21
SAMPLE_CELLS = 1 << 20
#: Rows and anchors that are multiplied at a time.
CHUNK, ANCHORS = 2048, 128
#: Scores saturate here, so that they can change their sign.
MOST = np.iinfo(np.int64).max


def whole(vector: str, scale: int) -> Column:
    """Components times ``scale``, rounded down to integers."""
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("long"))


def prepared(df: DataFrame, scale: int = 256, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """``id, label, vec``: the rows that take part, with integer components."""
    rows = columns(df, id=id_col, label=label_col, vec=vector_col).where(usable("vec") & F.col("id").isNotNull() & F.col("label").isNotNull())
    return rows.select(F.col("id").cast("long").alias("id"), F.col("label").cast("long").alias("label"), whole("vec", scale).alias("vec"))


def rotation(sample: np.ndarray, width: int) -> np.ndarray:
    """Orthogonal columns, by falling share of the sample's squared length."""
    if not len(sample):
        return np.eye(width)
    return np.linalg.eigh(sample.T @ sample)[1][:, ::-1].copy()


class Turned:
    """Integer vectors, their rotation and the norms of what follows each cut."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, axes: np.ndarray, cuts: list[int]) -> None:
        self.ids, self.labels, self.vectors, self.cuts = ids, labels, vectors, cuts
        self.turned = vectors @ axes
        self.tails = [np.sqrt((self.turned[:, k:] ** 2).sum(axis=1)) for k in cuts]
        self.norms = np.sqrt((vectors * vectors).sum(axis=1))

    def part(self, a: int, b: int) -> Turned:
        out = object.__new__(Turned)
        out.ids, out.labels, out.vectors, out.turned, out.norms = (x[a:b] for x in (self.ids, self.labels, self.vectors, self.turned, self.norms))
        out.tails, out.cuts = [t[a:b] for t in self.tails], self.cuts
        return out


def exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Integer products of rows; doubles hold them while the sums of sizes stay below 2**53."""
    if not len(a) or np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * a.shape[1] < 2.0**53:
        return np.einsum("ij,ij->i", a, b).astype(np.int64)
    sums = [sum(int(x) * int(y) for x, y in zip(u, v)) for u, v in zip(a, b)]
    return np.array([min(max(s, -MOST), MOST) for s in sums], np.int64)


def near(anchors: Turned, rows: Turned, same: bool, low: np.ndarray, high: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (anchor, row) and their exact scores: all with ``low <= score <= high`` and, by
    ``same``, equal or different labels; some others may come along."""
    width = anchors.turned.shape[1]
    slack = 8 * width**1.5 * 2.0**-53

    def fits(product: np.ndarray, rest: np.ndarray, low: np.ndarray, high: np.ndarray | None) -> np.ndarray:
        return (product + rest >= low) if high is None else (product + rest >= low) & (product - rest <= high)

    k = anchors.cuts[0]
    leading = anchors.turned[:, :k] @ rows.turned[:, :k].T
    rest = np.outer(anchors.tails[0], rows.tails[0]) + slack * np.outer(anchors.norms, rows.norms)
    held = fits(leading, rest, low[:, None], None if high is None else high[:, None])
    held &= (anchors.labels[:, None] == rows.labels) == same
    held &= anchors.ids[:, None] != rows.ids
    i, j = np.nonzero(held)
    if len(i) * 8 > held.size and np.abs(anchors.vectors).max() * np.abs(rows.vectors).max() * width < 2.0**53:
        return i, j, (anchors.vectors @ rows.vectors.T)[i, j].astype(np.int64)
    product = leading[i, j]
    for n, k in enumerate(anchors.cuts[1:], 1):
        before = anchors.cuts[n - 1]
        product = product + np.einsum("ij,ij->i", anchors.turned[i, before:k], rows.turned[j, before:k])
        rest = anchors.tails[n][i] * rows.tails[n][j] + slack * anchors.norms[i] * rows.norms[j]
        left = fits(product, rest, low[i], None if high is None else high[i])
        i, j, product = i[left], j[left], product[left]
    return i, j, exact(anchors.vectors[i], rows.vectors[j])


class Best:
    """The ``size`` best ``(score, id)`` of each key, higher scores and then smaller ids first."""

    def __init__(self, keys: int, size: int) -> None:
        self.size, self.keys = size, keys
        self.key, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        key, score, ids = np.concatenate([self.key, key]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, key))
        key, score, ids = key[order], score[order], ids[order]
        first = np.searchsorted(key, key)
        kept = np.arange(len(key)) - first < self.size
        self.key, self.score, self.id = key[kept], score[kept], ids[kept]

    def least(self, other: np.ndarray) -> np.ndarray:
        """What a key's new score must reach: its last one's if it is full, else ``other``."""
        out = other.copy()
        full = np.flatnonzero(np.bincount(self.key, minlength=self.keys) == self.size)
        out[full] = self.score[np.searchsorted(self.key, full, side="right") - 1]
        return out


def _meeting(rows: DataFrame, anchors: DataFrame, groups: int) -> DataFrame:
    """Rows dealt over the groups at random, and every anchor in each: ``group, kind, label, ...``."""
    dealt = rows.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)).cast("int"))
    dealt = dealt.select("group", F.lit(0).alias("kind"), "label", "id", F.lit(0).cast("long").alias("mark"), "vec", F.lit(None).cast("array<long>").alias("scores"))
    sent = anchors.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    both = dealt.unionByName(sent.select("group", F.lit(1).alias("kind"), "label", "id", "mark", "vec", "scores"))
    return both.repartition("group").sortWithinPartitions("group", "kind", "label")


def _searched(meeting: DataFrame, axes: np.ndarray, positives: int, negatives: int, band: tuple[int, int] | None) -> DataFrame:
    """``anchor_id, mark, slot, id, score``: a group's best rows for each anchor, or for each of an
    anchor's positives (``slot``) those in the band below it."""
    width = len(axes)
    cuts = sorted({ceil(width / 4), ceil(width / 2), width})

    def turned(batch: pa.RecordBatch) -> Turned:
        return Turned(np.asarray(batch.column("id")), np.asarray(batch.column("label")), matrix(batch.column("vec"), width), axes, cuts)

    def answers(anchors: Turned, bands: tuple[np.ndarray, np.ndarray] | None, rows: Turned) -> Best:
        n = len(anchors.ids)
        if bands is None:
            best, slots = Best(n, positives), 1
            floor, high = np.full(n, -np.inf), None
            a, b = np.searchsorted(rows.labels, anchors.labels.min()), np.searchsorted(rows.labels, anchors.labels.max(), side="right")
        else:
            lows, highs = bands
            best, slots = Best(lows.size, negatives), positives
            floor, high = np.where(lows <= highs, lows, np.inf).ravel(), np.where(highs == MOST, np.inf, highs).max(axis=1)
            a, b = 0, len(rows.ids)
        starts = [a, *range(min(a + CHUNK // 8, b), b, CHUNK)]
        for start, end in zip(starts, [*starts[1:], b]):
            chunk = rows.part(start, end)
            low = best.least(floor).reshape(n, slots).min(axis=1)
            i, j, score = near(anchors, chunk, bands is None, low, high)
            if bands is None:
                best.add(i, score, chunk.ids[j])
                continue
            pair, slot = np.nonzero((score[:, None] >= lows[i]) & (score[:, None] <= highs[i]))
            best.add(i[pair] * slots + slot, score[pair], chunk.ids[j[pair]])
        return best

    def serve(held: pa.RecordBatch, passing: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = turned(held)
        for batch in passing:
            for at in range(0, batch.num_rows, ANCHORS):
                some = batch.slice(at, ANCHORS)
                slots, bands = 1, None
                if band is not None:
                    slots, listed = positives, [s + [None] * (positives - len(s)) for s in some.column("scores").to_pylist()]
                    lows = [[MOST if s is None else -(-band[0] * s // 100) for s in some_] for some_ in listed]
                    highs = [[-MOST if s is None else band[1] * s // 100 for s in some_] for some_ in listed]
                    bands = np.array(lows, np.int64), np.array(highs, np.int64)
                best = answers(turned(some), bands, rows)
                owner = best.key // slots
                made = [some.column("id").take(pa.array(owner)), some.column("mark").take(pa.array(owner)), *(pa.array(x) for x in (best.key % slots + 1, best.id, best.score))]
                yield pa.RecordBatch.from_arrays(made, names=["anchor_id", "mark", "slot", "id", "score"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return held_streams(batches, 1, serve)

    return meeting.mapInArrow(run, "anchor_id long, mark long, slot long, id long, score long")


def mined(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, band: tuple[int, int] = (50, 95)) -> DataFrame:
    """For each anchor of ``rows`` (as ``prepared`` gives them) and each of its best rows of the same
    label the best rows of other labels with ``band`` per cent of the positive's score."""
    marked = rows.withColumn("mark", F.xxhash64("label", "vec"))
    anchors = marked.where(is_anchor).dropDuplicates(["id", "label", "mark"])
    n, width, wanted = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0)), F.count(F.when(is_anchor, 1))).first()
    width = max(width, 1)
    sample = sampled(rows, n, SAMPLE_CELLS // width, "vec", "id")["vec"].combine_chunks()
    axes = rotation(matrix(sample, width), width)
    # Memory bounds a group from above; below that there are as many as tasks, while the copies
    # of the anchors stay fewer than the rows.
    groups = max(1, ceil(n * width / GROUP_CELLS), min(fan_out(rows.sparkSession), n // max(wanted, 1)))

    first = _searched(_meeting(rows, anchors.withColumn("scores", F.lit(None).cast("array<long>")), groups), axes, positives, negatives, None)
    order = Window.partitionBy("anchor_id", "mark").orderBy(F.desc("score"), "id")
    best = first.withColumn("slot", F.row_number().over(order)).where(F.col("slot") <= positives)
    best = written(best.select("anchor_id", "mark", F.col("slot").cast("long").alias("slot"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score")), "positives")

    scores = best.groupBy("anchor_id", "mark").agg(F.transform(F.sort_array(F.collect_list(F.struct("slot", "positive_score"))), lambda s: s["positive_score"]).alias("scores"))
    scored = anchors.join(scores.withColumnRenamed("anchor_id", "id"), ["id", "mark"])
    found = _searched(_meeting(rows, scored, groups), axes, positives, negatives, band)
    order = Window.partitionBy("anchor_id", "mark", "slot").orderBy(F.desc("score"), "id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    out = found.join(best, ["anchor_id", "mark", "slot"])
    return out.select("anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
