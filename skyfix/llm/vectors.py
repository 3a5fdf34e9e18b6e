"""Vector columns in Arrow batches: matrices, clustering, and streams of held and passing rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """Neither null nor with a null or non-finite component."""
    wrong = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.col(vector).isNotNull() & ~F.coalesce(wrong, F.lit(False))


def matrix(listed: pa.ListArray, width: int) -> np.ndarray:
    """Rows of ``listed`` as doubles; shorter ones end in zeros."""
    flat = np.asarray(listed.flatten(), np.float64)
    lengths = np.diff(np.asarray(listed.offsets, np.int64))
    if (lengths == width).all():
        return flat.reshape(len(listed), width)
    out = np.zeros((len(listed), width))
    rows = np.repeat(np.arange(len(lengths)), lengths)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = flat
    return out


def sampled(df: DataFrame, rows: int, most: int, vector: str, *keys: str) -> pa.Table:
    """About ``most`` of ``rows`` vectors, drawn by a hash of ``keys``; never many more."""
    share = min(1.0, most / max(rows, 1))
    drawn = df.where(F.pmod(F.xxhash64(F.lit("sample"), *keys), F.lit(1 << 30)) < int(share * (1 << 30)) + 1)
    return drawn.select(vector).limit(2 * most).toArrow()


def clustered(points: np.ndarray, k: int, rounds: int = 8) -> np.ndarray:
    """``k`` centres of ``points`` at most (Lloyd's rounds from evenly drawn starts)."""
    centres = points[np.linspace(0, len(points) - 1, min(k, len(points))).astype(int)].copy()
    for _ in range(rounds):
        home = nearest(points, centres)
        count = np.bincount(home, minlength=len(centres))
        total = np.zeros_like(centres)
        np.add.at(total, home, points)
        centres[count > 0] = total[count > 0] / count[count > 0, None]
    return centres


def nearest(points: np.ndarray, centres: np.ndarray) -> np.ndarray:
    half = 0.5 * (centres * centres).sum(axis=1)
    return np.concatenate([(part @ centres.T - half).argmax(axis=1) for part in np.array_split(points, max(1, len(points) * len(centres) // (1 << 22)))])


def held_streams(batches: Iterator[pa.RecordBatch], keys: int, serve: Callable[[pa.RecordBatch, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """Feed ``serve`` with each group of rows sorted by their first ``keys`` columns and by a
    column ``kind``: the group's rows of kind 0 in one batch, the rest as a stream of batches.

    ``serve`` must take its stream to the end.
    """
    runs = _runs(batches, keys)
    ahead = next(runs, None)
    while ahead is not None:
        key, held = ahead[0], []
        while ahead is not None and ahead[0] == key and ahead[1] == 0:
            held.append(ahead[2])
            ahead = next(runs, None)

        def rest() -> Iterator[pa.RecordBatch]:
            nonlocal ahead
            while ahead is not None and ahead[0] == key:
                yield ahead[2]
                ahead = next(runs, None)

        passing = rest()
        if held:
            yield from serve(pa.Table.from_batches(held).combine_chunks().to_batches()[0], passing)
        for _ in passing:  # nothing is held for them
            pass


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[tuple, int, pa.RecordBatch]]:
    for batch in batches:
        if not batch.num_rows:
            continue
        parts = [np.asarray(batch.column(k)) for k in range(keys)] + [np.asarray(batch.column("kind"))]
        turn = np.flatnonzero(np.any([p[1:] != p[:-1] for p in parts], axis=0)) + 1
        for a, b in zip([0, *turn.tolist()], [*turn.tolist(), batch.num_rows]):
            yield tuple(int(p[a]) for p in parts[:-1]), int(parts[-1][a]), batch.slice(a, b - a)
