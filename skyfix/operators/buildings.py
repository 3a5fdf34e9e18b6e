"""Solid boxes in a picture: convex hulls of projected corners, and what they leave visible of lines.

Hulls are an aggregate: every batch keeps, of each group's points, only those on their hull, so what
is shuffled does not grow with the points inside; the hull of the hulls is the group's. Lines are cut
by plain joins and windows: a line inside a convex hull is one interval, found as the greatest entry
and the least exit over the hull's edges; the visible rest is the complement of the intervals' union,
a running maximum of their ends.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import spread

#: Fixed value: shorter visible parts, as a share of the line, are left out.
SLIVER = 1e-3
#: Passes over all groups of a batch; groups that need more are finished one by one.
ROUNDS = 64


def hull(points: np.ndarray) -> np.ndarray:
    """Corners of the convex hull, counter-clockwise from the leftmost (lowest of these) point."""
    p = np.unique(points, axis=0)
    if len(p) < 3:
        return p
    chains = []
    for order in (p, p[::-1]):
        chain: list[np.ndarray] = []
        for c in order:
            while len(chain) > 1:
                a, b = chain[-2:]
                if (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0]) > 0:
                    break
                chain.pop()
            chain.append(c)
        chains.append(chain[:-1])
    return np.array(chains[0] + chains[1])


def _chain(group: np.ndarray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Of points in order of group and place, those on the lower chain of their group's hull. A point
    on or over the line between its neighbours goes, all at once, until none does or the rounds end."""
    at = np.arange(len(group))
    for _ in range(ROUNDS):
        a, b, c = at[:-2], at[1:-1], at[2:]
        cross = (x[b] - x[a]) * (y[c] - y[a]) - (y[b] - y[a]) * (x[c] - x[a])
        stays = np.ones(len(at), bool)
        stays[1:-1] = (group[a] != group[c]) | (cross > 0)
        if stays.all():
            break
        at = at[stays]
    return at


def _chains(group: np.ndarray, x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``_chain`` of each group from left to right, and of the way back, without repeated points."""
    order = np.lexsort((y, x, group))
    g, u, v = group[order], x[order], y[order]
    order = order[np.concatenate([[True], (g[1:] != g[:-1]) | (u[1:] != u[:-1]) | (v[1:] != v[:-1])])[: len(order)]]
    back = order[::-1]
    return tuple(o[_chain(group[o], x[o], y[o])] for o in (order, back))


def _hulls(group: np.ndarray, x: np.ndarray, y: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Corners (row, 2) of the hulls of groups 0 to n - 1, one after another, and where each ends."""
    low, back = _chains(group, x, y)
    left = _chain(group[low], x[low], y[low]), _chain(group[back], x[back], y[back])
    if any(len(l) != len(c) for l, c in zip(left, (low, back))):  # the rounds did not do: what is left, group by group
        rest = np.unique(np.concatenate([low, back]))
        found = [hull(np.column_stack([x[rest], y[rest]])[group[rest] == k]) for k in range(n)]
        return np.concatenate(found), np.cumsum([len(f) for f in found])
    # Each chain's last point is the other's first; a single point is its group's only one.
    last = lambda c: np.concatenate([group[c][1:] != group[c][:-1], [True]])
    alone = np.bincount(group[low], minlength=n)[group[low]] == 1
    at = np.concatenate([low[~last(low) | alone], back[~last(back)]])
    at = at[np.argsort(group[at], kind="stable")]
    return np.column_stack([x[at], y[at]]), np.cumsum(np.bincount(group[at], minlength=n))


def _on_hulls(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of each batch the points that may be on the hull of their group's points in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            group = np.zeros(batch.num_rows, np.int64)
            for k in keys:
                coded = batch.column(k).dictionary_encode(null_encoding="encode")
                group = np.unique(group * len(coded.dictionary) + coded.indices.to_numpy(), return_inverse=True)[1]
            at = np.unique(np.concatenate(_chains(group, *(np.asarray(batch.column(c), np.float64) for c in ("x", "y")))))
            yield batch.take(pa.array(at))

    return rows.mapInArrow(run, rows.schema)


def hulls(points: DataFrame, *keys: str) -> DataFrame:
    """``keys, corners``: the hull of each group's points ``x, y``, an array of ``x, y`` from the
    leftmost one on, counter-clockwise. Points with a null or NaN are left out."""
    rows = points.select(*keys, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).dropna(subset=["x", "y"])
    left = _on_hulls(rows, list(keys)).groupBy(*keys).agg(F.collect_list(F.struct("x", "y")).alias("points"))
    left = left.select(*keys, F.col("points.x").alias("x"), F.col("points.y").alias("y"))
    kinds = ", ".join(f"{k} {points.schema[k].dataType.simpleString()}" for k in keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = [("x", pa.float64()), ("y", pa.float64())]
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                group = np.repeat(np.arange(batch.num_rows), batch.column("x").value_lengths().to_numpy())
                xy, ends = _hulls(group, *(batch.column(c).flatten().to_numpy() for c in ("x", "y")), batch.num_rows)
                corners = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.StructArray.from_arrays([pa.array(xy[:, 0]), pa.array(xy[:, 1])], fields=[pa.field(*f) for f in kind]))
                yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keys], corners], names=[*keys, "corners"])

    return left.mapInArrow(run, f"{kinds}, corners array<struct<x:double,y:double>>")


def edges(hulled: DataFrame, *keys: str) -> DataFrame:
    """``keys, ax, ay, bx, by_``: a hull's edges, the inside on their left; none of fewer than three corners."""
    at = hulled.where(F.size("corners") >= 3).select(*keys, "corners", F.posexplode("corners").alias("i", "a"))
    b = F.col("corners")[F.pmod(F.col("i") + 1, F.size("corners"))]
    return at.select(*keys, F.col("a.x").alias("ax"), F.col("a.y").alias("ay"), b["x"].alias("bx"), b["y"].alias("by_"))


def area(corners: Column) -> Column:
    """Of a polygon, by the sum of its edges' cross products."""
    n = F.size(corners)
    after = F.transform(corners, lambda c, i: F.struct(c["x"].alias("x"), c["y"].alias("y"), corners[F.pmod(i + 1, n)]["x"].alias("u"), corners[F.pmod(i + 1, n)]["y"].alias("v")))
    return F.when(n >= 3, F.abs(F.aggregate(after, F.lit(0.0), lambda s, c: s + c["x"] * c["v"] - c["u"] * c["y"])) / 2).otherwise(0.0)


def hidden_spans(lines: DataFrame, boxes: DataFrame, view: str = "view", line: str = "line", box: str = "box") -> DataFrame:
    """``view, line, lo, hi``: the part of each line (``x1, y1, x2, y2, depth``) inside the hull of
    each nearer box (``corners, depth``) of its view, as shares of the line."""
    # Dealt by view, so that a task holds the pairs of few views, and groups them where they are made.
    e = edges(spread(boxes, view), view, box, "depth").withColumnRenamed("depth", "_d")
    met = spread(lines.select(view, line, "x1", "y1", "x2", "y2", "depth"), view).join(e, view).where(F.col("_d") < F.col("depth"))
    nx, ny = F.col("ay") - F.col("by_"), F.col("bx") - F.col("ax")
    slope = (F.col("x2") - F.col("x1")) * nx + (F.col("y2") - F.col("y1")) * ny
    height = (F.col("x1") - F.col("ax")) * nx + (F.col("y1") - F.col("ay")) * ny
    met = met.select(view, line, box, slope.alias("a"), height.alias("b")).withColumn("t", -F.col("b") / F.when(F.abs(F.col("a")) >= 1e-9, F.col("a")))
    outside = F.max((F.abs(F.col("a")) < 1e-9) & (F.col("b") < 0))
    spans = met.groupBy(view, line, box).agg(F.max(F.when(F.col("a") > 0, F.col("t"))).alias("enter"), F.min(F.when(F.col("a") < 0, F.col("t"))).alias("leave"), outside.alias("outside"))
    lo, hi = F.greatest(F.lit(0.0), F.coalesce("enter", F.lit(0.0))), F.least(F.lit(1.0), F.coalesce("leave", F.lit(1.0)))
    return spans.where("not outside").select(view, line, lo.alias("lo"), hi.alias("hi")).where("lo < hi")


def visible_parts(lines: DataFrame, boxes: DataFrame, view: str = "view", line: str = "line", box: str = "box") -> DataFrame:
    """``view, line, lo, hi``: what nearer boxes leave visible of every line, in order."""
    spans = hidden_spans(lines, boxes, view, line, box)
    ends = lines.select(view, line, F.lit(1.0).alias("lo"), F.lit(2.0).alias("hi"))  # closes each line
    w = Window.partitionBy(view, line).orderBy("lo", "hi").rowsBetween(Window.unboundedPreceding, -1)
    swept = spans.unionByName(ends).withColumn("from_", F.coalesce(F.max("hi").over(w), F.lit(0.0)))
    return swept.where(F.col("lo") > F.col("from_") + SLIVER).select(view, line, F.col("from_").alias("lo"), F.col("lo").alias("hi"))
