"""Near-duplicate vectors under one label, found by product quantisation.

Vectors, scaled to length one, get the nearest of up to ``LISTS`` coarse centres; a list is a
centre and a label. Its rows are stored there once, cut into blocks of about ``BLOCK`` rows,
with residual codes: the residual to the centre in parts of ``PART`` components, each replaced by
the nearest of ``WORDS`` code words. Centres and code words are fitted on at most
``SAMPLE_CELLS`` vector components. Every row is also a query to the further lists whose border is
within ``margin`` of it, and to the other blocks of its own list. A query's table of squared
distances to all code words gives its distance to every decoded row; a row's own decoding error,
kept with its code, makes that a lower bound of the true distance. Pairs within reach of it are
held against the exact cosine, so codes lose no pair and add none.

A pair is missed only if neither row probes the other's list, so if it crosses a border more than
``margin`` from both. The margin is 1.25 times the share of the largest linked distance that falls
along any one axis on average; a crossing then takes 2.5 times that share. The tests hold recall
against brute force.

Equal vectors are one class from the start, counted before any row meets another. A block hands on
counts of links and, for connection, one edge a row to the least row of its group inside the block,
and for a query one edge to each such group; never all pairs. Components come from ``components``.

Defined results: rows whose id, label or vector is null, zero vectors, and those with a null or
non-finite component link with nothing and are their own component; shorter vectors end in zeros;
repeated rows are copies and link; rows that share an id but not a vector keep their own counts;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from math import ceil, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components
from .membership import bitmap, marked, packed
from .shared import columns, written
from .vectors import clustered, held_streams, matrix, nearest, sampled, usable

LEAST_COSINE = 0.93
ROWS_A_LIST, LISTS = 1000, 4096
BLOCK = 2048
PART, WORDS = 8, 64
SAMPLE_CELLS = 1 << 20
QUERIES = 256
NODE = "struct<id:bigint,a:bigint,b:bigint>"


def scaled(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one (dividing first by the greatest size, so that squares stay finite)."""
    vectors = vectors / np.maximum(np.abs(vectors).max(axis=1, initial=0), np.finfo(np.float64).tiny)[:, None]
    return vectors / np.sqrt((vectors * vectors).sum(axis=1))[:, None]


@dataclass(frozen=True)
class Index:
    """Coarse centres, code words by part of the residual, and how far to look."""

    width: int
    centres: np.ndarray
    words: list[np.ndarray]
    reach: float
    margin: float

    @staticmethod
    def fitted(sample: np.ndarray, rows: int, least: float) -> Index:
        width = sample.shape[1]
        unit = scaled(sample[(sample != 0).any(axis=1)])
        if not len(unit):
            unit = np.eye(1, width)
        centres = clustered(unit, max(1, min(LISTS, rows // ROWS_A_LIST, len(unit) // 4)))
        rest = unit - centres[nearest(unit, centres)]
        words = [clustered(rest[:, a : a + PART], WORDS) for a in range(0, width, PART)]
        reach = sqrt(max(0.0, 2 - 2 * least))
        return Index(width, centres, words, reach, 1.25 * reach / sqrt(width))

    def probes(self, unit: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """The own list of each row, and all lists whose border is near enough, the own one among them."""
        squares = 1 + (self.centres**2).sum(axis=1) - 2 * unit @ self.centres.T
        home = squares.argmin(axis=1)
        apart = np.sqrt(np.maximum(((self.centres[:, None, :] - self.centres[np.unique(home)]) ** 2).sum(axis=2), 1e-30)) if len(self.centres) < 256 else None
        if apart is None:
            c, own = self.centres, self.centres[home]
            between = np.sqrt(np.maximum((c * c).sum(axis=1) + (own * own).sum(axis=1)[:, None] - 2 * own @ c.T, 1e-30))
        else:
            between = apart[:, np.searchsorted(np.unique(home), home)].T
        near = (squares - squares[np.arange(len(unit)), home][:, None]) <= 2 * self.margin * between
        near[np.arange(len(unit)), home] = True
        return home, [np.flatnonzero(row) for row in near]

    def codes(self, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Residual codes by part, and the length of what decoding gets wrong."""
        code = np.stack([nearest(rest[:, k * PART : (k + 1) * PART], w) for k, w in enumerate(self.words)], axis=1)
        decoded = np.concatenate([w[code[:, k]] for k, w in enumerate(self.words)], axis=1)
        return code, np.sqrt(((rest - decoded) ** 2).sum(axis=1))

    def distances(self, rest: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Of each query's residual to each decoded row, by table lookups."""
        total = np.zeros((len(rest), len(code)))
        for k, w in enumerate(self.words):
            part = rest[:, k * PART : (k + 1) * PART]
            table = (part**2).sum(axis=1)[:, None] + (w**2).sum(axis=1) - 2 * part @ w.T
            total += table[:, code[:, k]]
        return np.sqrt(np.maximum(total, 0))


class Block:
    """Stored rows of one list with their codes."""

    def __init__(self, index: Index, list_: int, unit: np.ndarray, least: float) -> None:
        self.index, self.centre, self.unit, self.least = index, index.centres[list_], unit, least
        self.code, self.error = index.codes(unit - self.centre)

    def linked(self, queries: np.ndarray) -> np.ndarray:
        """Queries against stored rows: whether their exact cosine is large enough."""
        near = self.index.distances(queries - self.centre, self.code) - self.error <= self.index.reach + 1e-6
        i, j = np.nonzero(near)
        out = np.zeros(near.shape, bool)
        if len(i) * 8 > near.size:
            return (queries @ self.unit.T >= self.least) & near
        out[i, j] = np.einsum("ij,ij->i", queries[i], self.unit[j]) >= self.least
        return out


def grouped(links: np.ndarray) -> np.ndarray:
    """The first row of each row's component in a symmetric matrix of links."""
    first = np.full(len(links), -1)
    for start in range(len(links)):
        if first[start] < 0:
            edge = np.array([start])
            while len(edge):
                first[edge] = start
                edge = np.flatnonzero(links[edge].any(axis=0) & (first < 0))
    return first


def _classes(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A row for each different vector (``id, a, b, label, vec, copies``), and the counts of those
    that occur more than once (``a, b, copies, least``)."""
    repeated = rows.groupBy("a", "b").agg(F.count("*").alias("copies"), F.min("id").alias("least")).where("copies > 1")
    repeated = written(repeated, "repeated")
    split = marked(packed(rows, F.struct("a", "b")), ["key"], bitmap(repeated.select(F.struct("a", "b").alias("key")), ["key"]))
    alone = split.where("not _maybe").select("row.*", F.lit(1).cast("long").alias("copies"))
    together = split.where("_maybe").groupBy("key").agg(F.min("row").alias("row"), F.count("*").alias("copies"))
    return alone.unionByName(together.select("row.*", "copies")), repeated


def _dealt(classes: DataFrame, index: Index) -> DataFrame:
    """``list, kind, label, id, a, b, copies, vec, home, probes``: a row (kind 0) in its own list,
    and a query (kind 1) in each further one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, QUERIES):
                some = batch.slice(at, QUERIES)
                home, probes = index.probes(scaled(matrix(some.column("vec"), index.width)))
                owner = np.repeat(np.arange(len(probes)), [len(p) for p in probes])
                lists = np.concatenate(probes)
                taken = some.take(pa.array(owner))
                kind = (lists != home[owner]).astype(np.int32)
                listed = pa.array([probes[k] if own else [] for k, own in zip(owner, kind == 0)], pa.list_(pa.int32()))
                made = [pa.array(lists.astype(np.int32)), pa.array(kind), *[taken.column(c) for c in ("label", "id", "a", "b", "copies", "vec")], pa.array(home[owner].astype(np.int32)), listed]
                yield pa.RecordBatch.from_arrays(made, names=["list", "kind", "label", "id", "a", "b", "copies", "vec", "home", "probes"])

    vec = classes.schema["vec"].dataType.simpleString()
    fields = f"list int, kind int, label long, id long, a long, b long, copies long, vec {vec}, home int, probes array<int>"
    return classes.select("id", "a", "b", "label", "vec", "copies").mapInArrow(run, fields)


def _blocks(dealt: DataFrame) -> DataFrame:
    """``dealt`` with its block; rows of lists with several blocks also query the other ones."""
    sizes = dealt.where("kind = 0").groupBy("label", "list").agg(F.count("*").alias("n")).where(F.col("n") > BLOCK)
    large = written(sizes.select("label", "list", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks")), "lists")
    if large.isEmpty():
        return dealt.withColumn("block", F.lit(0))
    met = dealt.join(large, ["label", "list"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    every = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    met = met.withColumn("own", F.pmod(F.xxhash64("id", "a", "b"), F.col("blocks")).cast("int")).withColumn("block", every)
    return met.withColumn("kind", F.when((F.col("kind") == 0) & (F.col("block") == F.col("own")), 0).otherwise(1)).drop("own", "blocks")


def _compared(blocks: DataFrame, index: Index, least: float) -> DataFrame:
    """``id, a, b, links`` and ``to_id, to_a, to_b``: counts of links, and edges that connect what
    is linked (either may be null)."""
    names = ["id", "a", "b"]
    fields = [*names, "links", "to_id", "to_a", "to_b"]

    def counts(rows: pa.RecordBatch, links: np.ndarray) -> pa.RecordBatch:
        some = pa.array(np.flatnonzero(links))
        none = pa.nulls(len(some), pa.int64())
        return pa.RecordBatch.from_arrays([*[rows.column(n).take(some) for n in names], pa.array(links[links != 0].astype(np.int64)), none, none, none], names=fields)

    def edges(rows: pa.RecordBatch, i: np.ndarray, others: pa.RecordBatch, j: np.ndarray) -> pa.RecordBatch:
        ends = [*[rows.column(n).take(pa.array(i)) for n in names], pa.nulls(len(i), pa.int64()), *[others.column(n).take(pa.array(j)) for n in names]]
        return pa.RecordBatch.from_arrays(ends, names=fields)

    def serve(held: pa.RecordBatch, passing: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = Block(index, held.column("list")[0].as_py(), scaled(matrix(held.column("vec"), index.width)), least)
        weight, n = np.asarray(held.column("copies")), held.num_rows
        inside = np.concatenate([block.linked(block.unit[k : k + QUERIES]) for k in range(0, n, QUERIES)])
        inside |= inside.T
        np.fill_diagonal(inside, False)
        first = grouped(inside)
        own = inside @ weight
        i = np.flatnonzero(first != np.arange(n))
        yield edges(held, i, held, first[i])
        probes = held.column("probes")
        longest = np.diff(np.asarray(probes.offsets)).max()
        asked = matrix(probes, longest + 1).astype(np.int64)
        asked[np.arange(longest + 1) >= np.diff(np.asarray(probes.offsets))[:, None]] = -1
        for batch in passing:
            for k in range(0, batch.num_rows, QUERIES):
                some = batch.slice(k, QUERIES)
                hits = block.linked(scaled(matrix(some.column("vec"), index.width)))
                i, j = np.nonzero(hits)
                if not len(i):
                    continue
                yield counts(some, hits @ weight)
                pairs = np.unique(i * n + first[j])
                yield edges(some, pairs // n, held, pairs % n)
                # The stored row counts the link itself where it asks the query's own list.
                unasked = (asked[j] != np.asarray(some.column("home"))[i, None]).all(axis=1)
                own = own + np.bincount(j[unasked], np.asarray(some.column("copies"))[i[unasked]], n).astype(np.int64)
        yield counts(held, own)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return held_streams(batches, 3, serve)

    keys = ["label", "list", "block"]
    sorted_ = blocks.select(*keys, "kind", "id", "a", "b", "copies", "vec", "home", "probes").repartition(*keys).sortWithinPartitions(*keys, "kind")
    return sorted_.mapInArrow(run, ", ".join(f"{f} long" for f in fields))


def near_duplicates(df: DataFrame, least: float = LEAST_COSINE, id_col: str = "vec_id", label_col: str = "label", vector_col: str = "embedding") -> DataFrame:
    """``vec_id, n_links, component_id, kept`` of every row of ``df``."""
    rows = columns(df, id=id_col, label=label_col, vec=vector_col)
    able = usable("vec") & F.exists("vec", lambda x: x != 0) & F.col("id").isNotNull() & F.col("label").isNotNull()
    able = F.coalesce(able, F.lit(False))
    keys = [F.when(able, F.xxhash64(F.lit(k), "label", "vec")).alias(name) for k, name in ((1, "a"), (2, "b"))]
    keyed = rows.select(F.col("id").cast("long").alias("id"), *keys, F.col("label").cast("long").alias("label"), "vec")
    linkable = keyed.where("a is not null")
    n, width = linkable.agg(F.count("*"), F.max(F.size("vec"))).first()
    if not n:
        return keyed.select(F.col("id").alias("vec_id"), F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"), F.lit(True).alias("kept"))

    classes, repeated = _classes(linkable)
    sample = sampled(linkable, n, SAMPLE_CELLS // width, "vec", "id", "a")["vec"].combine_chunks()
    index = Index.fitted(matrix(sample, width), n, least)
    compared = written(_compared(_blocks(_dealt(classes, index)), index, least), "compared")

    node, other = F.struct("id", "a", "b").cast(NODE).alias("node"), F.struct(F.col("to_id").alias("id"), F.col("to_a").alias("a"), F.col("to_b").alias("b")).cast(NODE)
    degrees = written(compared.where("links is not null").groupBy("id", "a", "b").agg(F.sum("links").alias("links")), "degrees")
    labels = degrees.select(node, node.alias("label"))
    found = components(compared.where("links is null").select(node.alias("a"), other.alias("b")), labels)
    homes = found.select("node.*", F.col("label.id").alias("component_id"))
    linked = degrees.join(homes, ["id", "a", "b"]).select("a", "b", "links", "component_id")
    known = repeated.join(linked, ["a", "b"], "full").select(
        "a", "b", (F.coalesce("links", F.lit(0)) + F.coalesce("copies", F.lit(1)) - 1).alias("n_links"), F.coalesce("component_id", "least").alias("component_id"),
    )
    out = keyed.select("id", "a", "b").join(written(known, "known"), ["a", "b"], "left")
    component = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), component.eqNullSafe(F.col("id")).alias("kept"))
