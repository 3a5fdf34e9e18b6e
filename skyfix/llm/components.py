"""Connected components of a graph of distinct nodes, as DataFrame rounds.

Each round every node takes the smallest root among its neighbours' and its own, then
edges move to those roots and edges inside one root go (hook and shortcut). The edge table
shrinks by a constant factor a round or more; the driver sees one count a round. Rounds
are written to the shared folder, so lineage stays short and lost executors cost little. So
are the aggregates of each join: both of its sides are then read anew, and a hub's rows, of
which there may be many, can be split over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .membership import one_of_each, row_key, without
from .shared import drop_written, merged, written


def roots(edges: DataFrame) -> tuple[DataFrame | None, int]:
    """Table of ``node, root`` for every node that has an edge (None without edges).

    Alternates two star steps on edges ``(u, v)`` with ``u > v`` until every node points
    at the least node of its component. Large star: each node links its larger neighbours
    to its least neighbour. Small star: each node links its smaller neighbours to the least.
    """
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    if now.isEmpty():
        return None, 0
    rounds, before = 0, None
    while True:
        both = now.select("u", "v").union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), "least")
        large = written(merged(both.where("v > u"), least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = written(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        moved = merged(large, low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(low.select("u", F.col("m").alias("v")).union(moved).where("u <> v").distinct(), "edges")
        state = after.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        for used in (now, least, large, low):
            drop_written(used)
        now, rounds = after, rounds + 1
        if state == before:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")), rounds
        before = state


def components(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """``node, label`` for every row of ``labels``: the least label of the node's component."""
    found, _ = roots(edges)
    if found is None:
        return labels
    home = written(merged(labels, found, "node", "left").select("node", "label", F.coalesce("root", "node").alias("root")), "home")
    least = written(home.groupBy("root").agg(F.min("label").alias("least")), "least")
    return merged(home, least, "root").select("node", F.col("least").alias("label"))


def identified(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, text``: rows told apart by id and text, in the order of their ids, null last."""
    none, key = F.col(f"`{id_col}`").isNull(), row_key(id_col, text_col)
    return df.select(F.struct(none.alias("none"), F.col(f"`{id_col}`").alias("id"), key.alias("key")).alias("doc_id"), F.col(f"`{text_col}`").alias("text"))


def first_of_each(df: DataFrame, found: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``df`` with the first row of each component of ``found`` (``doc_id`` as ``identified``
    gives it, ``component_id``); of repeated rows one stays."""
    found, key = written(found, "groups"), row_key(id_col, text_col)
    gone = written(found.where("doc_id <> component_id").select("doc_id.key").distinct(), "duplicates")
    twice = written(found.where("doc_id = component_id").groupBy("doc_id.key").agg(F.count("*").alias("n")).where("n > 1").select("key"), "repeated")
    return one_of_each(without(df, gone, key), twice, key)
