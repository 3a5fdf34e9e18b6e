"""Hard negatives and near-duplicate vectors against brute force."""

import math
from collections import defaultdict

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skyfix.llm import hard_negatives, near_vectors
from skyfix.llm import queries as llm
from skyfix.llm.vectors import matrix

SF = "/root/testdata/sf0.01"
SCHEMA = T.StructType().add("vec_id", "long").add("embedding", T.ArrayType(T.FloatType())).add("label", "integer")


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op13_near_vectors"])
def test_queries_agree_with_sql(spark, name):
    duck = duckdb.connect()
    duck.execute(f"create view embeddings as from '{SF}/embeddings.parquet'")
    want = duck.execute(llm.SQL[name]).df()
    got = llm.QUERIES[name](spark, SF).toPandas()[list(want.columns)]
    assert sorted(got.itertuples(index=False, name=None)) == sorted(want.itertuples(index=False, name=None))


def sound(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def product(a, b):
    return sum(x * y for x, y in zip(a, b))


def hard(rows, every=5, positives=5, negatives=3):
    """Every anchor (once) with its rows, by the contract."""
    rows = [(i, lab, tuple(math.floor(256 * float(x)) for x in v)) for i, v, lab in rows if i is not None and lab is not None and sound(v)]
    out = []
    for i, lab, v in set(r for r in rows if r[0] % every == 0):
        scored = sorted((-product(v, w), j, other) for j, other, w in rows if j != i)
        for s, j, _ in [r for r in scored if r[2] == lab][:positives]:
            fit = [r for r in scored if r[2] != lab and 50 * -s <= 100 * -r[0] <= 95 * -s][:negatives]
            out += [(i, j, k, r[1], -s, -r[0]) for k, r in enumerate(fit, 1)]
    return sorted(out)


def odd_vectors(seed=3, n=400):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(12, 9))
    rows = [(k, (base[k % 12] * rng.choice([1, 3]) + rng.normal(size=9) * rng.choice([0.02, 0.3])).astype(np.float32).tolist(), int(k % 12 % 3)) for k in range(n)]
    rows += [(n, None, 1), (n + 5, [0.0] * 9, 1), (n + 10, [1.0, None], 1), (n + 15, [float("nan")] * 9, 0), (n + 20, [float("inf")] + [1.0] * 8, 0), (n + 25, [2.0, 1.0], 2), (n + 30, [], 2)]
    rows += [(None, rows[0][1], 0), (n + 35, rows[1][1], None), rows[5], rows[5], rows[10], (rows[10][0], rows[20][1], 2), (-5, rows[3][1], 0)]
    rows += [(n + 40 + k, rows[7][1], rows[7][2]) for k in range(30)]
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).selectExpr("vec_id", "embedding as `a.b`", "label", "1 as id", "2 as vec", "3 as slot")


@pytest.mark.parametrize("chunk,cells", [(2048, 1 << 21), (16, 900)])
def test_hard_negatives_of_odd_rows(spark, monkeypatch, chunk, cells):
    """Small chunks and groups make thresholds and merges work."""
    monkeypatch.setattr(hard_negatives, "CHUNK", chunk)
    monkeypatch.setattr(hard_negatives, "ANCHORS", chunk)
    monkeypatch.setattr(hard_negatives, "GROUP_CELLS", cells)
    rows = odd_vectors()
    got = hard_negatives.mined(hard_negatives.prepared(frame(spark, rows), 256, vector_col="a.b"), F.col("id") % 5 == 0)
    assert sorted(map(tuple, got.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect())) == hard(rows)


def test_large_components_stay_exact(spark):
    """Products beyond 2**53 need integers; beyond 2**63 they saturate."""
    rows = [(k, [float(2**20 + k % 7), float(3 * k), -1.0], k % 2) for k in range(20)]
    assert sorted(map(tuple, mine(spark, rows))) == hard(rows)
    huge = mine(spark, [(k, [1e30, float(k)], k % 2) for k in range(20)], band=(50, 100))
    assert huge and all(r.positive_score == r.negative_score == 2**63 - 1 for r in huge)


def mine(spark, rows, **options):
    found = hard_negatives.mined(hard_negatives.prepared(frame(spark, rows), 256, vector_col="a.b"), F.col("id") % 5 == 0, **options)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()


def linked(rows, least=0.93):
    """Links and components by brute force; equal rows are apart by their place."""
    width = max(len(v or []) for _, v, _ in rows)
    unit = {}
    for k, (i, v, lab) in enumerate(rows):
        if i is not None and lab is not None and sound(v) and any(v):
            w = np.zeros(width)
            w[: len(v)] = v
            unit[k] = (lab, w / np.linalg.norm(w))
    home, links = {k: k for k in range(len(rows))}, defaultdict(set)

    def find(k):
        while home[k] != k:
            k = home[k]
        return k

    for a in unit:
        for b in unit:
            if a < b and unit[a][0] == unit[b][0] and unit[a][1] @ unit[b][1] >= least:
                links[a].add(b), links[b].add(a)
                home[find(a)] = find(b)
    least_id = defaultdict(list)
    for k, row in enumerate(rows):
        least_id[find(k)].append(row[0])
    out = []
    for k, (i, _, _) in enumerate(rows):
        component = min(x for x in least_id[find(k)]) if i is not None else None
        out.append((-(10**9) if i is None else i, len(links[k]), -(10**9) if component is None else component, component == i))
    return sorted(out)


@pytest.mark.parametrize("block,per_list", [(2048, 1000), (16, 60)])
def test_near_vectors_of_odd_rows(spark, monkeypatch, block, per_list):
    """Small lists and blocks make rows of one group meet over borders and blocks."""
    monkeypatch.setattr(near_vectors, "BLOCK", block)
    monkeypatch.setattr(near_vectors, "ROWS_A_LIST", per_list)
    monkeypatch.setattr(near_vectors, "QUERIES", block)
    rows = odd_vectors()
    got = near_vectors.near_duplicates(frame(spark, rows), vector_col="a.b").collect()
    mine = sorted((-(10**9) if r.vec_id is None else r.vec_id, r.n_links, -(10**9) if r.component_id is None else r.component_id, r.kept) for r in got)
    want = linked(rows)
    found, there = sum(r[1] for r in mine), sum(r[1] for r in want)
    assert len(mine) == len(want) and found >= 0.99 * there and all(a[1] <= b[1] for a, b in zip(mine, want))
    if per_list == 1000:  # one list: every pair is compared
        assert mine == want


def test_recall_on_given_rows(spark, monkeypatch):
    """Forty lists over 2,000 rows: probes still find the planted pairs."""
    monkeypatch.setattr(near_vectors, "ROWS_A_LIST", 50)
    path = "/root/testdata/sf0.1"
    given = pq.read_table(f"{path}/embeddings.parquet")
    unit = near_vectors.scaled(matrix(given["embedding"].combine_chunks(), 64))
    label = np.asarray(given["label"])
    there = int(((unit @ unit.T >= 0.93) & (label[:, None] == label)).sum()) - len(label)
    found = llm.QUERIES["op13_near_vectors"](spark, path).agg(F.sum("n_links")).first()[0]
    assert 0.99 * there <= found <= there


def test_no_rows(spark):
    empty = frame(spark, [])
    assert near_vectors.near_duplicates(empty, vector_col="a.b").collect() == []
    assert hard_negatives.mined(hard_negatives.prepared(empty, vector_col="a.b"), F.col("id") % 5 == 0).collect() == []
