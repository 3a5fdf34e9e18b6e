"""Conversation repair against an exhaustive search of all edit scripts by cost, then audit."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pyarrow.parquet as pq
import pytest
from pyspark.sql import types as T

from skyfix.llm import conversations
from skyfix.llm import queries as llm

SF = "/root/testdata/sf0.001"
SHA = hashlib.sha256
SCHEMA = T.StructType().add("conv_id", "long").add("turn", "long").add("role", "string").add("text", "string")


def damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        group = out[conv]
        if kind == 0:
            continue
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        group += [(turn, "user" if kind == 4 else role, text)] * (2 if kind == 3 else 1)
    return out


def expected(group):
    """Dijkstra over (turns read, roles so far as a state), ordered by cost and audit."""
    group = sorted(group, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
    turns, seen, wrong = [(r, t) for _, r, t in group], set(), []
    for turn in turns:
        body = re.sub(r"[\x20\x09-\x0D]", "", turn[1])
        wrong.append("blank" if not body else "duplicate" if turn in seen else "truncated" if body[-1] not in ".!?" else "")
        seen.add(turn)
    # States: e empty, s system read, u, a; by the initial that comes next.
    go = {("e", "s"): "s", ("e", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    heap, done = [(0, "", 0, "e", ())], set()
    while heap:
        cost, audit, i, state, made = heapq.heappop(heap)
        if i == len(turns) and state in "ea":
            break
        if (i, state) in done:
            continue
        done.add((i, state))
        add = [("I", 5, i, x, (name, "")) for x, name in (("u", "user"), ("a", "assistant"))]
        if i < len(turns):
            role, text = turns[i]
            heapq.heappush(heap, (cost + 2, audit + "D", i + 1, state, made))
            if wrong[i] in ("", "truncated"):
                more = 5 * (wrong[i] == "truncated")
                add += [("K", more, i + 1, role[:1], (role, text))]
                add += [("R", more + 1, i + 1, x, (name, text)) for x, name in (("u", "user"), ("a", "assistant"))]
        for letter, price, to, x, turn in add:
            if (state, x) in go:
                heapq.heappush(heap, (cost + price, audit + letter, to, go[state, x], (*made, turn)))
    numbers = {n for n, _, _ in group if n is not None}
    gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
    text = "\n".join(f"{r}:{t}" for r, t in made)
    return (gaps, wrong.count("blank"), wrong.count("duplicate"), wrong.count("truncated"), illegal, cost, audit, SHA(text.encode()).hexdigest())


def got(rows):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in rows}


def odd_rows():
    rng = random.Random(5)
    roles, texts = ["user", "assistant", "system", "ua", "", None, "Tool"], ["Yes.", "No!", "Well", "", " \t", None, "Long. " * 3000, "é?", "Yes. \n"]
    rows = [(c if c else None, rng.choice([None, *range(9)]), rng.choice(roles), rng.choice(texts)) for c in range(150) for _ in range(rng.randrange(1, 9))]
    return rows + rows[:40] + [(-5, -(2**40), "user", "Hi."), (-5, 2**40, "assistant", "Ho.")]


def test_query(spark):
    rows = [tuple(r.values()) for r in pq.read_table(f"{SF}/conversations.parquet").to_pylist()]
    groups = damage(rows)
    assert got(llm.QUERIES["op12_conversation_repair"](spark, SF).collect()) == {c: expected(groups[c]) for c in {r[0] for r in rows}}


@pytest.mark.parametrize("limit", [512, 3])
def test_odd_rows_whole_and_in_segments(spark, monkeypatch, limit):
    """With segments of three rows nearly every conversation takes the long way."""
    monkeypatch.setattr(conversations, "LONG_ROWS", limit)
    rows = odd_rows()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as turns", "'x' as `a.b`")
    groups = damage(rows)
    found = got(conversations.repair(conversations.damaged(df.select("conv_id", "turn", "role", "text"))).collect())
    want = {c: expected(groups[c]) for c in {r[0] for r in rows}}
    wrong = {c: (found.get(c), want[c]) for c in want if found.get(c) != want[c]}
    assert not wrong and len(found) == len(want)


def test_repaired_turns_follow_the_grammar(spark, monkeypatch):
    monkeypatch.setattr(conversations, "LONG_ROWS", 4)
    rows = [(c, k, "user", f"Say {k}.") for c in range(3) for k in range(3 * c)]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("text", "a.b")
    turns = conversations.repaired_turns(df, text_col="a.b").collect()
    for c in range(3):
        mine = [r for r in sorted(turns, key=lambda r: (r.part, r.piece, r.place)) if r.conv_id == c]
        assert re.fullmatch("(s?(ua)+)?", "".join(r.role[0] for r in mine))


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversations.repair(conversations.damaged(empty)).collect() == []
