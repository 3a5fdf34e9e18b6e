"""Conversation structure repair: the cheapest edits that make roles follow a grammar.

A conversation's roles must read ``(s?(ua)+)?`` by their initials. Edits: keep a turn (free),
give it the role user or assistant (1), delete it (2; blank and repeated turns must go), insert
an empty user or assistant turn (5); a truncated turn that stays adds 5.

Costs are searched in layers, as Wu and Manber search text with errors: layer ``c`` holds, for
every turn, the bitset of grammar states from which the rest can be repaired for exactly ``c``.
It follows from layers ``c`` (keep), ``c-1`` (new role), ``c-2`` (delete), ``c-5`` and ``c-6``.
The first layer that holds the start state at turn 0 gives the cost; a walk through the bits,
always by the least letter that still reaches the end, gives the ASCII-least audit.

A conversation is one group while it is no longer than ``LONG_ROWS`` and ``LONG_BYTES``. A longer
one is sorted over all tasks and cut into segments. A segment's costs between states are a 4 x 4
matrix (shortest sums); the matrices' chain gives the cost to go at each cut, from which every
segment finds its layers and its part of the audit by itself. Only matrices and states, about a
row for ``LONG_ROWS`` turns, meet in one group; the digest, which is sequential by its nature,
streams the sorted texts through one task in bounded memory.

Defined results: a null role or text counts as one space; turns are taken by number, nulls first,
equal numbers by role and text; a null id is a conversation of its own; repeated rows are repeated
turns; ids without turns left have zeros and empty strings; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import columns, fan_out, written

LONG_ROWS = 512
LONG_BYTES = 16 << 20

WHITE = " \t\n\x0b\x0c\r"
FINE, TRUNCATED, DUPLICATE, BLANK = range(4)
START, SYSTEM, USER, ANSWER = 1, 2, 4, 8
STATES = (START, SYSTEM, USER, ANSWER)
STEPS = {("s", START): SYSTEM, ("u", START): USER, ("u", SYSTEM): USER, ("u", ANSWER): USER, ("a", USER): ANSWER}
ACCEPTED = START | ANSWER


def _before(initial: str) -> bytes:
    """For each set of states those from which ``initial`` leads into the set."""
    return bytes(sum(a for (x, a), b in STEPS.items() if x == initial and b & bits) for bits in range(16))


BEFORE = {x: _before(x) for x in "sua"}
NOWHERE = bytes(16)
#: The same for either of the two roles that an edit can give.
FILL = bytes(BEFORE["u"][bits] | BEFORE["a"][bits] for bits in range(16))
FILLED = {START: USER, SYSTEM: USER, USER: ANSWER, ANSWER: USER}
ROLE = {USER: "user", ANSWER: "assistant"}


def faults(turns: list[tuple[str, str]], repeated: list[bool] | None = None) -> list[int]:
    """The first fault of each ``(role, text)``; ``repeated`` where it is known beforehand."""
    seen, out = set(), []
    for k, turn in enumerate(turns):
        body = turn[1].rstrip(WHITE)
        again = repeated[k] if repeated else turn in seen
        out.append(BLANK if not body else DUPLICATE if again else FINE if body[-1] in ".!?" else TRUNCATED)
        seen.add(turn)
    return out


def cost_layers(turns: list[tuple[str, int]], ends: dict[int, int], last: bool, wanted: int) -> list[bytes | bytearray]:
    """Layers up to the first in which all ``wanted`` states have been met at turn 0.

    ``turns`` holds initials and faults, ``ends`` the states behind the last turn by their cost
    to go. Six empty layers come first. Insertions behind the last turn belong to the next
    segment, if there is one.
    """
    n = len(turns)
    found: list[bytes | bytearray] = [bytes(n + 1)] * 6
    met = 0
    while wanted & ~met:
        six, five, two, one = found[-6], found[-5], found[-2], found[-1]
        now = bytearray(n + 1)
        now[n] = ends.get(len(found) - 6, 0) | (FILL[five[n]] if last else 0)
        for i in range(n - 1, -1, -1):
            initial, fault = turns[i]
            bits = FILL[five[i]] | two[i + 1]
            if fault == FINE:
                bits |= BEFORE.get(initial, NOWHERE)[now[i + 1]] | FILL[one[i + 1]]
            elif fault == TRUNCATED:
                bits |= BEFORE.get(initial, NOWHERE)[five[i + 1]] | FILL[six[i + 1]]
            now[i] = bits
        found.append(now)
        met |= now[0]
    return found


def first_layer(found: list, state: int) -> int:
    return next(c for c, layer in enumerate(found[6:]) if layer[0] & state)


def least_audit(turns: list[tuple[str, int]], found: list, ends: dict[int, int], last: bool, state: int) -> tuple[str, int]:
    """The least letters along the bits from ``state``, and the state behind the last turn."""
    n, i, cost, out = len(turns), 0, first_layer(found, state), []

    def holds(price: int, at: int, to: int | None) -> bool:
        return to is not None and bool(found[cost - price + 6][at] & to) if cost - price >= 0 else False

    while not (i == n and ends.get(cost, 0) & state):
        initial, fault = turns[i] if i < n else ("", BLANK)
        more = 5 if fault == TRUNCATED else 0
        kept = STEPS.get((initial, state))
        if i < n and holds(2, i + 1, state):
            out.append("D")
            i, cost = i + 1, cost - 2
        elif (i < n or last) and holds(5, i, FILLED[state]):
            out.append("I")
            state, cost = FILLED[state], cost - 5
        elif fault <= TRUNCATED and holds(more, i + 1, kept):
            out.append("K")
            i, cost, state = i + 1, cost - more, kept
        else:
            out.append("R")
            i, cost, state = i + 1, cost - more - 1, FILLED[state]
    return "".join(out), state


def edited(turns: list[tuple[str, str]], audit: str, state: int) -> list[tuple[str, str]]:
    """The turns after the edits of ``audit``."""
    at, out = iter(turns), []
    for letter in audit:
        role, text = ("", "") if letter == "I" else next(at)
        if letter == "D":
            continue
        state = STEPS[role[:1], state] if letter == "K" else FILLED[state]
        out.append((role, text) if letter == "K" else (ROLE[state], text))
    return out


def illegal_pairs(initials: list[str]) -> int:
    return sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))


def repaired(turns: list[tuple[str, str]], found_faults: list[int]) -> tuple[int, str, list[tuple[str, str]]]:
    """Cost, audit and turns of one whole conversation."""
    marked = [(role[:1], fault) for (role, _), fault in zip(turns, found_faults)]
    ends = {0: ACCEPTED}
    found = cost_layers(marked, ends, True, START)
    audit, _ = least_audit(marked, found, ends, True, START)
    return first_layer(found, START), audit, edited(turns, audit, START)


DAMAGES = 20


def damaged(df: DataFrame) -> DataFrame:
    """The contract's damage by the CRC-32 of ``conv_id:turn``; a dropped row keeps its id only."""
    name = F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")])
    rows = df.withColumn("role", F.coalesce("role", F.lit(" "))).withColumn("text", F.coalesce("text", F.lit(" ")))
    rows = rows.withColumn("kind", F.crc32(name.cast("binary")) % DAMAGES)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 0, None).when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "kind")
    return rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "copy")


def turns_of(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """An operator's own columns of ``df``, nulls of role and text as one space."""
    rows = columns(df, conv_id=conv_col, turn=turn_col, role=role_col, text=text_col)
    return rows.withColumn("role", F.coalesce("role", F.lit(" "))).withColumn("text", F.coalesce("text", F.lit(" ")))


TURNS = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
COUNTS = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _short(rows: DataFrame) -> DataFrame:
    """One row per conversation of bounded size, with its repaired turns."""
    turn = F.when(F.col("role").isNotNull(), F.struct("turn", "role", "text"))
    grouped = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    kind, number = (rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for listed in batch.column(1).to_pylist():
                turns = [(t["role"], t["text"]) for t in listed]
                wrong = faults(turns)
                cost, audit, after = repaired(turns, wrong)
                numbers = {t["turn"] for t in listed} - {None}
                gaps = max(numbers) - min(numbers) + 1 - len(numbers) if numbers else 0
                out.append((gaps, wrong.count(BLANK), wrong.count(DUPLICATE), wrong.count(TRUNCATED), illegal_pairs([r[:1] for r, _ in turns]), cost, audit, [{"role": r, "text": t} for r, t in after]))
            kinds = [pa.int64()] * 6 + [pa.string(), TURNS]
            made = [pa.array(list(c), k) for c, k in zip(zip(*out), kinds)] if out else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "turns"])

    typed = grouped.select("conv_id", F.col("turns").cast(f"array<struct<turn:{number},role:string,text:string>>").alias("turns"))
    return typed.mapInArrow(run, f"conv_id {kind}, {COUNTS}, turns array<struct<role:string,text:string>>")


def _segments(rows: DataFrame) -> DataFrame:
    """Long conversations, sorted over all tasks and cut: ``conv_id, part, piece, turns``.

    Rows that agree in id, turn, role and the first 64 characters stay in one task; it streams them.
    """
    order = ["conv_id", "turn", "role"]
    dealt = rows.where("role is not null").withColumn("head", F.substring("text", 1, 64)).repartitionByRange(fan_out(rows.sparkSession), *order, "head")
    dealt = dealt.drop("head").sortWithinPartitions(*order, "text")
    kind, number = (rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, now, at = TaskContext.get().partitionId(), object(), 0
        for batch in batches:
            places = []
            for conv in batch.column(0).to_pylist():
                at = at + 1 if conv == now else 0
                now = conv
                places.append(at)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([part] * batch.num_rows, pa.int32()), pa.array(places, pa.int64())], names=[*batch.schema.names, "part", "at"])

    placed = written(dealt.mapInArrow(place, f"conv_id {kind}, turn {number}, role string, text string, part int, at long"), "turns")
    same = [F.col("conv_id"), F.col("role"), F.sha2("text", 256).alias("digest")]
    first = placed.groupBy(*same).agg(F.min(F.struct("part", "at")).alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = written(first, "repeated").alias("f")
    p = placed.withColumn("digest", F.sha2("text", 256)).alias("p")
    met = p.join(first, F.expr("p.conv_id <=> f.conv_id and p.role = f.role and p.digest = f.digest"), "left")
    again = F.coalesce(F.struct("p.part", "p.at") > F.col("f.first"), F.lit(False)).alias("again")
    piece = F.floor(F.col("at") / LONG_ROWS).cast("long").alias("piece")
    rows = met.select("p.conv_id", "part", piece, F.struct("at", "turn", F.col("p.role").alias("role"), "text", again).alias("row"))
    return written(rows.groupBy("conv_id", "part", "piece").agg(F.sort_array(F.collect_list("row")).alias("turns")), "segments")


NEVER = 1 << 60


def transfer(turns: list[tuple[str, int]]) -> list[int]:
    """The least costs of getting from each state before a segment to each behind it, by rows."""
    out = []
    for start in range(4):
        cost = [NEVER] * 4
        cost[start] = 0
        for initial, fault in turns:
            cost[2] = min(cost[2], cost[0] + 5, cost[1] + 5, cost[3] + 5)
            cost[3] = min(cost[3], cost[2] + 5)
            cost[2] = min(cost[2], cost[3] + 5)
            after = [c + 2 for c in cost]
            if fault <= TRUNCATED:
                more = 5 if fault == TRUNCATED else 0
                for k, state in enumerate(STATES):
                    kept = STEPS.get((initial, state))
                    for to, price in ((kept, more), (FILLED[state], more + 1)):
                        if to:
                            j = to.bit_length() - 1
                            after[j] = min(after[j], cost[k] + price)
            cost = [min(c, NEVER) for c in after]
        out += cost
    return out


#: Costs to go behind the last turn, by state: nothing, two insertions, one, nothing.
AT_END = [0, 10, 5, 0]


def _long(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row per long conversation, and its segments with their repaired turns; see the module's text."""
    import pandas as pd

    cut = _segments(rows)
    kind, number = (rows.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))

    def read(listed: list[dict]) -> tuple[list[tuple[str, str]], list[int], list[tuple[str, int]]]:
        turns = [(t["role"], t["text"]) for t in listed]
        wrong = faults(turns, [t["again"] for t in listed])
        return turns, wrong, [(role[:1], fault) for (role, _), fault in zip(turns, wrong)]

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                listed = batch.column(3)[k].as_py()
                turns, wrong, marked = read(listed)
                numbers = [t["turn"] for t in listed if t["turn"] is not None]
                low, high = (numbers[0], numbers[-1]) if numbers else (None, None)
                row = [transfer(marked), wrong.count(BLANK), wrong.count(DUPLICATE), wrong.count(TRUNCATED), illegal_pairs([r[:1] for r, _ in turns]), low, high, len(set(numbers)), turns[0][0][:1], turns[-1][0][:1]]
                kinds = [pa.list_(pa.int64()), *[pa.int64()] * 7, pa.string(), pa.string()]
                names = ["matrix", "blank", "duplicate", "truncated", "illegal", "low", "high", "numbers", "opens", "closes"]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(k, 1) for c in range(3)], *[pa.array([v], t) for v, t in zip(row, kinds)]], names=["conv_id", "part", "piece", *names])

    key = f"conv_id {kind}, part int, piece long"
    measured = written(cut.mapInArrow(measure, f"{key}, matrix array<long>, blank long, duplicate long, truncated long, illegal long, low long, high long, numbers long, opens string, closes string"), "measured")

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["part", "piece"], ignore_index=True)
        to_go, behind, ahead = AT_END, [], []
        for matrix in reversed(pdf["matrix"].tolist()):
            behind.append(to_go)
            to_go = [int(min(matrix[4 * s + t] + to_go[t] for t in range(4))) for s in range(4)]
            ahead.append(to_go)
        met = list(zip(pdf["closes"], pdf["opens"][1:]))
        known = pdf.dropna(subset=["low"])
        shared = sum(a == b for a, b in zip(known["high"], known["low"][1:]))
        gaps = int(known["high"].max() - known["low"].min() + 1 - known["numbers"].sum() + shared) if len(known) else 0
        out = pdf[["conv_id", "part", "piece"]].copy()
        out["behind"], out["last"] = behind[::-1], [k == len(pdf) - 1 for k in range(len(pdf))]
        for name in ("blank", "duplicate", "truncated"):
            out[name] = int(pdf[name].sum())
        out["gaps"], out["illegal"] = gaps, int(pdf["illegal"].sum()) + sum(a + b not in ("su", "ua", "au") for a, b in met)
        out["cost"] = ahead[-1][0]
        return out

    chained = written(measured.groupBy("conv_id").applyInPandas(chain, f"{key}, behind array<long>, last boolean, blank long, duplicate long, truncated long, gaps long, illegal long, cost long"), "chained")

    def with_costs(names: list[str], other: DataFrame) -> DataFrame:
        same = F.expr("s.conv_id <=> c.conv_id and s.part = c.part and s.piece = c.piece")
        return cut.alias("s").join(other.alias("c"), same).select("s.conv_id", "s.part", "s.piece", "s.turns", *[f"c.{n}" for n in names])

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                _, _, marked = read(batch.column(3)[k].as_py())
                behind, last = batch.column(4)[k].as_py(), batch.column(5)[k].as_py()
                ends = {0: ACCEPTED} if last else {}
                for state, cost in zip(STATES, [] if last else behind):
                    ends[cost - min(behind)] = ends.get(cost - min(behind), 0) | state
                found = cost_layers(marked, ends, last, 15)
                ways = [least_audit(marked, found, ends, last, s) for s in STATES]
                made = [pa.array([[w[0] for w in ways]], pa.list_(pa.string())), pa.array([[w[1] for w in ways]], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*[batch.column(c).slice(k, 1) for c in range(3)], *made], names=["conv_id", "part", "piece", "audits", "exits"])

    walked = written(with_costs(["behind", "last"], chained).mapInArrow(walk, f"{key}, audits array<string>, exits array<long>"), "walked")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, state, entered = pdf.sort_values(["part", "piece"], ignore_index=True), START, []
        for exits in pdf["exits"]:
            entered.append(state)
            state = int(exits[state.bit_length() - 1])
        return pdf[["conv_id", "part", "piece"]].assign(state=entered)

    same = F.expr("w.conv_id <=> e.conv_id and w.part = e.part and w.piece = e.piece")
    entered = walked.select("conv_id", "part", "piece", "exits").groupBy("conv_id").applyInPandas(choose, f"{key}, state long")
    audit = F.element_at("audits", (F.log2(F.col("state").cast("double")) + 1).cast("int"))
    chosen = written(walked.alias("w").join(entered.alias("e"), same).select("w.conv_id", "w.part", "w.piece", "state", audit.alias("audit")), "chosen")

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, begun = None, None, False

        def row() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([now], ids), pa.array([state.hexdigest()])], names=["conv_id", "repaired_sha256"])

        for batch in batches:
            ids = batch.column(0).type
            for k in range(batch.num_rows):
                conv = batch.column(0)[k].as_py()
                if state is None or conv != now:
                    if state is not None:
                        yield row()
                    now, state, begun = conv, hashlib.sha256(), False
                for t in batch.column(3)[k].as_py():
                    state.update((("\n" if begun else "") + f"{t['role']}:{t['text']}").encode())
                    begun = True
        if state is not None:
            yield row()

    def edit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            after = []
            for k in range(batch.num_rows):
                turns, _, _ = read(batch.column(3)[k].as_py())
                after.append([{"role": r, "text": t} for r, t in edited(turns, batch.column(5)[k].as_py(), batch.column(4)[k].as_py())])
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in range(3)], pa.array(after, TURNS)], names=["conv_id", "part", "piece", "turns"])

    pieces = with_costs(["state", "audit"], chosen).mapInArrow(edit, f"{key}, turns array<struct<role:string,text:string>>")
    texts = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "part", "piece")
    digests = texts.mapInArrow(digest, f"conv_id {kind}, repaired_sha256 string")
    parts = F.sort_array(F.collect_list(F.struct("part", "piece", "audit")))
    audits = chosen.groupBy("conv_id").agg(F.array_join(F.transform(parts, lambda p: p["audit"]), "").alias("audit"))
    counts = chained.where("last").select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost").alias("n")
    both = audits.alias("a").join(digests.alias("d"), F.expr("a.conv_id <=> d.conv_id"))
    return counts.join(both, F.expr("n.conv_id <=> a.conv_id")).select("n.*", "a.audit", "d.repaired_sha256"), pieces


def _split(rows: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """Rows of bounded conversations, and those of longer ones (None without any)."""
    size = F.octet_length("text") + F.octet_length("role")
    sizes = rows.groupBy("conv_id").agg(F.count("*").alias("n"), F.sum(size).alias("size"))
    large = written(sizes.where((F.col("n") > LONG_ROWS) | (F.col("size") > LONG_BYTES)).select(F.col("conv_id").alias("big"), F.lit(1).alias("large")), "long")
    if large.isEmpty():
        return rows, None
    met = rows.join(large, F.expr("conv_id <=> big"), "left")
    return met.where("large is null").select(rows.columns), met.where("large = 1").select(rows.columns)


def repair(rows: DataFrame) -> DataFrame:
    """``conv_id``, counts of faults, ``cost``, ``audit`` and ``repaired_sha256`` of every
    conversation of ``rows`` (as ``turns_of`` gives them; a row without role keeps its id only)."""
    short, long = _split(rows)
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit(":"), t["text"])), "\n")
    out = _short(short).withColumn("repaired_sha256", F.sha2(text, 256)).drop("turns")
    if long is None:
        return out
    whole, _ = _long(long.where("role is not null"))
    return out.unionByName(whole).unionByName(_emptied(long))


def _emptied(long: DataFrame) -> DataFrame:
    """Long conversations that lost all their turns."""
    left = long.groupBy("conv_id").agg(F.count("role").alias("n")).where("n = 0")
    zeros = [F.lit(0).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return left.select("conv_id", *zeros, F.lit("").alias("audit"), F.sha2(F.lit(""), 256).alias("repaired_sha256"))


def repaired_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The turns after the repair: ``conv_id``, their order ``part, piece, place``, ``role, text``."""
    short, long = _split(turns_of(df, conv_col, turn_col, role_col, text_col))
    whole = _short(short).select("conv_id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("piece"), "turns")
    if long is not None:
        whole = whole.unionByName(_long(long)[1])
    return whole.select("conv_id", "part", "piece", F.posexplode("turns").alias("place", "turn")).select("conv_id", "part", "piece", "place", "turn.*")
