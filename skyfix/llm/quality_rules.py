"""Quality rules as a bitmask ledger, all in DataFrame functions.

Every rule is evaluated once per document; the ledger keeps the measurements and one
``fail_bits`` column with a bit per rule. A policy is a version name and the set of rules
it enforces, so a new policy is a new mask over the same ledger, and its ablations (what
each rule alone rejects, what would be kept without it) are bitwise aggregates of at most
2**rules distinct masks: no text is read again.

Defined results: a null text has no words (and no symbols or lines) and fails
``few_words``; ties and repeated rows are judged alike and stay separate rows; very long
texts are measured whole; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import WORD, columns, where_computed

#: Rule name: SQL over the measurements that is true where a document fails. The order
#: gives the bits, so append new rules and never reorder.
RULES = {
    "few_words": "n_words < 10",
    "repeated_windows": "100 * n_repeat_words > 20 * n_words",
    "symbols": "100 * n_symbols > 20 * n_words",
    "repeated_lines": "100 * n_dup_lines > 50 * n_lines",
    "word_length": "word_chars < 2 * n_words or word_chars > 15 * n_words",
    "shouting": "100 * n_upper > 40 * word_chars",
}
#: Policy version: the rules it enforces. The base rules are part of every policy.
BASE = ("few_words", "repeated_windows")
POLICIES = {
    "base": BASE,
    "v1": (*BASE, "symbols", "repeated_lines", "word_length", "shouting"),
}
CURRENT = "v1"
#: Words in a repeated window.
WINDOW = 5


def mask(policy: str) -> int:
    return sum(1 << list(RULES).index(r) for r in POLICIES[policy])


def _covered(at: str) -> str:
    """Words under windows that start at the sorted places ``at``."""
    steps = f"aggregate(sequence(1, size({at}) - 1), {WINDOW}L, (n, i) -> n + least({WINDOW}L, {at}[i] - {at}[i - 1]))"
    return f"case when size({at}) > 1 then {steps} when size({at}) = 1 then {WINDOW}L else 0L end"


def measure(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id`` and the measurements. Each step is a projection of its own: what a lambda
    looks up must be a finished column, not an expression to evaluate for each element."""
    rows = columns(df, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    rows = rows.select(
        "doc_id",
        F.regexp_extract_all("text", F.lit(f"({WORD})"), F.lit(1)).alias("words"),
        lines.alias("lines"),
        F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count("text", F.lit(r"\p{Lu}")).cast("long").alias("n_upper"),
    )
    rows = rows.select(
        "doc_id", "n_symbols", "n_upper",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.transform("words", lambda w: F.xxhash64(w)).alias("h"),
    )
    window = ", ".join(f"h[i + {k}]" if k else "h[i]" for k in range(WINDOW))
    rows = rows.withColumn("w", F.expr(f"case when n_words >= {WINDOW} then transform(sequence(0, size(h) - {WINDOW}), i -> xxhash64({window})) else cast(array() as array<bigint>) end")).drop("h")
    rows = rows.withColumn("twice", F.size(F.array_distinct("w")) < F.size("w"))
    rows = rows.withColumn("s", F.expr("case when twice then sort_array(transform(w, (x, i) -> named_struct('x', x, 'i', cast(i as bigint)))) end")).drop("w", "twice")
    same = "(i > 0 and s[i - 1].x = e.x) or (i + 1 < size(s) and s[i + 1].x = e.x)"
    rows = rows.withColumn("at", F.expr(f"sort_array(transform(filter(s, (e, i) -> {same}), e -> e.i))")).drop("s")
    return rows.withColumn("n_repeat_words", F.coalesce(F.expr(_covered("at")), F.lit(0)).cast("long")).drop("at")


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Measurements and ``fail_bits`` of every row."""
    measured = measure(df, id_col, text_col)
    bits = F.lit(0).cast("long")
    for k, rule in enumerate(RULES.values()):
        bits = bits.bitwiseOR(F.when(F.expr(rule), F.lit(1 << k)).otherwise(F.lit(0)).cast("long"))
    return measured.withColumn("fail_bits", bits)


def passes(policy: str = CURRENT) -> Column:
    return F.col("fail_bits").bitwiseAND(F.lit(mask(policy))) == 0


def ablations(ledgered: DataFrame, policy: str = CURRENT) -> DataFrame:
    """One row per rule of a policy: documents that fail it, that fail only it, and that
    are kept with the policy and without the rule."""
    enforced = F.col("fail_bits").bitwiseAND(F.lit(mask(policy)))
    seen = ledgered.groupBy(enforced.alias("bits")).agg(F.count("*").alias("n"))
    names = F.array(*[F.struct(F.lit(r).alias("rule"), F.lit(1 << k).cast("long").alias("bit")) for k, r in enumerate(RULES) if r in POLICIES[policy]])
    each = seen.withColumn("r", F.explode(names)).select("r.rule", "r.bit", "bits", "n")
    total = lambda where: F.coalesce(F.sum(F.when(where, F.col("n"))), F.lit(0))
    failed, alone = F.col("bits").bitwiseAND(F.col("bit")) != 0, F.col("bits") == F.col("bit")
    none = F.col("bits") == 0
    return each.groupBy("rule").agg(total(failed).alias("n_failed"), total(alone).alias("n_failed_alone"), total(none).alias("n_kept"), total(none | alone).alias("n_kept_without"))


def keep(df: DataFrame, policy: str = CURRENT, text_col: str = "text") -> DataFrame:
    """The rows of ``df`` that pass a policy, with all their columns."""
    whole = df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("_row"), F.col(f"`{text_col}`").alias("_text"))
    return where_computed(ledger(whole, "_row", "_text"), passes(policy)).select("doc_id.*")
