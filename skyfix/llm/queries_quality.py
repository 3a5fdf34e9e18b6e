"""Query 3: quality measurements and verdict of every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .quality_rules import CURRENT, POLICIES, RULES, ledger, mask, passes
from .shared import table


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledgered = ledger(table(spark, sf_dir, "documents"))
    return ledgered.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "fail_bits",
        (F.col("fail_bits").bitwiseAND(F.lit(mask("base"))) != 0).alias("base_failed"), passes().alias("kept"),
    )


_BITS = " + ".join(f"(CASE WHEN {rule} THEN {1 << k} ELSE 0 END)" for k, rule in enumerate(RULES.values()))
_FAILED = {p: " OR ".join(f"({RULES[r]})" for r in rules) for p, rules in POLICIES.items()}
SQL_QUALITY = rf"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents
), tok AS (
  SELECT rid, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM base
), win AS (
  SELECT rid, unnest(range(1, len(words) - 3)) AS i, words FROM tok WHERE len(words) >= 5
), grams AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, array_to_string(words[i:i + 4], ' ')) AS c FROM win
), cov AS (
  SELECT rid, count(DISTINCT i + k) AS n_repeat_words FROM grams, range(0, 5) t(k) WHERE c > 1 GROUP BY rid
), m AS (
  SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
    CAST(length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, CAST(len(lines) AS BIGINT) AS n_lines,
    CAST(length(text) - length(regexp_replace(text, '\p{{Lu}}', '', 'g')) AS BIGINT) AS n_upper
  FROM tok LEFT JOIN cov USING (rid)
)
SELECT *, CAST({_BITS} AS BIGINT) AS fail_bits, ({_FAILED["base"]}) AS base_failed, NOT ({_FAILED[CURRENT]}) AS kept FROM m
"""
QUERIES = {"op3_quality_rules": op3_quality_rules}
SQL = {"op3_quality_rules": SQL_QUALITY}
