"""Query 9: words of every document that long passages of smaller documents cover."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import sha256_hex, table
from .substrings import remove_repeats


def op9_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    left = remove_repeats(table(spark, sf_dir, "documents"))
    return left.select("doc_id", "n_words", "n_removed", sha256_hex(F.col("kept")).alias("kept_sha256"))


QUERIES = {"op9_substrings": op9_substrings}
SQL: dict[str, str] = {}
