"""Query 10: personal data in every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .personal_data import BASE, find_spans, listed
from .shared import sha256_hex, table


def op10_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_spans(table(spark, sf_dir, "documents"))
    counts = [F.size(k).cast("long").alias(f"n_{k}") for k in BASE]
    return found.select("doc_id", *counts, sha256_hex(listed("base")).alias("base_sha256"), listed("spans").alias("spans"))


QUERIES = {"op10_personal_data": op10_personal_data}
SQL: dict[str, str] = {}
