"""Query 4: SimHash near-duplicate components over every document."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .shared import table
from .simhash import near_duplicates


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op4_simhash": op4_simhash}
SQL: dict[str, str] = {}
