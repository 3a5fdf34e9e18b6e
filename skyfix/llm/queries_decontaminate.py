"""Query 5: documents that hold passages of the benchmark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .decontaminate import overlaps
from .shared import table


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return overlaps(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op5_decontaminate": op5_decontaminate}
SQL: dict[str, str] = {}
