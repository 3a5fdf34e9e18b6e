"""Query 12: damaged conversations and their cheapest repair."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .conversations import damaged, repair
from .shared import columns, table


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = columns(table(spark, sf_dir, "conversations"), conv_id="conv_id", turn="turn", role="role", text="text")
    return repair(damaged(rows))


QUERIES = {"op12_conversation_repair": op12_conversation_repair}
SQL: dict[str, str] = {}
