"""Scratch tables in the folder that the driver and all executors share.

A table that several branches of a plan read, or whose columns are long expressions that later
steps would repeat, is written once: the plan stays short, and a lost executor costs a retry.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; one of our own only where it is unset and all executors are this
    process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("skyfix.scratch.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-skyfix-")
        spark.conf.set("skyfix.scratch.dir", base)
    return base.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df``, written to a new table and read back."""
    path = f"{shared_folder(df.sparkSession)}/skyfix-core-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merged(left: DataFrame, right: DataFrame, on: list[str] | str, how: str = "inner") -> DataFrame:
    """A join whose sides are sorted and merged, never collected on the driver. Spark guesses a size from
    files, where rows that an explode repeats take nearly no room."""
    return left.hint("merge").join(right.hint("merge"), on, how)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` dealt by ``keys`` over as many tasks as a shuffle has. A small file is one task, however
    many rows a step makes of each of its; a number that is given is one that AQE keeps. Not for a
    frame that is grouped by ``keys`` already: Spark would drop the exchange."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
