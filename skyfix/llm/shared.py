"""Helpers that every training-data operator uses: table paths, scratch tables, names.

Scratch tables are Parquet folders under ``spark.checkpoint.dir``, the folder that all
executors and the driver share, so a lost executor never loses an intermediate result.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but space, tab, line feed, vertical tab, form feed, return.
WORD = r"[^\x20\x09-\x0D]+"


BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; one of our own only where none is set and all executors
    are this process (tests)."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("skyfix.scratch.dir", None)
        if not base:
            if not spark.sparkContext.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
            base = "file://" + tempfile.mkdtemp(prefix="spark-skyfix-")
            spark.conf.set("skyfix.scratch.dir", base)
    return base.rstrip("/")


def written(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to a new table in the shared folder and read it back (cuts lineage)."""
    path = f"{shared_folder(df.sparkSession)}/skyfix-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def merged(left: DataFrame, right: DataFrame, on: str | Column, how: str = "inner") -> DataFrame:
    """A join whose sides are sorted and merged, never collected on the driver. Spark guesses a size from
    files, which an explode or Python step multiplies unseen and which repeated values make small."""
    return left.hint("merge").join(right.hint("merge"), on, how)


def drop_written(df: DataFrame) -> None:
    """Delete the table that ``written`` made; call it only once nothing reads it any more."""
    spark = df.sparkSession
    for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def columns(df: DataFrame, **named: str) -> DataFrame:
    """Only the columns an operator needs, under its own names, so extra ones can't clash."""
    conf = df.sparkSession.conf
    if conf.get(BATCH_ROWS) == "10000":  # Spark's default; whole texts need smaller batches
        conf.set(BATCH_ROWS, "1000")
    return df.select([F.col(f"`{old}`").alias(new) for new, old in named.items()])


def fan_out(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def sha256_hex(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def where_computed(df: DataFrame, condition: Column) -> DataFrame:
    """A filter on computed columns that stays above them. Spark would push it through the
    projections and put the columns' whole expressions into it, where a lambda then computes
    them again for every element; a column that isn't deterministic holds it in place."""
    return df.withColumn("_fence", F.rand(0)).where(condition & (F.col("_fence") >= 0)).drop("_fence")


def sliced(batches: Iterator[pa.RecordBatch], rows: int = 256) -> Iterator[pa.RecordBatch]:
    """The batches in small slices, so that few rows at a time become Python objects."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)
    pa.default_memory_pool().release_unused()  # the worker may now wait for another stage
