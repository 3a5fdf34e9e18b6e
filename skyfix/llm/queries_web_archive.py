"""Query 1: every page written to a content-addressed archive and read back."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .shared import table
from .web_archive import field, id_field, parsed, read_archive, write_archive


def op1_web_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = parsed(read_archive(*write_archive(table(spark, sf_dir, "pages"), "page_id", "url", "html")))
    return back.select(
        id_field("WARC-Record-ID").alias("page_id"), "payload_bytes", "payload_digest",
        field("WARC-Type").alias("record_type"), id_field("WARC-Refers-To").alias("refers_to"),
    )


_DIGITS = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', ((CAST('0x' || substr(hex, {5 * i + 1}, 5) AS INTEGER) >> {s}) & 31) + 1, 1)"
    for i in range(8) for s in (15, 10, 5, 0)
)
SQL_ARCHIVE = f"""
WITH p AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS hex,
    min(page_id) OVER (PARTITION BY coalesce(html, '')) AS owner
  FROM pages
)
SELECT page_id, payload_bytes, {_DIGITS} AS payload_digest,
  CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> owner THEN owner END AS refers_to
FROM p
"""
QUERIES = {"op1_web_archive": op1_web_archive}
SQL = {"op1_web_archive": SQL_ARCHIVE}
