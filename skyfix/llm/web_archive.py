"""A content-addressed web archive: payload bytes once, exact record headers apart.

``write_archive`` keeps two tables. ``payloads`` has every distinct payload once, under its
SHA-256. The address is verified: all records under one address must agree in length and
in SHA-1 when they are written, and the bytes are hashed again when they are read. ``records``
has one row per record with its header block exactly as it stands in a WARC file, its HTTP
header block and the address of its payload. ``read_archive`` joins the two and gives back
the original records, byte for byte; ``parsed`` takes such records apart again.

Of records with equal payloads the one with the smallest id is the response, the others are
revisits that refer to it.

Defined results: a null payload is the empty one, and equal to it; rows that share the
smallest id of their payload (repeated rows) are all responses; rows with a null id are
revisits if another record has their payload, else responses; a null url is left out of
the header, and line ends in a url are percent-encoded, so they can't add header lines; an
empty table gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .membership import bitmap, marked
from .shared import columns, written

CRLF = "\r\n"
#: Fixed value: the alphabet of base32 (RFC 4648).
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: The capture date of records that come without one.
DATE = "1970-01-01T00:00:00Z"
ID = "urn:page:"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32: five hexadecimal digits of the SHA-1 make four symbols."""
    digest = F.sha1(payload)
    symbols = []
    for i in range(8):
        twenty = F.conv(F.substring(digest, 5 * i + 1, 5), 16, 10).cast("int")
        symbols += [F.substr(F.lit(BASE32), F.shiftright(twenty, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*symbols)


def _payloads(rows: DataFrame) -> DataFrame:
    """``address, owner, size, digest, payload`` of every distinct payload. Only the payloads
    that occur twice are shuffled, each reduced to one a task first."""
    facts = rows.select("address", "id", F.octet_length("payload").cast("long").alias("size"), base32_sha1(F.col("payload")).alias("digest"))
    same = (F.min("size") == F.max("size")) & (F.min("digest") == F.max("digest"))
    checked = F.when(same, F.count("*")).otherwise(F.raise_error(F.lit("different payloads under one address")))
    twice = written(facts.groupBy("address").agg(checked.alias("n")).where("n > 1").select("address"), "twice")
    split = marked(rows.select("address", "id", "payload"), ["address"], bitmap(twice, ["address"]))
    alone = split.where("not _maybe").select("address", F.col("id").alias("owner"), "payload")
    again = split.where("_maybe").groupBy("address").agg(F.min("id").alias("owner"), F.first("payload").alias("payload"))
    sized = alone.unionByName(again).withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", base32_sha1(F.col("payload")))
    return written(sized.select("address", "owner", "size", "digest", "payload"), "payloads")


def write_archive(df: DataFrame, id_col: str, url_col: str, payload_col: str, date: str = DATE) -> tuple[DataFrame, DataFrame]:
    """``records`` and ``payloads``, both written to the shared folder."""
    rows = columns(df, id=id_col, url=url_col, payload=payload_col)
    rows = rows.withColumn("payload", F.coalesce(F.col("payload").cast("binary"), F.lit(b"")))
    rows = rows.withColumn("address", F.sha2("payload", 256))
    payloads = _payloads(rows)
    joined = rows.select("address", "id", "url").join(payloads.select("address", "owner", "size", "digest"), "address")
    # A null id is no owner; it is a response only where no record of the payload has an id.
    revisit = F.when(F.col("id").isNull(), F.col("owner").isNotNull()).otherwise(F.col("id") != F.col("owner"))
    joined = joined.withColumn("revisit", revisit)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("size").cast("string"), F.lit(CRLF * 2))
    joined = joined.withColumn("http", http)
    line = lambda name, value, where=None: F.when(F.lit(True) if where is None else where, F.concat(F.lit(name + ": "), value, F.lit(CRLF))).otherwise(F.lit(""))
    uri = lambda c: F.concat(F.lit(f"<{ID}"), F.coalesce(F.col(c).cast("string"), F.lit("none")), F.lit(">"))
    length = F.octet_length("http") + F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("size"))
    target = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", uri("id")),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", target, F.col("url").isNotNull()),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Profile", F.lit(PROFILE), F.col("revisit")),
        line("WARC-Refers-To", uri("owner"), F.col("revisit")),
        line("Content-Type", F.lit("application/http; msgtype=response")),
        line("Content-Length", length.cast("string")),
        F.lit(CRLF),
    )
    return written(joined.select("address", header.alias("header"), "http"), "records"), payloads


def read_archive(records: DataFrame, payloads: DataFrame) -> DataFrame:
    """``record``: every original record, all bytes as in a WARC file. The payload's digest is
    verified again."""
    intact = F.when(F.sha2("payload", 256) == F.col("address"), F.col("payload")).otherwise(F.raise_error(F.lit("a payload is damaged")).cast("binary"))
    back = records.join(payloads.select("address", intact.alias("payload")), "address")
    body = F.when(field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return back.select(F.concat(F.col("header").cast("binary"), F.col("http").cast("binary"), body, F.lit((CRLF * 2).encode())).alias("record"))


def parsed(warc: DataFrame) -> DataFrame:
    """``header, http, payload, payload_bytes, payload_digest`` of every ``record``. A revisit
    has no payload of its own; its size and digest are those that its headers state."""
    ends = CRLF * 2
    text = warc.select("record").withColumn("header", F.substring_index(F.col("record").cast("string"), ends, 1))
    text = text.withColumn("rest", F.expr(f"substring(record, octet_length(header) + {len(ends) + 1}, octet_length(record) - octet_length(header) - {2 * len(ends)})"))
    text = text.withColumn("http", F.substring_index(F.col("rest").cast("string"), ends, 1))
    text = text.withColumn("header", F.concat("header", F.lit(ends))).withColumn("http", F.concat("http", F.lit(ends)))
    text = text.withColumn("payload", F.expr("substring(rest, octet_length(http) + 1)"))
    whole = field("WARC-Type") == "response"
    size = F.when(whole, F.octet_length("payload")).otherwise(F.regexp_extract("http", r"\r\nContent-Length: (\d+)\r\n", 1)).cast("long")
    digest = F.when(whole, base32_sha1(F.col("payload"))).otherwise(F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", ""))
    return text.select("header", "http", "payload", size.alias("payload_bytes"), digest.alias("payload_digest"))


def field(name: str) -> Column:
    """A field of the header block; null where it is missing."""
    found = F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.when(found != "", found)


def id_field(name: str) -> Column:
    return F.expr(f"try_cast(nullif(regexp_extract(header, '\\\\r\\\\n{name}: <{ID}([^>]*)>', 1), '') as bigint)")
