"""A content-addressed WARC archive.

Payload bytes are stored once under their SHA-256; record headers are stored apart, byte for byte, with the address
of their payload. Reading verifies each payload against its address and joins headers and payloads again.

Defined cases: a null payload is empty. Rows with equal payloads of at least ``min_bytes`` bytes form a group: the row
with the largest id is the response, the others revisit it; rows that repeat the largest id are all responses. A null
id counts as smaller than any other. Blanks and control characters in a url are percent-encoded in the header; a null
url leaves its field out. An empty table makes an empty archive. Columns besides id, url and payload are not archived.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saldo.llm.common import new_path, table

#: Digits of Spark's base 32 and of RFC 4648, in order: fixed values.
SPARK_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32_DIGITS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"

PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32_sha1(payload: Column) -> Column:
    """SHA-1 in upper-case base 32: forty bits, ten hex digits, make eight characters."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digest, 1 + 10 * n, 10), 16, 32), 8, "0") for n in range(4)]
    return F.translate(F.concat(*parts), SPARK_DIGITS, BASE32_DIGITS)


def record_id(page: Column) -> Column:
    """A name-based UUID of the row's id."""
    digest = F.md5(F.concat(F.lit("page:"), F.coalesce(page.cast("string"), F.lit("null"))))
    cuts = ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *[F.substring(digest, a, n) for a, n in cuts]), F.lit(">"))


def _printable(url: Column) -> Column:
    for code in (0, *range(9, 14), 32):
        url = F.replace(url, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return url


def header_block(
    page: Column, url: Column, digest: Column, size: Column, response: Column, refers: Column, date: str
) -> Column:
    """The header of one record; concat_ws leaves out the fields that are null."""
    own = F.when(response, size).otherwise(0)
    fields = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(response, "response").otherwise("revisit")),
        F.concat(F.lit("WARC-Record-ID: "), record_id(page)),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), _printable(url)),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), digest),
        F.when(~response, f"WARC-Profile: {PROFILE}"),
        F.when(~response, F.concat(F.lit("WARC-Refers-To: "), record_id(refers))),
        F.concat(F.lit("Page-ID: "), page.cast("string")),
        F.when(~response, F.concat(F.lit("Refers-To-Page-ID: "), refers.cast("string"))),
        F.lit("Content-Type: text/html; charset=utf-8"),
        F.concat(F.lit("Content-Length: "), own.cast("string")),
    ]
    return F.concat(F.concat_ws("\r\n", *fields), F.lit("\r\n\r\n"))


def write_archive(
    pages: DataFrame,
    path: str,
    page: str = "page_id",
    url: str = "url",
    payload: str = "html",
    min_bytes: int = 0,
    date: str = "2000-01-01T00:00:00Z",
) -> None:
    """Write ``path``/payloads (address, payload) and ``path``/headers (header, address).

    Groups of copies are reduced before the shuffle: each task sends one payload and one largest id per address.
    """
    rows = pages.select(
        F.col(page).alias("page"),
        F.col(url).alias("url"),
        F.coalesce(F.col(payload).cast("binary"), F.lit(b"")).alias("payload"),
    ).withColumn("address", F.unhex(F.sha2("payload", 256)))
    # equal addresses are equal bytes, which the readers' check and the lengths and SHA-1 below confirm
    rows.groupBy("address").agg(F.any_value("payload").alias("payload")).write.parquet(f"{path}/payloads")

    keys = rows.select("page", "url", "address", F.octet_length("payload").cast("bigint").alias("size"), base32_sha1(F.col("payload")).alias("digest"))
    groups = keys.groupBy("address").agg(
        F.max("page").alias("newest"),
        (F.min("size") == F.max("size")).alias("same_size"),
        (F.min("digest") == F.max("digest")).alias("same_digest"),
    )
    groups = groups.withColumnRenamed("address", "group_address")
    joined = keys.join(groups, F.col("address") == F.col("group_address"))
    response = F.col("page").eqNullSafe(F.col("newest")) | (F.col("size") < min_bytes)
    sound = F.col("same_size") & F.col("same_digest")
    block = header_block(F.col("page"), F.col("url"), F.col("digest"), F.col("size"), response, F.col("newest"), date)
    block = F.when(sound, block).otherwise(F.raise_error(F.lit("two payloads share one address")))
    joined.select(block.alias("header"), "address").write.parquet(f"{path}/headers")


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Every record of an archive: header, payload and what they say.

    ``payload`` is the full payload also of revisits; ``record`` is the record as it was written. A payload that does
    not match its address or its header's digest fails the read. Columns that a caller does not select are not shuffled.
    """
    kept = spark.read.schema("address binary, payload binary").parquet(f"{path}/payloads")
    true = F.unhex(F.sha2("payload", 256)) == F.col("address")
    kept = kept.select(
        F.col("address").alias("stored_address"),
        "payload",
        F.when(true, F.octet_length("payload").cast("bigint"))
        .otherwise(F.raise_error(F.lit("a stored payload differs from its address")))
        .alias("payload_bytes"),
        base32_sha1(F.col("payload")).alias("payload_digest"),
    )
    heads = spark.read.schema("header string, address binary").parquet(f"{path}/headers")

    def said(name: str) -> Column:
        value = F.regexp_extract("header", rf"\r\n{name}: ([^\r\n]*)", 1)
        return F.when(value != "", value)

    heads = heads.select(
        "header",
        "address",
        said("Page-ID").cast("bigint").alias("page_id"),
        said("WARC-Target-URI").alias("target"),
        said("WARC-Payload-Digest").alias("said_digest"),
        said("WARC-Type").alias("record_type"),
        said("Refers-To-Page-ID").cast("bigint").alias("refers_to"),
    )
    both = heads.join(kept, F.col("address") == F.col("stored_address"))
    agreed = F.col("said_digest") == F.concat(F.lit("sha1:"), F.col("payload_digest"))
    digest = F.when(agreed, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a header's digest differs")))
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return both.select(
        "page_id",
        "target",
        "header",
        "payload",
        "payload_bytes",
        digest.alias("payload_digest"),
        "record_type",
        "refers_to",
        F.concat(F.col("header").cast("binary"), body, F.lit(b"\r\n\r\n")).alias("record"),
    )


def op5_warc(spark: SparkSession, directory: str) -> DataFrame:
    """Archive all pages, read the archive back and describe every record."""
    path = new_path(spark, "warc")
    write_archive(table(spark, directory, "pages"), path)
    return read_archive(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
with paid as (
  select page_id, encode(coalesce(html, '')) as payload, sha1(coalesce(html, '')) as hexed from pages),
named as (
  select page_id, octet_length(payload) as payload_bytes, hexed,
    list_aggregate(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
      1 + ((('0x' || substr(hexed, 1 + 10 * (i // 8), 10))::bigint >> (35 - 5 * (i % 8))::bigint) & 31)::bigint, 1)), 'string_agg', '')
      as payload_digest
  from paid)
select page_id, payload_bytes, payload_digest,
  case when page_id = max(page_id) over same then 'response' else 'revisit' end as record_type,
  case when page_id <> max(page_id) over same then max(page_id) over same end as refers_to
from named window same as (partition by hexed, payload_bytes)"""
