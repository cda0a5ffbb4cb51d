"""Landed gateway pages: JSON text, one page per record, to charges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saldo.functions import ids

# Fixed format: a page of gateway transactions.
PAGE_SCHEMA = """
    data array<struct<id: string, reference: string, amount_in_cents: bigint, currency: string,
        status: string, created_at: string, finalized_at: string, payment_method_type: string,
        customer_email: string>>,
    meta struct<page: int, page_size: int, total_results: int>
"""
BUSINESS_ZONE = "America/Bogota"


def read_pages(spark: SparkSession, path: str, source_id: str) -> DataFrame:
    """One raw record per landed page file."""
    files = spark.read.text(path, wholetext=True).select(
        F.col("value").alias("payload"), F.col("_metadata.file_path").alias("origin")
    )
    return as_raw(files, source_id)


def as_raw(pages: DataFrame, source_id: str) -> DataFrame:
    """``payload, origin`` to raw records with a content hash and a derived id."""
    return pages.withColumn("source_id", F.lit(source_id)).withColumn(
        "content_hash", ids.content_hash(F.col("payload"))
    ).withColumn("raw_id", ids.raw_id(F.col("source_id"), F.col("content_hash")))


def decoded(raw: DataFrame) -> DataFrame:
    """Add ``page``; null where the payload is no page with a data list."""
    parsed = F.from_json(F.col("payload").cast("string"), PAGE_SCHEMA)
    return raw.withColumn("page", F.when(parsed["data"].isNotNull(), parsed))


def rejected(decoded_pages: DataFrame) -> DataFrame:
    """Pages without a data list are rejected whole."""
    return decoded_pages.filter("page is null").select(
        "raw_id", "origin", F.lit("PARSE_INTEGRITY").alias("code"), F.lit("payload has no data array").alias("message")
    )


def transactions(decoded_pages: DataFrame) -> DataFrame:
    return decoded_pages.filter("page is not null").select(
        "raw_id", "source_id", F.explode("page.data").alias("tx")
    )


def excluded(transaction_rows: DataFrame) -> DataFrame:
    """What was left out, per page and status; a transaction without a status counts under null."""
    return transaction_rows.filter(~F.col("tx.status").eqNullSafe("APPROVED")).groupBy(
        "raw_id", F.col("tx.status").alias("status")
    ).agg(F.count(F.lit(1)).alias("transactions"))


def charges(transaction_rows: DataFrame, account_id, counterparty: str, zone: str = BUSINESS_ZONE) -> DataFrame:
    """Approved transactions as CHARGE movements. The day is the local one: it decides the batch."""
    at = F.to_timestamp(F.coalesce("tx.finalized_at", "tx.created_at"))
    rows = transaction_rows.filter("tx.status = 'APPROVED'").select(
        (F.lit(account_id) if isinstance(account_id, str) else account_id).alias("account_id"),
        F.col("tx.reference").alias("external_id"),
        at.alias("occurred_at"),
        F.to_date(F.from_utc_timestamp(at, zone)).alias("value_date"),
        F.lit("CHARGE").alias("type"),
        F.col("tx.amount_in_cents").alias("amount_cents"),
        F.lit("COP").alias("currency"),
        F.lit(counterparty).alias("counterparty"),
        F.trim(F.concat(F.lit("Pago aprobado "), F.coalesce("tx.payment_method_type", F.lit("")))).alias("description"),
        F.struct("source_id", F.col("raw_id").alias("raw_record_id"), F.col("tx.id").alias("locator")).alias("source"),
        F.create_map(
            F.lit("transactionId"), F.col("tx.id"),
            F.lit("paymentMethod"), F.coalesce("tx.payment_method_type", F.lit("UNKNOWN")),
        ).alias("metadata"),
    )
    return with_ids(rows)


def with_ids(rows: DataFrame) -> DataFrame:
    """Prefix canonical rows with their content-derived movement id."""
    made = ids.movement_id(
        F.col("source.source_id"), F.col("external_id"), F.col("value_date"), F.col("amount_cents"), F.col("type"),
        F.col("source.locator"),
    )
    return rows.select(made.alias("id"), "*")
