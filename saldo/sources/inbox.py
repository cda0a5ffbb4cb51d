"""A folder of documents: listing, admission, and the parser each record is sent to."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saldo.functions import ids

FILE_COLUMNS = "path string, modificationTime timestamp, length bigint, content binary"


def scan(spark: SparkSession, path: str, extension: str) -> DataFrame:
    """Documents with an extension (any case). A missing folder is an empty source, not an error."""
    any_case = "".join(f"[{c.lower()}{c.upper()}]" if c.isalpha() else c for c in extension)
    try:
        return spark.read.format("binaryFile").option("pathGlobFilter", f"*{any_case}").load(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" in str(error):
            return spark.createDataFrame([], FILE_COLUMNS)
        raise


def listing(files: DataFrame) -> DataFrame:
    return files.select(
        F.element_at(F.split("path", "/"), -1).alias("name"), F.col("length").alias("bytes"),
        F.col("modificationTime").alias("received_at"),
    ).orderBy("name")


def as_raw(files: DataFrame, source_id: str) -> DataFrame:
    """Raw records in name order, with the hash of the whole content."""
    return files.select(
        F.lit(source_id).alias("source_id"),
        F.col("path").alias("origin"),
        F.col("content").alias("payload"),
        ids.content_hash(F.col("content")).alias("content_hash"),
    ).withColumn("raw_id", ids.raw_id(F.col("source_id"), F.col("content_hash")))


def safe_name(name: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(name, "/"), -1), r"[^\w.\- ]+", "_")


def admit(uploads: DataFrame, extension: str = ".pdf") -> DataFrame:
    """``filename, content`` to a safe name and, when it is not admitted, the reason."""
    name = safe_name(F.col("filename"))
    head = F.substring("content", 1, 4)
    reason = (
        F.when(~F.lower(name).endswith(extension), "EXTENSION_NOT_ACCEPTED")
        .when((F.length("content") <= 4) | (head != F.lit(b"%PDF")), "NOT_A_PDF")
    )
    return uploads.withColumn("name", name).withColumn("rejected_because", reason).withColumn(
        "admitted", F.col("rejected_because").isNull()
    )


def route(payload: Column) -> Column:
    """The parser for a record (binary) by what it starts with; null when no layout is known.

    Blanks of any kind and number before a page do not count.
    """
    return F.when(F.substring(payload, 1, 2) == F.lit(b"%P"), "bank-statement").when(
        payload.cast("string").rlike(r'(?U)\A[\s\x{FEFF}]*\{"data"'), "gateway-transactions"
    )


def unroutable(raw: DataFrame) -> DataFrame:
    return raw.filter(route(F.col("payload").cast("binary")).isNull()).select(
        "raw_id", "origin", F.lit("UNKNOWN_LAYOUT").alias("code"), F.lit("no parser knows this layout").alias("message")
    )
