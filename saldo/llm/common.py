"""Helpers shared by the operators: words, shared tables and safe column names."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from saldo.session import shared_dir

#: What separates words everywhere in this subpackage: space, tab, line feed, VT, FF, carriage return.
BLANKS = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{directory}/{name}.parquet")


def words(text: Column) -> Column:
    """The words of a text as an array; null and blank texts have none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def new_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the folder that the driver and all executors share."""
    return f"{shared_dir(spark)}/llm/{label}-{uuid.uuid4().hex}"


def stored(df: DataFrame, label: str, partitions: int | None = None) -> DataFrame:
    """``df`` written as a table in the shared folder and read back: lineage ends at files that outlive executors."""
    path = new_path(df.sparkSession, label)
    (df.coalesce(partitions) if partitions else df).write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
