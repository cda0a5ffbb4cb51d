"""All registered queries by name, with results in types any engine can compare."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saldo.plans import catalogue_erp, catalogue_flow, catalogue_ingest
from saldo.plans.fixtures import Workspace

QUERIES = {**catalogue_flow.QUERIES, **catalogue_erp.QUERIES, **catalogue_ingest.QUERIES}


def portable(df: DataFrame) -> DataFrame:
    """Dates and instants as text, integers as bigint, exact decimals of scale 0 as bigint."""
    columns = []
    for field in df.schema.fields:
        c, kind = F.col(f"`{field.name}`"), field.dataType
        if isinstance(kind, (T.DateType, T.TimestampType)):
            c = c.cast("string")
        elif isinstance(kind, T.DecimalType) or isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType)):
            c = c.cast("bigint")
        elif isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StringType):
            c = F.array_join(c, ",")
        columns.append(c.alias(field.name))
    return df.select(*columns)


def run(name: str, spark: SparkSession, directory: str) -> DataFrame:
    """One query over a directory of tables; stages are shared between the queries of a session."""
    return portable(QUERIES[name](Workspace.of(spark, directory)))


def run_alone(name: str, spark: SparkSession, directory: str) -> DataFrame:
    """The same query with every stage built anew, as a benchmark must."""
    return portable(QUERIES[name](Workspace(spark, directory)))
