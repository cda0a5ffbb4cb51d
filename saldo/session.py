"""Session settings and shared storage for the points where a plan is cut."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: UTC keeps instants comparable, ANSI makes overflow and bad casts loud, AQE re-plans on measured sizes.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
}


def configure(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings every job of this package relies on."""
    for key, value in SETTINGS.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``.

    Only a local-mode session (tests, the bench) may go without it, and uses its warehouse: there the
    driver and the executors are one process.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if not named and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder every executor can reach")
    return (named or spark.conf.get("spark.sql.warehouse.dir")).rstrip("/")


def own_path(spark: SparkSession, label: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/saldo/{label}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    This cuts lineage in a way that survives lost executors, and gives the next plan real file
    sizes, so that whether a side is broadcast is decided from a measured size.
    """
    spark = df.sparkSession
    path = own_path(spark, label)
    df.write.mode("errorifexists").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def unrolled(df: DataFrame, parts: Column, name: str) -> DataFrame:
    """``df`` once for each element of an array of several columns, as column ``name``; nulls among them give no row.

    The array is computed in a projection, which Spark compiles; inside a generator it would be interpreted for each row.
    """
    return df.withColumn(name, parts).withColumn(name, F.explode_outer(name)).filter(F.col(name).isNotNull())


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of configuration rows whose size the optimizer knows.

    Rows sent as a local collection have no statistics, so joins with them would shuffle the large
    side by a handful of keys. As literals of the plan they are small by measure and are broadcast.
    """
    fields = T.StructType.fromDDL(schema).fields

    def cell(value, field):
        literal = F.array() if value == [] else F.lit(value)
        return literal.cast(field.dataType).alias(field.name)

    if not rows:
        return spark.range(0).select(*[cell(None, f) for f in fields])
    structs = [F.struct(*[cell(v, f) for v, f in zip(row, fields, strict=True)]) for row in rows]
    return spark.range(1).select(F.inline(F.array(*structs)))
