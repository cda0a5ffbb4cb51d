"""Incremental ingestion of landed gateway pages: whatever arrived since the last run, once."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from saldo.session import materialise, shared_dir
from saldo.sources import gateway, inbox
from saldo.sources.versions import VersionedTable, movement_table


def new_charges(spark: SparkSession, landing: str, source_id: str, account_id: str, counterparty: str) -> DataFrame:
    """A stream of charges from page files. No watermark: a first arrival counts however old its day is."""
    files = (
        spark.readStream.format("text").option("wholetext", "true").load(landing)
        .select(F.col("value").alias("payload"), F.col("_metadata.file_path").alias("origin"))
    )
    pages = gateway.decoded(gateway.as_raw(files, source_id))
    return gateway.charges(gateway.transactions(pages), account_id, counterparty)


def add_new(charges: DataFrame, target: str) -> None:
    """Append the charges whose ids the table does not hold; ids come from content, so a repeat is known by its own."""
    fresh = charges.dropDuplicates(["id"])
    try:
        held = charges.sparkSession.read.schema(charges.schema).parquet(target).select("id")
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
    else:
        fresh = fresh.join(held, "id", "left_anti")
    fresh.write.mode("append").parquet(target)


def ingest_available(charges: DataFrame, target: str, name: str, checkpoint: str | None = None) -> StreamingQuery:
    """Append everything that is there now and not yet held to a Parquet table, then stop.

    The query's own checkpoint remembers which files are done; it lives in the shared folder. A batch
    that runs twice after a failure finds its rows held already.
    """
    place = checkpoint or f"{shared_dir(charges.sparkSession)}/streams/{name}"
    return (
        charges.writeStream.foreachBatch(lambda rows, _: add_new(rows, target)).option("checkpointLocation", place)
        .trigger(availableNow=True).queryName(name).start()
    )


# ---- into the versioned store, with what is known of each transaction

STATE = "tx_id string, status string, raw_id string, run_id string"


def new_transactions(spark: SparkSession, landing: str, source_id: str) -> DataFrame:
    """A stream of the transactions of page files that route to the gateway's parser."""
    files = (
        spark.readStream.format("text").option("wholetext", "true").load(landing)
        .select(F.col("value").alias("payload"), F.col("_metadata.file_path").alias("origin"))
    )
    raw = gateway.as_raw(files, source_id)
    routed = inbox.route(F.col("payload").cast("binary")) == "gateway-transactions"
    return gateway.transactions(gateway.decoded(raw.filter(F.coalesce(routed, F.lit(False)))))


def state_table(spark: SparkSession, root: str, buckets: int = 64) -> VersionedTable:
    """The last known status of each transaction, by bucket of its id."""
    schema = T.StructType.fromDDL(STATE)
    return VersionedTable(spark, f"{root}/transactions", schema, "tx_id", {"_bucket": F.pmod(F.xxhash64("tx_id"), F.lit(buckets))})


def load(transactions: DataFrame, root: str, account_id: str, counterparty: str, run_id: str | None = None) -> tuple[int, int]:
    """Upsert one batch: approved transactions as charges, and every transaction's status.

    Both tables read the folders that the batch's ids fall into, no others, so a replay writes nothing
    and an id seen long ago is found at the cost of its bucket. In one batch an approval counts before
    any other status. Returns the versions of the two tables.
    """
    spark, run = transactions.sparkSession, F.lit(run_id).cast("string").alias("run_id")
    made = gateway.charges(transactions, account_id, counterparty).select("*", run)
    movements = movement_table(spark, f"{root}/movements", made.schema)
    movements.upsert(made, F.lit(0))
    known = transactions.select(F.col("tx.id").alias("tx_id"), F.col("tx.status").alias("status"), "raw_id", run)
    states = state_table(spark, root)
    states.upsert(known, F.when(F.col("status") == "APPROVED", 1).otherwise(0))
    return movements.version(), states.version()


def excluded_now(spark: SparkSession, root: str) -> DataFrame:
    """The notes that still stand: transactions whose last known status is not an approval, by page and status."""
    left = state_table(spark, root).read().filter(~F.col("status").eqNullSafe("APPROVED"))
    return left.groupBy("raw_id", "status").agg(F.count(F.lit(1)).alias("transactions"))


def load_available(transactions: DataFrame, root: str, name: str, account_id: str, counterparty: str, run_id: str | None = None) -> StreamingQuery:
    """Load every page file that is there now and not yet loaded, then stop."""
    place = f"{root}/streams/{name}"

    def each(rows: DataFrame, _: int) -> None:
        rows = materialise(rows, "landed")
        if not rows.isEmpty():
            load(rows, root, account_id, counterparty, run_id)

    return (
        transactions.writeStream.foreachBatch(each).option("checkpointLocation", place)
        .trigger(availableNow=True).queryName(name).start()
    )
