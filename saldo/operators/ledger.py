"""Questions asked of the one table of signed movements."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saldo.config import MOVEMENT_TYPES
from saldo.sources.versions import VersionedTable

ORDER = ("value_date", "id")


def by_account(
    movements: DataFrame, account: str | None = None, start: str | None = None, end: str | None = None
) -> DataFrame:
    """An account's movements, optionally inside an inclusive range of value dates."""
    found = movements
    if account is not None:
        found = found.filter(F.col("account_id") == account)
    return between(found, start, end)


def between(movements: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    if start is not None:
        movements = movements.filter(F.col("value_date") >= F.to_date(F.lit(start)))
    if end is not None:
        movements = movements.filter(F.col("value_date") <= F.to_date(F.lit(end)))
    return movements


def by_ids(movements: DataFrame, ids: DataFrame) -> DataFrame:
    """The movements whose id is listed; ids that do not exist are skipped."""
    return movements.join(ids.select("id").distinct(), "id", "left_semi")


def by_external(movements: DataFrame, external_id: Column | str) -> DataFrame:
    return movements.filter(F.col("external_id") == external_id)


def by_type(movements: DataFrame, *types: str) -> DataFrame:
    unknown = set(types) - set(MOVEMENT_TYPES)
    if unknown:
        raise ValueError(f"unknown movement types: {sorted(unknown)}")
    return movements.filter(F.col("type").isin(*types))


def count_by_account(movements: DataFrame) -> DataFrame:
    return movements.groupBy("account_id").agg(F.count(F.lit(1)).alias("movements"))


def total(movements: DataFrame, *keys: str) -> DataFrame:
    """Signed sum; an empty ledger sums to zero."""
    return movements.groupBy(*keys).agg(
        F.coalesce(F.sum("amount_cents"), F.lit(0)).cast("bigint").alias("total_cents")
    )


def balance_at(movements: DataFrame, day: str) -> DataFrame:
    return total(between(movements, end=day), "account_id").withColumnRenamed(
        "total_cents", "balance_cents"
    )


def daily_balances(movements: DataFrame) -> DataFrame:
    """The running balance of every account on every day it moved.

    Days are summed first, so the ordered pass sees one row per account and day, however many
    movements a single account has.
    """
    days = movements.groupBy("account_id", "value_date").agg(
        F.sum("amount_cents").alias("day_cents"), F.count(F.lit(1)).alias("movements")
    )
    upto = Window.partitionBy("account_id").orderBy("value_date").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    return days.withColumn("balance_cents", F.sum("day_cents").over(upto))


def page(movements: DataFrame, limit: int, cursor: str | None = None, offset: int = 0) -> DataFrame:
    """A page in (value_date, id) order; each row carries the total and the next page's cursor.

    A cursor is the last id seen and wins over an offset. An unknown cursor starts at the beginning.
    """
    rest, skip = movements, offset
    if cursor is not None:
        skip = 0
        seen = movements.filter(F.col("id") == cursor).agg(F.max("value_date")).scalar()
        after = (F.col("value_date") > F.col("__seen")) | (
            (F.col("value_date") == F.col("__seen")) & (F.col("id") > F.lit(cursor))
        )
        rest = movements.withColumn("__seen", seen).filter(F.col("__seen").isNull() | after).drop("__seen")
    ordered = rest.orderBy(*ORDER)
    ordered = ordered.offset(skip) if skip else ordered
    rows = ordered.limit(limit)
    found = ordered.limit(limit + 1).agg(F.count(F.lit(1))).scalar()
    last = rows.agg(F.max_by("id", F.struct(*ORDER))).scalar()
    return rows.withColumn("total", movements.agg(F.count(F.lit(1))).scalar()).withColumn(
        "next_cursor", F.when(found > limit, last)
    )


def accounts(movements: DataFrame) -> DataFrame:
    return movements.select("account_id").distinct()


# ---- the same questions of the versioned store, which knows what each of its folders adds up to


def stored_balance_at(table: VersionedTable, day: str) -> DataFrame:
    """Balances at the end of a day: the sums of earlier months' folders, and the movements of its own month alone.

    A late movement rewrites its own folder and that folder's sums, so every later balance has it.
    """
    month = day[:7]
    earlier = table.folder_sums().filter(F.col("_month") < month).select("account_id", "amount_cents")
    own = table.rows_in(F.col("_month") == month).filter(F.col("value_date") <= F.to_date(F.lit(day)))
    both = earlier.unionByName(own.select("account_id", F.col("amount_cents").cast("decimal(38,0)").alias("amount_cents")))
    return total(both, "account_id").withColumnRenamed("total_cents", "balance_cents")


def stored_page(table: VersionedTable, limit: int, cursor: str | None = None, offset: int = 0, account: str | None = None) -> DataFrame:
    """A page in (value_date, id) order, with the total and the next cursor, read from the months it lies in.

    The folders' row counts say which months these are. A cursor is the last id seen and wins over an
    offset; its bucket follows from the id. An unknown cursor starts at the beginning.
    """
    mine = F.lit(True) if account is None else F.col("account_id") == account
    counted = table.folder_sums().filter(mine).groupBy("_month").agg(F.sum("rows").alias("rows"))
    months = sorted(counted.collect(), key=lambda m: (m["_month"] != "none", m["_month"]))  # a row for each month
    whole = sum(m["rows"] for m in months)
    seen = None
    if cursor is not None:
        offset = 0
        asked = table.spark.range(1).select(F.lit(cursor).alias("id"))
        bucket = asked.select(table.partitions["_bucket"].cast("string").alias("b")).first()["b"]
        seen = table.rows_in(F.col("_bucket") == bucket).filter(mine & (F.col("id") == cursor)).select("_month", "value_date").first()
    first, skipped = 0, 0
    if seen is not None:
        first = next(n for n, m in enumerate(months) if m["_month"] == seen["_month"])
        enough = months[first]["rows"] + limit + 1
    else:
        while first < len(months) and skipped + months[first]["rows"] <= offset:
            skipped += months[first]["rows"]
            first += 1
        enough = offset - skipped + limit + 1
    held, read = 0, []
    for m in months[first:]:
        if held >= enough:
            break
        read.append(m["_month"])
        held += m["rows"]
    rows = table.rows_in(F.col("_month").isin(read)).filter(mine)
    if seen is not None:
        day = F.lit(seen["value_date"])
        rows = rows.filter((F.col("value_date") > day) | (F.col("value_date").eqNullSafe(day) & (F.col("id") > cursor)))
    ordered = rows.orderBy(*ORDER).drop("_month", "_bucket")
    ordered = ordered.offset(offset - skipped) if offset > skipped else ordered
    shown = ordered.limit(limit)
    found = ordered.limit(limit + 1).agg(F.count(F.lit(1))).scalar()
    last = shown.agg(F.max_by("id", F.struct(*ORDER))).scalar()
    return shown.withColumn("total", F.lit(whole).cast("bigint")).withColumn("next_cursor", F.when(found > limit, last))
