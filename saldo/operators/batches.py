"""Settlement batches: charges that fall due together settle together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saldo.config import BATCHABLE, DEDUCTIONS
from saldo.functions import calendar as cal
from saldo.functions import ids

POLICY = ("cadence", "cutoff_minutes", "cutoff_zone", "week_ends_on", "month_ends_on", "window_from", "window_to")


def accrue(
    movements: DataFrame, accounts: DataFrame, channels: DataFrame, calendar: DataFrame
) -> DataFrame:
    """Add accrual, close and due date to every movement that takes part in a batch.

    ``accounts`` maps a gateway account to its channel and to the bank account it is paid into.
    """
    policy = channels.select("channel", *POLICY)
    scoped = (
        movements.filter(F.col("type").isin(*BATCHABLE))
        .join(accounts.select("account_id", "channel", "bank_account_id"), "account_id")
        .join(policy, "channel")
        .withColumn(
            "accrual_date",
            cal.accrual_date(
                F.col("occurred_at"), F.col("value_date"), F.col("cutoff_minutes"), F.col("cutoff_zone")
            ),
        )
        .withColumn(
            "close_date",
            cal.close_date(
                F.col("accrual_date"), F.col("cadence"), F.col("week_ends_on"), F.col("month_ends_on")
            ),
        )
    )
    return cal.with_business_day_after(
        scoped, calendar, "close_date", F.col("window_from"), "due_date"
    )


def build(accrued: DataFrame) -> DataFrame:
    """One row per (account, due date). Amounts only: members stay rows, see :func:`members`."""

    def part(kind: str) -> Column:
        return F.sum(F.when(F.col("type") == kind, F.col("amount_cents")))

    grouped = accrued.groupBy("account_id", "channel", "bank_account_id", "due_date").agg(
        F.max("close_date").alias("batch_date"),
        F.count(F.when(F.col("type") == "CHARGE", 1)).alias("n_charges"),
        F.coalesce(
            F.sum(F.when(F.col("type").isin("CHARGE", "REFUND", "CHARGEBACK"), F.col("amount_cents"))),
            F.lit(0),
        ).alias("gross_cents"),
        *[F.abs(part(kind)).alias(f"{kind.lower()}_cents") for kind in DEDUCTIONS],
    )
    amounts = [F.col(f"{kind.lower()}_cents") for kind in DEDUCTIONS]
    stated = sum((F.coalesce(a, F.lit(0)) for a in amounts), F.lit(0))
    kinds = sum((a.isNotNull().cast("int") for a in amounts), F.lit(0))
    return grouped.select(
        ids.batch_id(F.col("account_id"), F.col("batch_date")).alias("batch_id"),
        "*",
        stated.cast("bigint").alias("deductions_cents"),
        kinds.alias("deduction_kinds"),
        (F.col("gross_cents") - stated).cast("bigint").alias("expected_net_cents"),
    )


def members(accrued: DataFrame, batches: DataFrame) -> DataFrame:
    """Which movement belongs to which batch, one row each."""
    return accrued.join(
        batches.select("account_id", "due_date", "batch_id", "batch_date"), ["account_id", "due_date"]
    ).select(
        "batch_id", "account_id", "batch_date", F.col("id").alias("movement_id"), "type", "value_date",
        "amount_cents",
    )


def deduction_rows(batches: DataFrame) -> DataFrame:
    """The deductions a source stated, one row per batch and kind."""
    return batches.select(
        "batch_id",
        F.explode(
            F.array(
                *[
                    F.struct(F.lit(k).alias("kind"), F.col(f"{k.lower()}_cents").alias("amount_cents"))
                    for k in DEDUCTIONS
                ]
            )
        ).alias("d"),
    ).select("batch_id", "d.kind", "d.amount_cents", F.lit("EXPLICIT").alias("basis")).filter(
        "amount_cents is not null"
    )


def identity_holds(tolerance: int) -> Column:
    """Net plus deductions recompose the gross, within a tolerance."""
    recomposed = F.col("expected_net_cents") + F.col("deductions_cents")
    return F.abs(recomposed - F.col("gross_cents")) <= tolerance


def in_range(batches: DataFrame, start: str, end: str) -> DataFrame:
    """The batches of a run: those whose closing date lies in its range."""
    return batches.filter(F.col("batch_date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
