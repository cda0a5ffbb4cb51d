"""Exported journal tables: heads and lines as the ERP keeps them, to signed single-entry lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saldo.functions.money import from_major

UNNUMBERED = "(borrador sin numerar)"


def account_code(label: Column) -> Column:
    return F.split(label, " ", 2)[0]


def account_name(label: Column) -> Column:
    return F.coalesce(F.get(F.split(label, " ", 2), F.lit(1)), F.lit(""))


def heads(moves: DataFrame) -> DataFrame:
    """``id, journal_id, name, ref, date, state``; the export writes ``false`` for an empty text."""
    name = F.when(F.col("name").isNull() | F.col("name").isin("", "false"), UNNUMBERED).otherwise(F.col("name"))
    ref = F.when(~F.col("ref").isin("", "false"), F.col("ref"))
    state = F.when(F.col("state").isin("posted", "cancel"), F.col("state")).otherwise("draft")
    return moves.select(
        F.col("id").cast("string").alias("entry_id"), "journal_id", name.alias("name"), ref.alias("ref"), F.col("date").cast("date").alias("date"), state.alias("state")
    )


def lines(move_lines: DataFrame) -> DataFrame:
    """``id, move_id, account, debit, credit, name``: one signed amount per line, debit positive."""
    return move_lines.select(
        F.col("id").alias("line_id"), F.col("move_id").cast("string").alias("entry_id"),
        account_code(F.col("account")).alias("account_code"), account_name(F.col("account")).alias("account_name"),
        (from_major(F.col("debit")) - from_major(F.col("credit"))).alias("amount_cents"), F.col("name").alias("label"),
    )


def read_journal(all_heads: DataFrame, all_lines: DataFrame, start: str, end: str, journal_id: int | None = None) -> tuple[DataFrame, DataFrame]:
    """The entries of an inclusive date range (and journal), with their lines."""
    wanted = all_heads.filter(F.col("date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
    if journal_id is not None:
        wanted = wanted.filter(F.col("journal_id") == journal_id)
    return wanted, all_lines.join(wanted.select("entry_id"), "entry_id", "left_semi")


def in_order() -> list[Column]:
    """Ids are text; numbers among them stand in the order of their values."""
    return [F.length("entry_id").alias("digits"), F.col("entry_id")]


def own_entries(all_heads: DataFrame) -> DataFrame:
    """Entries this system wrote carry its reference."""
    return all_heads.filter(F.col("ref").startswith("mov:")).orderBy("date", *in_order())


def find_by_ref(all_heads: DataFrame, refs: DataFrame) -> DataFrame:
    """The first entry for each wanted ``ref``, in any case."""
    wanted = refs.select(F.upper("ref").alias("upper_ref")).distinct()
    hits = all_heads.filter("ref is not null").withColumn("upper_ref", F.upper("ref")).join(wanted, "upper_ref", "left_semi")
    first = F.struct("date", *in_order())
    return hits.groupBy("upper_ref").agg(
        F.min_by("entry_id", first).alias("entry_id"), F.min_by("state", first).alias("state"), F.min(first)["date"].alias("date")
    )
