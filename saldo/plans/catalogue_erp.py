"""Registered queries: ledger against journals, corrections, drafts and guards.

Plain names run with settlement results at hand; ``_plain`` without; ``_orders`` over sales of
several movements; ``_bank`` over the transfers of the bank's own journals.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saldo.config import account_table, journal_table
from saldo.operators import corrections, journals, results
from saldo.plans.books import Books
from saldo.plans.catalogue_flow import number, text
from saldo.plans.catalogue_ingest import _own
from saldo.plans.fixtures import BANK_CHART, CHART, RULES, Workspace


def _groups(b: Books) -> DataFrame:
    return b.groups.select(
        "journal_key", "group_key", "date", "ledger_cents", F.array_join("concepts", ",").alias("concepts"), "n_movements", text("charge_id")
    )


def erp_groups(w: Workspace) -> DataFrame:
    return _groups(w.order_books)


def erp_groups_plain(w: Workspace) -> DataFrame:
    return _groups(w.plain_books)


def erp_group_amount(w: Workspace) -> DataFrame:
    return w.order_books.groups.groupBy("journal_key").agg(F.sum("ledger_cents").alias("ledger_cents"), F.count(F.lit(1)).alias("groups"))


def erp_reference(w: Workspace) -> DataFrame:
    both = w.order_books.entries.unionByName(w.plain_books.entries)
    return both.select("entry_id", text("reference"))


def erp_amount(w: Workspace) -> DataFrame:
    """The amount of an entry with and without its deductions counted in."""
    added = journals.entries(w.order_heads, w.order_lines, w.journal_table, ["810200", "820300", "830400"])
    return w.order_books.entries.select("entry_id", F.col("entry_cents").alias("main_cents")).join(
        added.select("entry_id", "entry_cents", "balanced"), "entry_id"
    )


def erp_balanced(w: Workspace) -> DataFrame:
    return w.bank_books.entries.select("entry_id", "balanced").unionByName(w.plain_books.entries.select("entry_id", "balanced"))


def erp_duplicates(w: Workspace) -> DataFrame:
    return journals.duplicates(w.plain_books.groups, w.plain_books.entries).select("journal_key", "group_key", "entries")


def _pass(b: Books, n: int) -> DataFrame:
    return b.matched.filter(F.col("pass") == n).select("journal_key", "group_key", "entry_id", "level")


def erp_p1_ref(w: Workspace) -> DataFrame:
    return _pass(w.plain_books, 1)


def erp_p2_exact(w: Workspace) -> DataFrame:
    return _pass(w.plain_books, 2)


def erp_p2_exact_bank(w: Workspace) -> DataFrame:
    return _pass(w.bank_books, 2)


def erp_p3_aggregate(w: Workspace) -> DataFrame:
    return _pass(w.order_books, 3)


def erp_p4_nearest(w: Workspace) -> DataFrame:
    return _pass(w.plain_books, 4)


def erp_p5_shift(w: Workspace) -> DataFrame:
    return _pass(w.plain_books, 5)


def _lines(b: Books) -> DataFrame:
    return b.report.select(
        "journal_key", text("group_key"), "status", "level", text("entry_id"), "date", number("ledger_cents"), number("entry_cents"),
        number("delta_cents"), F.array_join("missing", ",").alias("missing"), F.array_join("codes", ",").alias("codes"),
    )


def erp_assess(w: Workspace) -> DataFrame:
    return _lines(w.books)


def erp_assess_plain(w: Workspace) -> DataFrame:
    return _lines(w.plain_books)


def erp_assess_orders(w: Workspace) -> DataFrame:
    return _lines(w.order_books)


def erp_assess_bank(w: Workspace) -> DataFrame:
    return _lines(w.bank_books)


def erp_missing_concepts(w: Workspace) -> DataFrame:
    rows = w.books.report.filter("status = 'INCOMPLETE_ENTRY'")
    return rows.select("journal_key", "group_key", F.explode("missing").alias("concept"))


def erp_missing_in_erp(w: Workspace) -> DataFrame:
    rows = w.books.report.filter("status = 'MISSING_IN_ERP'")
    return rows.select("journal_key", "group_key", "ledger_cents", F.array_join("codes", ",").alias("codes"))


def erp_orphans(w: Workspace) -> DataFrame:
    return journals.orphans(w.plain_books.entries, w.plain_books.matched).select("journal_key", "entry_id", "entry_cents")


def erp_scope(w: Workspace) -> DataFrame:
    return w.bank_books.groups.select("journal_key", "group_key", journals.in_scope(RULES).alias("in_scope"))


def erp_counterpart(w: Workspace) -> DataFrame:
    found = F.coalesce(journals.counterpart(RULES, BANK_CHART), F.lit(""))
    return w.bank_books.groups.select("journal_key", "group_key", found.alias("counterpart"))


def _corrections(b: Books) -> DataFrame:
    return b.proposed.select(
        "journal_key", "group_key", "ref", "date", "reason", F.array_join("missing_concepts", ",").alias("missing_concepts"),
        "display_only", "net_cents", text("counterpart"),
    )


def erp_correction(w: Workspace) -> DataFrame:
    return _corrections(w.books)


def erp_correction_orders(w: Workspace) -> DataFrame:
    return _corrections(w.order_books)


def erp_correction_bank(w: Workspace) -> DataFrame:
    return _corrections(w.bank_books)


def erp_correction_ded(w: Workspace) -> DataFrame:
    shared = w.books.correction_lines.filter("movement_id is null")
    return shared.select("journal_key", "ref", "concept", "amount_cents", "label")


def erp_concept_amount(w: Workspace) -> DataFrame:
    return corrections.concept_amounts(w.books.correction_lines)


def _drafts(b: Books) -> DataFrame:
    return b.drafts.select("journal_key", "journal_id", "ref", "line", "account_code", "debit_cents", "credit_cents", "label")


def erp_journal_lines(w: Workspace) -> DataFrame:
    return _drafts(w.books)


def erp_journal_lines_bank(w: Workspace) -> DataFrame:
    return _drafts(w.bank_books)


def erp_entry_valid(w: Workspace) -> DataFrame:
    every = w.books.drafts.unionByName(w.order_books.drafts).unionByName(w.bank_books.drafts)
    return corrections.balance(every).groupBy("journal_key", "valid").agg(F.count(F.lit(1)).alias("drafts"))


def erp_proposed(w: Workspace) -> DataFrame:
    return corrections.proposed_entries(w.books.proposed, w.books.drafts, CHART).groupBy("journal_key", "ref", "writable").agg(
        F.count(F.lit(1)).alias("lines"), F.sum("debit_cents").alias("debit_cents")
    )


def erp_write_guard(w: Workspace) -> DataFrame:
    return corrections.write_guard(w.books.proposed, w.books.drafts, CHART, True).select("journal_key", "ref", "accepted", text("refused_because"))


def erp_write_guard_off(w: Workspace) -> DataFrame:
    return corrections.write_guard(w.bank_books.proposed, w.bank_books.drafts, BANK_CHART, False).select("journal_key", "ref", "accepted", text("refused_because"))


def erp_delete_guard(w: Workspace) -> DataFrame:
    return corrections.delete_guard(_own(w), [48, 49, 50, 51, 52], True).select("entry_id", "deletable", text("refused_because"))


def erp_idempotent(w: Workspace) -> DataFrame:
    return corrections.not_yet_written(w.books.proposed, _own(w)).select("journal_key", "ref")


def erp_chart(w: Workspace) -> DataFrame:
    """Movements next to the account their type books to, and the journal of their account."""
    used = w.order_movements.unionByName(w.movements).groupBy("account_id", F.col("type").alias("concept")).agg(F.count(F.lit(1)).alias("movements"))
    journal = journal_table(w.spark, CHART).select(F.col("journal_key").alias("account_id"), "journal_id", "main_account")
    rows = used.join(account_table(w.spark, CHART), "concept", "left").join(journal, "account_id")
    return rows.select("account_id", "concept", "movements", text("account_code"), F.col("account_code").isNotNull().alias("mapped"), "journal_id", "main_account")


def erp_totals(w: Workspace) -> DataFrame:
    return w.books.totals


def erp_totals_plain(w: Workspace) -> DataFrame:
    return w.plain_books.totals


def erp_view(w: Workspace) -> DataFrame:
    rows = journals.view(w.books.report, "problems", None, "2024-01-05", "2024-01-25").select(
        "date", text("entry_name"), "status", text("group_key"), "journal_key"
    )
    return results.page(rows, [F.col("date"), F.col("entry_name"), F.col("group_key"), F.col("status")], 40, 40)


def erp_counterparties(w: Workspace) -> DataFrame:
    return journals.counterparties(w.books.report)


def erp_written(w: Workspace) -> DataFrame:
    done = corrections.written(w.books.proposed.filter("not display_only"), _own(w))
    return done.select("journal_key", "ref", text("written_id"), text("written_state"))


def erp_summary(w: Workspace) -> DataFrame:
    return corrections.erp_summary(w.books.report, w.books.proposed, corrections.concept_amounts(w.books.correction_lines))


QUERIES = {
    f.__name__: f
    for f in (
        erp_groups, erp_groups_plain, erp_group_amount, erp_reference, erp_amount, erp_balanced, erp_duplicates, erp_p1_ref, erp_p2_exact,
        erp_p2_exact_bank, erp_p3_aggregate, erp_p4_nearest, erp_p5_shift, erp_assess, erp_assess_plain, erp_assess_orders,
        erp_assess_bank, erp_missing_concepts, erp_missing_in_erp, erp_orphans, erp_scope, erp_counterpart, erp_correction,
        erp_correction_orders, erp_correction_bank, erp_correction_ded, erp_concept_amount, erp_journal_lines, erp_journal_lines_bank,
        erp_entry_valid, erp_proposed, erp_write_guard, erp_write_guard_off, erp_delete_guard, erp_idempotent, erp_chart, erp_totals,
        erp_totals_plain, erp_view, erp_counterparties, erp_written, erp_summary,
    )
}
