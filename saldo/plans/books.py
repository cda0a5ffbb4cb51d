"""Ledger to journals, end to end: what is booked, what is not, and the entry that would fix it."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame

from saldo.config import DEDUCTIONS, Chart, RuleSet
from saldo.operators import corrections, journals
from saldo.session import materialise


class Books:
    """``journal_table``: journal_key, journal_id, journal_name, main_account, account_id.

    ``shares`` are the deductions of each charge when settlement results are at hand; they also make
    an entry's fee, tax and withholding count towards its amount.
    """

    def __init__(
        self, movements: DataFrame, heads: DataFrame, lines: DataFrame, journal_table: DataFrame, calendar: DataFrame,
        chart: Chart, rules: RuleSet | None = None, shares: DataFrame | None = None, shift_days: int = 2,
        scope: Column | None = None,
    ):
        self.movements, self.heads, self.entry_lines = movements, heads, lines
        self.journals, self.calendar, self.chart = journal_table, calendar, chart.check()
        self.rules, self.shares, self.shift_days, self.scope = rules, shares, shift_days, scope

    @cached_property
    def members(self) -> DataFrame:
        return journals.group_members(self.movements, self.journals)

    @cached_property
    def groups(self) -> DataFrame:
        return materialise(journals.groups(self.movements, self.journals), "ledger-groups")

    @cached_property
    def entries(self) -> DataFrame:
        add_back = [c for c in map(self.chart.code, DEDUCTIONS) if c] if self.shares is not None else []
        return materialise(
            journals.entries(self.heads, self.entry_lines, self.journals, add_back), "journal-entries"
        )

    @cached_property
    def matched(self) -> DataFrame:
        return journals.match(self.groups, self.entries, self.calendar, self.shift_days)

    @cached_property
    def report(self) -> DataFrame:
        return materialise(
            journals.lines(self.groups, self.entries, self.matched, self.shares, self.chart, self.rules), "erp-report"
        )

    @cached_property
    def totals(self) -> DataFrame:
        return journals.totals(self.report, self.groups, self.entries)

    @cached_property
    def proposed(self) -> DataFrame:
        return materialise(
            corrections.propose(self.report, self.chart, self.rules, self.scope), "corrections"
        )

    @cached_property
    def correction_lines(self) -> DataFrame:
        return corrections.lines(self.proposed, self.members)

    @cached_property
    def drafts(self) -> DataFrame:
        return corrections.journal_lines(self.proposed, self.correction_lines, self.chart, self.journals)
