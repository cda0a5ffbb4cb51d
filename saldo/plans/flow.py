"""Channel to bank, end to end: what was sold, which credits paid it, what is left over."""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saldo.config import RuleSet, channels_in_scope
from saldo.functions.calendar import calendar_table, days_of
from saldo.operators import assignment, batches, candidates, deductions, lineage, results
from saldo.session import materialise


class Flow:
    """The stages of one run over any number of accounts, each built when first asked for.

    ``scopes`` is (account_id, channel, bank_account_id). Stages that are read several times, or
    that the next stage loops over, are written to the shared folder. ``bank`` is read first when
    credits are needed; it may be given as a function of the run.
    """

    def __init__(
        self, movements: DataFrame, bank: DataFrame | Callable[[Flow], DataFrame], scopes: DataFrame, rules: RuleSet, holidays: list[str],
        run: str | None = None,
    ):
        self.spark = movements.sparkSession
        self.movements, self._bank, self.scopes = movements, bank, scopes
        self.rules, self.holidays, self.run = rules.check(), holidays, run

    @cached_property
    def bank(self) -> DataFrame:
        return self._bank(self) if callable(self._bank) else self._bank

    @cached_property
    def channels(self) -> DataFrame:
        return materialise(channels_in_scope(self.spark, self.rules, self.scopes), "channels")

    @cached_property
    def calendar(self) -> DataFrame:
        """Every day that the movements, their closes and their windows can need."""
        first, last = days_of(self.movements)
        table = calendar_table(self.spark, self.holidays, max(5, self.rules.horizon), first, last)
        return materialise(table.coalesce(1), "calendar")

    @cached_property
    def accrued(self) -> DataFrame:
        return batches.accrue(self.movements, self.scopes, self.channels, self.calendar)

    @cached_property
    def batches(self) -> DataFrame:
        return materialise(batches.build(self.accrued), "batches")

    @cached_property
    def members(self) -> DataFrame:
        return batches.members(self.accrued, self.batches)

    @cached_property
    def windowed(self) -> DataFrame:
        return materialise(candidates.with_windows(self.batches, self.channels, self.calendar), "windowed")

    @cached_property
    def money_in(self) -> DataFrame:
        return candidates.credits(self.bank, self.rules)

    @cached_property
    def _generated(self) -> tuple[DataFrame, DataFrame]:
        return candidates.generate(self.windowed, self.money_in, self.calendar, self.rules)

    @property
    def pairs(self) -> DataFrame:
        return self._generated[1]

    @cached_property
    def candidates(self) -> DataFrame:
        """All candidates with their provisional scores."""
        return materialise(assignment.scored(self._generated[0], self.windowed, self.rules), "candidates")

    @cached_property
    def won(self) -> DataFrame:
        return assignment.winners(self.candidates)

    @cached_property
    def settled(self) -> DataFrame:
        return assignment.settle(self.windowed, self.candidates, self.won, self.rules)

    @cached_property
    def first_pass(self) -> DataFrame:
        return materialise(
            results.match_results(self.settled, self.windowed, self.rules, self.run), "first-pass"
        )

    @cached_property
    def calibration(self) -> DataFrame:
        """What each account's channel usually charges."""
        return deductions.calibrate(self.first_pass.filter("derived_total is not null"), "account_id")

    @cached_property
    def results(self) -> DataFrame:
        return materialise(
            deductions.credit_typical(self.first_pass, self.calibration, self.rules), "results"
        )

    @cached_property
    def explained(self) -> DataFrame:
        return results.evidence(self.results, self.rules)

    @cached_property
    def alternatives(self) -> DataFrame:
        return assignment.alternatives(self.candidates, self.settled.select("batch_id", "key", "contested"))

    @cached_property
    def unattributed(self) -> DataFrame:
        return results.unattributed(self.results, self.scopes, self.bank, self.rules)

    @cached_property
    def attributed(self) -> DataFrame:
        return lineage.attribute(self.members, self.results, self.batches)

    @cached_property
    def shared_out(self) -> DataFrame:
        """The same on disk, for what reads it several times."""
        return materialise(self.attributed, "attributed")

    @cached_property
    def shares(self) -> DataFrame:
        return lineage.deduction_shares(self.members, self.results, self.movements)

    def scheduled_only(self) -> DataFrame:
        """The short answer: one credit per batch on schedule, best score first, no conflicts solved."""
        single = assignment.scored(
            candidates.single(candidates.eligible(self.windowed, self.money_in, self.calendar), self.rules),
            self.windowed,
            self.rules,
        )
        best = single.filter("gate is null").groupBy("batch_id").agg(
            F.min(F.struct((-F.col("score")).alias("s"), "key")).alias("best")
        )
        return self.windowed.join(best, "batch_id", "left").select(
            "account_id", "channel", "batch_id", "batch_date", "gross_cents", "expected_net_cents",
            F.col("best.key").alias("deposit_id"), (-F.col("best.s")).alias("score"),
        )
