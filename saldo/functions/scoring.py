"""Confidence as a sum of named checks.

A candidate carries one code per question (amount, date, descriptor, identity, shape). A code says
by itself whether its check passed, so scoring stays a handful of plain columns.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from saldo.config import RuleSet

# The codes that state a failed check on the channel-to-bank side.
FAILED = (
    "AMOUNT_MISMATCH",
    "DATE_OUT_OF_WINDOW",
    "DESCRIPTOR_FOREIGN",
    "IDENTITY_BROKEN",
    "SETTLEMENT_SPLIT",
    "SETTLEMENT_MERGED",
    "SUBSET_SUM_MULTIPLE",
    "UNRESOLVED_COMBINATORIAL",
    "COMPETING_CANDIDATE",
)

#: The order in which a candidate's checks are listed, and hence searched for the first failure.
CHECKS = ("amount_code", "date_code", "descriptor_code", "identity_code", "shape_code", "multiple_code")


def weight(code: Column, rules: RuleSet) -> Column:
    table = F.create_map(*[F.lit(x) for pair in rules.weights.items() for x in pair])
    return F.when(code.isin(*FAILED), 0).otherwise(F.coalesce(table[code], F.lit(0)))


def _points(code: Column, rules: RuleSet, counted: Callable[[str], bool]) -> Column:
    """The weight of a passed check that is counted, else 0: one comparison for each weight, no table to look through."""
    names: dict[int, list[str]] = {}
    for name, points in rules.weights.items():
        if name not in FAILED and counted(name):
            names.setdefault(points, []).append(name)
    found = F
    for points, theirs in names.items():
        found = found.when(code.isin(*theirs), points)
    return F.lit(0) if found is F else found.otherwise(0)


def earned(codes: list[Column], rules: RuleSet) -> Column:
    """Sum of the passed weights, counting the best one per exclusive dimension."""
    grouped = [code for members in rules.exclusive.values() for code in members]
    total = F.lit(0)
    for code in codes:
        total = total + _points(code, rules, lambda name: name not in grouped)
    for members in rules.exclusive.values():
        options = [_points(code, rules, lambda name, members=members: name in members) for code in codes]
        total = total + (F.greatest(*options) if len(options) > 1 else options[0])
    return total


def attainable(identity_applies: Column, rules: RuleSet) -> Column:
    """A check that could not be run leaves the denominator too."""
    return F.lit(rules.attainable) - F.when(
        identity_applies, F.lit(0)
    ).otherwise(F.lit(rules.weights.get("IDENTITY_HOLDS", 0)))


def score(points: Column, out_of: Column) -> Column:
    """Points as a whole percentage, halves up, in integer arithmetic."""
    return (
        F.when(out_of > 0, F.floor((points * 200 + out_of) / (out_of * 2)).cast("int"))
        .otherwise(0)
        .cast("int")
    )


def first_gate(codes: list[Column], rules: RuleSet) -> Column:
    """The first failed check that rules a candidate out altogether."""
    gates = [g for g in rules.disqualifying if g in FAILED]
    if not gates:
        return F.lit(None).cast("string")
    return F.coalesce(*[F.when(code.isin(*gates), code) for code in codes])


def first_failed(codes: list[Column]) -> Column:
    return F.coalesce(*[F.when(code.isin(*FAILED), code) for code in codes])


def band(value: Column, contested: Column, gate: Column, rules: RuleSet) -> Column:
    return (
        F.when(gate.isNotNull() | (value < rules.ambiguous), "UNMATCHED")
        .when(contested, "AMBIGUOUS")
        .when(value >= rules.confirmed, "CONFIRMED")
        .when(value >= rules.probable, "PROBABLE")
        .otherwise("AMBIGUOUS")
    )


def check(
    code: Column,
    dimension: str,
    rules: RuleSet | None = None,
    expected: Column | None = None,
    observed: Column | None = None,
    detail: Column | None = None,
    applicable: Column | None = None,
    passed: Column | None = None,
) -> Column:
    """One piece of evidence; null when ``code`` is null, stamped with the weight it added."""
    text = F.lit(None).cast("string")
    body = F.struct(
        code.alias("code"),
        F.lit(dimension).alias("dimension"),
        (passed if passed is not None else ~code.isin(*FAILED)).alias("passed"),
        (applicable if applicable is not None else F.lit(True)).alias("applicable"),
        (weight(code, rules) if rules else F.lit(0)).cast("int").alias("weight"),
        (expected if expected is not None else text).alias("expected"),
        (observed if observed is not None else text).alias("observed"),
        (detail if detail is not None else text).alias("detail"),
    )
    return F.when(code.isNotNull(), body)
