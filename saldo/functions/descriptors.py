"""Bank statement descriptors: ordered rules, the first that fits names type and counterparty."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from saldo.config import Descriptor


def classify(
    description: Column, rules: Sequence[Descriptor], fallback: str = "OTHER"
) -> Column:
    """``struct(type, counterparty, rule, recognised)``."""
    trimmed = F.trim(description)
    text = F.upper(trimmed)
    result = F.struct(
        F.lit(fallback).alias("type"),
        F.lit(None).cast("string").alias("counterparty"),
        F.lit("fallback").alias("rule"),
        F.lit(False).alias("recognised"),
    )
    for rule in reversed(rules):
        if rule.starts_with:
            fits = text.startswith(rule.starts_with.upper())
        elif rule.contains:
            fits = F.contains(text, F.lit(rule.contains.upper()))
        else:
            continue
        if rule.counterparty:
            party = F.lit(rule.counterparty)
        elif rule.after_prefix:
            # a one-word description can be shorter than the prefix once trimmed
            rest = F.trim(trimmed.substr(F.lit(len(rule.after_prefix) + 1), F.length(trimmed)))
            party = F.when(rest != "", rest)
        else:
            party = F.lit(None).cast("string")
        hit = F.struct(
            F.lit(rule.type).alias("type"),
            party.alias("counterparty"),
            F.lit(rule.id).alias("rule"),
            F.lit(True).alias("recognised"),
        )
        result = F.when(fits, hit).otherwise(result)
    return result
