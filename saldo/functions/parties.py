"""Whose money a bank line is: counterparty patterns of the configured channels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from saldo.config import RuleSet


def owners(counterparty: Column, rules: RuleSet) -> Column:
    """Channels whose pattern occurs in the counterparty, in configuration order."""
    text = F.upper(counterparty)
    hits = []
    for channel in rules.channels:
        named = F.lit(False)
        for pattern in channel.patterns:
            named = named | F.contains(text, F.lit(pattern.upper()))
        hits.append(F.when(counterparty.isNotNull() & named, F.lit(channel.key)))
    return F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>")


def owner(counterparty: Column, rules: RuleSet) -> Column:
    """The first channel, in configuration order, that the counterparty names."""
    return F.get(owners(counterparty, rules), F.lit(0))


def is_channels(owner_list: Column, channel: Column) -> Column:
    return F.array_contains(owner_list, channel)


def is_foreign(owner_list: Column, channel: Column) -> Column:
    """Recognisably another channel's money, and not this one's."""
    return (F.size(owner_list) > 0) & ~F.array_contains(owner_list, channel)
