"""Ids derived from content, so ingesting the same document twice changes nothing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _digest(*parts: Column) -> Column:
    # concat_ws skips nulls, which would let two different rows share an id
    joined = F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.substring(F.sha2(joined, 256), 1, 16)


def movement_id(
    source_id: Column, external_id: Column, value_date: Column, cents: Column, kind: Column, locator: Column
) -> Column:
    return F.concat(F.lit("mov_"), _digest(source_id, external_id, value_date, cents, kind, locator))


def content_hash(payload: Column) -> Column:
    return F.sha2(payload, 256)


def raw_id(source_id: Column, payload_hash: Column) -> Column:
    return F.concat(F.lit("raw_"), _digest(source_id, payload_hash))


def batch_id(account_id: Column, batch_date: Column) -> Column:
    return F.concat(F.lit("bat_"), _digest(account_id, batch_date))


def match_id(batch: Column, candidate_key: Column) -> Column:
    return F.concat(F.lit("mat_"), _digest(batch, F.coalesce(candidate_key, F.lit("none"))))


def correction_ref(movement: Column, display_only: bool = False) -> Column:
    return F.concat(F.lit("ded:" if display_only else "mov:"), movement)


def run_id(started_at: Column) -> Column:
    return F.concat(F.lit("run_"), F.date_format(started_at, "yyyyMMddHHmmss"))
