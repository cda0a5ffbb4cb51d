"""Input that must not disappear silently: late pages, unknown channels, far days, odd statements."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F
from test_sources import HEADER, entry, page, runs

from saldo.config import Channel, RuleSet, channels_in_scope
from saldo.functions import calendar as cal
from saldo.operators import batches, journals
from saldo.sources import gateway, inbox, journal, statement, store
from saldo.streaming import landing


def test_a_first_arrival_counts_however_old(spark, tmp_path):
    pages, out, mark = tmp_path / "in", tmp_path / "out", tmp_path / "mark"
    pages.mkdir()

    def run():
        charges = landing.new_charges(spark, str(pages), "gateway", "gw", "GATEWAY")
        landing.ingest_available(charges, str(out), "late", str(mark)).awaitTermination()
        return sorted(r.external_id for r in spark.read.parquet(str(out)).collect())

    (pages / "1.json").write_text(page(1, (1, "APPROVED")).replace("2026-04", "2026-06"))
    assert run() == ["r1"]
    (pages / "2.json").write_text(page(2, (2, "APPROVED"), (1, "APPROVED")).replace("2026-04", "2025-12"))
    (pages / "3.json").write_text(page(3, (2, "APPROVED")).replace("2026-04", "2025-12"))
    (pages / "4.json").write_text(page(4, (3, "APPROVED")).replace("2026-04", "2026-01"))
    # ids come from content: r1 of December is another charge than r1 of June, r2 came twice
    assert run() == ["r1", "r1", "r2", "r3"]
    ids = [r.id for r in spark.read.parquet(str(out)).collect()]
    assert len(ids) == len(set(ids))


def test_transactions_without_a_status_are_reported(spark):
    body = page(1, (1, "APPROVED"), (2, None), (3, "DECLINED"))
    raw = gateway.as_raw(spark.createDataFrame([(body, "p")], "payload string, origin string"), "gateway")
    rows = gateway.transactions(gateway.decoded(raw))
    assert {(r.status, r.transactions) for r in gateway.excluded(rows).collect()} == {(None, 1), ("DECLINED", 1)}


def test_blanks_before_a_page_do_not_hide_it(spark):
    cases = {
        ' {"data": []}': "gateway-transactions",
        "\n\t" * 500 + " ﻿" + '{"data": 1}': "gateway-transactions",
        "%PDF-1.7": "bank-statement",
        " %PDF": None,
        '{"date"': None,
        "": None,
    }
    frame = spark.createDataFrame([(c,) for c in cases], "t string")
    got = frame.select("t", inbox.route(F.encode("t", "UTF-8")).alias("r")).collect()
    assert {r.t: r.r for r in got} == cases


def charges(spark, rows):
    frame = spark.createDataFrame(rows, "id string, account_id string, d string, amount_cents bigint")
    return frame.select("*", F.to_date("d").alias("value_date"), F.to_timestamp("d").alias("occurred_at"), F.lit("CHARGE").alias("type"))


def test_an_unconfigured_channel_settles_by_the_default(spark):
    rules = RuleSet(channels=(Channel("known", ("KNOWN",)),))
    scopes = spark.createDataFrame([("a", "known", "bank"), ("b", "new", "bank"), ("c", "new", "bank")], "account_id string, channel string, bank_account_id string")
    channels = channels_in_scope(spark, rules, scopes)
    table = {r.channel: r for r in channels.collect()}
    assert set(table) == {"known", "new"} and table["new"].cadence == "DAILY" and not table["new"].own_policy
    assert table["new"].window_to == rules.window_to and table["new"].patterns == []
    moves = charges(spark, [("1", "a", "2026-01-05", 10), ("2", "b", "2026-01-05", 20), ("3", "c", "2026-01-05", 30)])
    built = batches.build(batches.accrue(moves, scopes, channels, cal.calendar_table(spark, [], 5)))
    assert {(r.account_id, r.gross_cents) for r in built.collect()} == {("a", 10), ("b", 20), ("c", 30)}


def test_days_outside_the_usual_span(spark):
    rules = RuleSet(channels=(Channel("known", ("KNOWN",)),))
    scopes = spark.createDataFrame([("a", "known", "bank")], "account_id string, channel string, bank_account_id string")
    channels = channels_in_scope(spark, rules, scopes)
    moves = charges(spark, [("1", "a", "1985-01-04", 10), ("2", "a", "2045-01-06", 20)])
    with pytest.raises(Exception, match="calendar does not reach"):
        batches.accrue(moves, scopes, channels, cal.calendar_table(spark, [], 5)).collect()
    wide = cal.calendar_table(spark, [], 5, *cal.days_of(moves))
    built = {(str(r.due_date), r.gross_cents) for r in batches.build(batches.accrue(moves, scopes, channels, wide)).collect()}
    assert built == {("1985-01-07", 10), ("2045-01-09", 20)}
    assert cal.days_of(moves.limit(0)) == (cal.FIRST_DAY, cal.LAST_DAY)


def test_an_entry_many_days_late_is_found(spark):
    pending = spark.createDataFrame([("j", "g", "2026-01-05", 500)], "journal_key string, group_key string, d string, ledger_cents bigint")
    free = spark.createDataFrame([("j", "e", "2026-01-14", 500, None)], "journal_key string, entry_id string, d string, entry_cents bigint, reference string")
    pending, free = (x.withColumn("date", F.to_date("d")) for x in (pending, free))
    calendar = cal.calendar_table(spark, [], 5)
    found = journals.by_shift(pending, free, calendar, shift_days=10).collect()
    assert [(r.group_key, r.entry_id) for r in found] == [("g", "e")]
    assert journals.by_shift(pending, free, calendar, shift_days=6).count() == 0


def test_many_distinct_amounts_of_one_day(spark):
    """The sweep over one day's amounts is linear: a frame read anew for each row would take minutes here."""
    n = 20_000
    days = spark.range(n).select(F.lit("j").alias("journal_key"), F.to_date(F.lit("2026-01-05")).alias("date"), "id")
    pending = days.select("journal_key", "date", F.concat(F.lit("g"), "id").alias("group_key"), (10_000_000 + F.col("id") * 2).alias("ledger_cents"))
    free = days.select("journal_key", "date", F.concat(F.lit("e"), "id").alias("entry_id"), (10_000_001 + F.col("id") * 2).alias("entry_cents"), F.lit(None).cast("string").alias("reference"))
    classes = pending.select("journal_key", "date", F.col("ledger_cents").alias("cents"), F.lit("g").alias("side"), F.col("group_key").alias("head")).unionByName(
        free.select("journal_key", "date", F.col("entry_cents").alias("cents"), F.lit("e").alias("side"), F.col("entry_id").alias("head"))
    )
    classes = classes.withColumn("size", F.lit(1).cast("bigint")).withColumn("used", F.lit(0).cast("bigint"))
    pairs = journals._preferring_each_other(classes, ["journal_key", "date"])
    assert pairs.count() >= 1


def read(spark, rows):
    table = spark.createDataFrame(rows, "raw_id string, page int, seq int, x double, y double, text string")
    found = statement.rows(table)
    heads = statement.headers(found)
    entries = statement.entries(found, heads)
    return found, heads, entries, statement.verdicts(found, heads, statement.chain(entries, heads))


def test_one_impossible_date_rejects_its_document_only(spark):
    def dated(day):
        return HEADER + entry(700, day, "PAGO DE PROV ACME", "50.00", "150.00") + entry(680, "2/01", "CUOTA", "-20.00", "130.00")

    late = [("DESDE: 2026/02/01 HASTA: 2026/02/28" if t.startswith("DESDE") else t) for *_, t in HEADER]
    february = [(y, x, t) for (y, x, _), t in zip(HEADER, late, strict=True)]
    february += entry(700, "31/02", "PAGO DE PROV ACME", "50.00", "150.00") + entry(680, "2/02", "CUOTA", "-20.00", "130.00")
    bad_period = [(y, x, t.replace("2025/12/01", "2025/13/41")) for y, x, t in dated("30/12")]
    docs = {"good": dated("30/12"), "zero": dated("0/12"), "past": dated("30/13"), "february": february, "period": bad_period}
    _, _, entries, verdicts = read(spark, [r for d, rows in docs.items() for r in runs(d, rows)])
    got = {r.raw_id: (r.accepted, r.rejected_because) for r in verdicts.collect()}
    assert got == {
        "good": (True, None), "zero": (False, "IMPOSSIBLE_DATE"), "past": (True, None), "february": (True, None), "period": (False, "NO_PERIOD"),
    }
    days = {(r.raw_id, str(r.value_date)) for r in entries.filter("amount_cents > 0 and raw_id in ('past', 'february')").collect()}
    assert days == {("past", "2025-12-30"), ("february", "2026-02-28")}


def test_rows_keep_to_the_first_height_met(spark):
    found, *_ = read(spark, runs("d", [(700, 10, "a"), (698, 20, "b"), (696, 30, "c"), (701, 40, "d"), (697, 50, "e")]))
    got = {(r.row, r.y, r.line) for r in found.collect()}
    assert got == {(0, 700, "a b d"), (1, 696, "c e")}


def test_an_account_number_below_its_label(spark):
    rows = [(800, 40, "DESDE: 2025/12/01 HASTA: 2026/01/31"), (790, 40, "NÚMERO"), (780, 40, "123")]
    _, heads, *_ = read(spark, runs("below", rows) + runs("pages", rows[:2]) + runs("pages", [(800, 40, "77 x")], page=2, seq=9) + runs("none", rows[:2]))
    assert {r.raw_id: r.account_number for r in heads.collect()} == {"below": "123", "pages": "77", "none": ""}


def test_the_last_of_a_load_wins_whole(spark):
    schema = "id string, amount_cents bigint, metadata map<string, string>, run_id string"
    old = spark.createDataFrame([("a", 1, {"k": "old"}, "run_1")], schema)
    load = [("a", 5, {"k": "x"}, "run_2"), ("a", 4, None, "run_2"), ("b", 9, {"k": "1"}, "run_2"), ("b", 2, {"k": "2"}, "run_2")]
    merged, _ = store.upsert_movements(old, spark.createDataFrame(load, schema).coalesce(1))
    assert {r.id: (r.amount_cents, r.metadata, r.run_id) for r in merged.collect()} == {"a": (4, None, "run_1"), "b": (2, {"k": "2"}, "run_2")}


def test_exported_journals_match(spark):
    moves = spark.createDataFrame([(9, 1, "n", "", "2026-01-05", "posted"), (10, 1, "n", "r", "2026-01-05", "posted"), (2, 1, "n", "R", "2026-01-06", "x")], "id bigint, journal_id int, name string, ref string, date string, state string")
    heads = journal.heads(moves)
    entries = heads.select(F.lit("j").alias("journal_key"), "entry_id", "date", F.lit(500).cast("bigint").alias("entry_cents"), F.col("ref").alias("reference"))
    pending = spark.createDataFrame([("j", "g", "2026-01-05", 500)], "journal_key string, group_key string, d string, ledger_cents bigint").withColumn("date", F.to_date("d")).drop("d")
    found = journals.match(pending, entries, cal.calendar_table(spark, [], 5)).collect()
    assert len(found) == 1 and found[0].entry_id in ("9", "10")
    assert [r.entry_id for r in journal.find_by_ref(heads, spark.createDataFrame([("r",)], "ref string")).collect()] == ["10"]
