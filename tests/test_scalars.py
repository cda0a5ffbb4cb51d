from __future__ import annotations

from datetime import date

import pytest
from pyspark.sql import functions as F

from saldo.config import Channel, ConfigurationError, Policy, RuleSet, channel_table
from saldo.functions import calendar as cal
from saldo.functions import ids, money, parties

HOLIDAYS = ["2027-05-17", "2027-05-18", "2027-06-30"]


def values(spark, rows, schema, *columns):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*columns).collect()]


def test_scale_rounds_the_magnitude(spark):
    rows = [(7, 1, 2), (-7, 1, 2), (5, 1, 2), (-5, 1, 2), (31754900, 15, 1000), (3, -1, 2)]
    got = values(
        spark, rows, "v bigint, n int, d int",
        *[money.scale(F.col("v"), F.col("n"), F.col("d"), r) for r in ("TRUNCATE", "HALF_UP", "HALF_EVEN")],
    )
    assert got == [(3, 4, 4), (-3, -4, -4), (2, 3, 2), (-2, -3, -2), (476323, 476324, 476324), (-1, -2, -2)]


def test_scale_by_zero_fails(spark):
    with pytest.raises(Exception, match="ZERO"):
        values(spark, [(7, 1, 0)], "v bigint, n int, d int", money.scale(F.col("v"), F.col("n"), F.col("d")))


def test_amount_text(spark):
    cases = {
        "1,234.56": 123456, "-1,234.56": -123456, "1,234.56-": -123456, "(1,234.56)": -123456, "(-5.00)": 500, "−10": -1000,
        "+ 3.5": 350, "$ 1,000": 100000, "-$2.00": -200, " 7 ": 700, "90071992547409.91": 9007199254740991, "0.5": 50, ".50": None,
        "": None, "1.2.3": None, "12x": None, "1.234": None, "90071992547409.92": None, "(5": None, "--5": None, "5.": 500,
    }
    parsed = money.parse_amount(F.col("t"))
    got = dict(values(spark, [(t,) for t in cases], "t string", "t", parsed["cents"]))
    assert got == cases
    errors = dict(values(spark, [(t,) for t in cases], "t string", "t", parsed["error"]))
    assert (errors[""], errors["1.2.3"], errors["12x"], errors["1.234"], errors["90071992547409.92"]) == (
        "EMPTY", "MANY_DECIMAL_MARKS", "NON_NUMERIC", "MANY_DECIMALS", "TOO_LARGE",
    )
    spanish = money.parse_amount(F.col("t"), money.SPANISH_FORMAT)["cents"]
    assert values(spark, [("1.234,56",)], "t string", spanish) == [(123456,)]


def test_money_text(spark):
    rows = [(123456789,), (-5,), (0,), (100,), (-123456,)]
    assert [r[0] for r in values(spark, rows, "c bigint", money.format_money(F.col("c")))] == [
        "$1.234.567,89", "-$0,05", "$0,00", "$1,00", "-$1.234,56",
    ]
    text = values(spark, [("a COP 123456 b COP -5, COP x",)], "t string", money.humanise(F.col("t")))
    assert text == [("a $1.234,56 b -$0,05, COP x",)]


def test_ids_do_not_confuse_missing_parts(spark):
    row = [("s", None, "2026-01-01", 5, "CHARGE", "x"), ("s", "", "2026-01-01", 5, "CHARGE", "x"), ("s", "x", "2026-01-01", 5, "CHARGE", None)]
    columns = ("a", "b", "c", "d", "e", "f")
    got = values(spark, row, "a string, b string, c string, d bigint, e string, f string", ids.movement_id(*[F.col(c) for c in columns]))
    assert got[0] == got[1] != got[2]
    import hashlib

    assert got[0][0] == "mov_" + hashlib.sha256(b"s||2026-01-01|5|CHARGE|x").hexdigest()[:16]


def test_business_days(spark):
    calendar = cal.calendar_table(spark, HOLIDAYS, 5)
    days = spark.createDataFrame([("2027-05-14", 1), ("2027-05-14", 3), ("2027-06-29", 1), ("2027-05-19", 4)], "t string, n int")
    days = days.withColumn("d", F.to_date("t"))
    got = {(r.t, r.n): str(r.out) for r in cal.with_business_day_after(days, calendar, "d", F.col("n"), "out").collect()}
    assert got == {
        ("2027-05-14", 1): "2027-05-19", ("2027-05-14", 3): "2027-05-21", ("2027-06-29", 1): "2027-07-01", ("2027-05-19", 4): "2027-05-25",
    }
    with pytest.raises(Exception, match="starts at 1"):
        cal.with_business_day_after(days, calendar, "d", F.col("n") - 1, "out").collect()


def test_period_closes(spark):
    rows = [
        ("DAILY", None, None, "2026-01-30", "2026-01-30"), ("WEEKLY", 7, None, "2026-01-05", "2026-01-11"), ("WEEKLY", 1, None, "2026-01-05", "2026-01-05"),
        ("WEEKLY", 1, None, "2026-01-06", "2026-01-12"), ("MONTHLY", None, 31, "2026-02-10", "2026-02-28"), ("MONTHLY", None, 15, "2026-01-16", "2026-02-15"),
        ("MONTHLY", None, 30, "2026-01-31", "2026-02-28"), ("MONTHLY", None, 31, "2026-01-31", "2026-01-31"),
    ]
    close = cal.close_date(F.to_date("d"), F.col("c"), F.col("w"), F.col("m")).cast("string")
    got = values(spark, rows, "c string, w int, m int, d string, want string", close, "want")
    assert all(a == b for a, b in got), got


def test_cutoff_moves_to_the_next_local_day(spark):
    rows = [("2026-04-25 01:59:59",), ("2026-04-25 02:00:00",)]
    at = F.col("t").cast("timestamp")
    day = cal.accrual_date(at, F.to_date(F.lit("2026-04-24")), F.lit(21 * 60), F.lit("America/Bogota")).cast("string")
    assert values(spark, rows, "t string", day) == [("2026-04-24",), ("2026-04-25",)]
    none = cal.accrual_date(at, F.to_date(F.lit("2026-04-24")), F.lit(None).cast("int"), F.lit(None).cast("string"))
    assert values(spark, rows[1:], "t string", none.cast("string")) == [("2026-04-24",)]


def test_parties(spark):
    rules = RuleSet(channels=(Channel("acme", ("ACME",)), Channel("nova", ("NOVA", "NO-V"))))
    rows = [("Acme S.A.S.",), ("pago NOVA",), (None,), ("nobody",), ("ACME NOVA",)]
    owned = parties.owners(F.col("c"), rules)
    got = values(spark, rows, "c string", owned, parties.owner(F.col("c"), rules), parties.is_foreign(owned, F.lit("acme")))
    assert got == [(["acme"], "acme", False), (["nova"], "nova", True), ([], None, False), ([], None, False), (["acme", "nova"], "acme", False)]


def test_configuration_is_checked(spark):
    assert RuleSet().check().attainable == 135
    for bad in (
        RuleSet(version=""), RuleSet(window_from=2, window_to=1), RuleSet(window_from=0), RuleSet(fee_band=(0.5, 0.1)), RuleSet(weights={}),
        RuleSet(channels=(Channel("w", (), Policy("WEEKLY")),)), RuleSet(channels=(Channel("m", (), Policy("MONTHLY")),)),
        RuleSet(channels=(Channel("c", (), Policy(cutoff="9pm")),)),
    ):
        with pytest.raises(ConfigurationError):
            bad.check()
    table = channel_table(spark, RuleSet(channels=(Channel("a", ("A",)),))).collect()[0]
    assert (table.cadence, table.window_to, table.band_lo, table.own_band) == ("DAILY", 3, 0.02, False)


def test_ruleset_from_json(spark):
    import json

    text = json.dumps(
        {
            "version": "v1", "settlementWindow": {"fromBusinessDays": 1, "toBusinessDays": 3},
            "tolerances": {"roundingCents": 7500, "identityCents": 1, "impliedFeeRateBand": [0.03, 0.07]}, "weights": {"AMOUNT_EXACT": 50},
            "exclusiveDimensions": {"AMOUNT": ["AMOUNT_EXACT"]}, "bands": {"CONFIRMED": 85, "PROBABLE": 60, "AMBIGUOUS": 40}, "ambiguityDelta": 10,
            "subsetSum": {"maxSubsetSize": 60, "maxSolutions": 5, "toleranceCents": 100, "maxNodes": 200000},
            "channels": {"acme": {"counterpartyPatterns": ["ACME"], "settlement": {"cadence": "DAILY", "cutoff": {"time": "20:30", "timeZone": "America/Bogota"},
                "window": {"fromBusinessDays": 1, "toBusinessDays": 2}}}},
        }
    )
    rules = RuleSet.from_json(text)
    assert rules.policy_for("acme").cutoff_minutes == 1230 and rules.policy_for("acme").window_to == 2
    assert rules.horizon == 3 and rules.band_for("acme") == (0.03, 0.07)
    assert date.fromisoformat("2026-01-01")
