"""What travels between tasks: joint payments and pairs, against every combination and in rows of bounded number."""

from __future__ import annotations

import random
import re
from datetime import date, timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saldo.config import Channel, RuleSet
from saldo.functions import scoring
from saldo.functions.calendar import calendar_table
from saldo.functions.money import parse_amount
from saldo.operators import assignment, candidates, lineage
from saldo.plans.fixtures import Workspace
from saldo.session import shared_dir
from saldo.sources import statement, versions

RULES = RuleSet(channels=(Channel("acme", ("ACME",)), Channel("nova", ("NOVA",))))
BATCH = (
    "account_id string, batch_id string, batch_date date, bank_account_id string, channel string, gross_cents bigint, window_start date, "
    "window_end date, band_lo double, band_hi double, deduction_kinds int, batch_ord int, window_from int, window_to int, "
    "expected_net_cents bigint, deductions_cents bigint, fee_cents bigint"
)
CREDIT = "bank_account_id string, deposit_id string, value_date date, cents bigint, counterparty string, description string, owners array<string>"
START = date(2024, 3, 1)


@pytest.fixture(scope="module")
def tables(spark):
    rng = random.Random(5)
    batches, credits = [], []
    for account in ("a", "b", "c"):
        for n in sorted(rng.sample(range(60), 35)):
            day, gross = START + timedelta(days=n), rng.choice([0, -500, 1000, 20_000, 21_000, 400_000])
            window = day + timedelta(days=1), day + timedelta(days=rng.randint(3, 6))
            batches.append((account, f"{account}-{n}", day, f"bank-{account < 'c'}", "acme", gross, *window, 0.02, 0.08, n % 3, n, 1, 3, gross, 0, 7))
    batches.append(("a", "a-undated", None, "bank-True", "acme", 1000, None, None, 0.02, 0.08, 0, 1, 1, 3, 1000, 0, 7))
    for n in range(900):
        day = START + timedelta(days=rng.randint(0, 70))
        cents = int(rng.choice([2000, 21_000, 22_000, 40_000, 41_000, 42_000, 401_000, 421_000, 800_000]) * rng.uniform(0.9, 1))
        credits.append((f"bank-{n % 2 == 0}", f"d{n:04}", day, cents, "X", "X", rng.choice([[], ["acme"], ["nova"], ["acme", "nova"]])))
    return batches, credits, spark.createDataFrame(batches, BATCH), spark.createDataFrame(credits, CREDIT)


def joint(batches, credits):
    found = {}
    for account, key, day, bank, channel, gross, first, last, low, high, *_ in batches:
        near = [b for b in batches if b[0] == account and b[1] != key and day and b[2] and abs((b[2] - day).days) <= 5]
        windows = [(first, last), *[(b[6], b[7]) for b in near]]
        for other in near:
            both = gross + other[5]
            for at, deposit, when, cents, _, _, owners in credits:
                if at != bank or both <= 0 or (owners and channel not in owners):
                    continue
                rate = 1 - float(cents) / float(both)
                if low <= rate <= high and any(a <= when <= z for a, z in windows):
                    this = abs(rate - (low + high) / 2), when, deposit, other[2], rate
                    found[key] = min(found.get(key, this), this)
    return {key: (best[3], best[2], round(best[4], 9)) for key, best in found.items()}


@pytest.mark.parametrize("cell_credits", [candidates.CELL_CREDITS, 150, 0])
def test_joint_payments_are_those_of_every_pair_and_credit(tables, cell_credits):
    batches, credits, windowed, money_in = tables
    rows = candidates.merged(windowed, money_in, cell_credits=cell_credits).collect()
    got = {r.batch_id: (r.merged_with, r.merged_deposit, round(r.merged_rate, 9)) for r in rows}
    want = joint(batches, credits)
    assert len(rows) == len(got) and got == want and len(want) > 20


def test_pairs_bring_what_candidates_need_and_nothing_is_joined_again(spark, tables):
    _, _, windowed, money_in = tables
    dated = windowed.filter("batch_date is not null")
    pairs = candidates.eligible(dated, money_in, calendar_table(spark, [], 5, "2024-02-01", "2024-07-01"))
    assert not {"fee_cents", "counterparty", "description", "owners"} & set(pairs.columns)
    single = candidates.single(pairs, RULES)
    scored = assignment.scored(single, dated, RULES)
    again = assignment.scored(single.drop("deduction_kinds"), dated, RULES)
    assert scored.columns.count("deduction_kinds") == 1
    assert scored.count() > 0 and scored.exceptAll(again.select(*scored.columns)).isEmpty()
    alone = candidates.single(pairs.limit(0), RULES)
    assert "Join" not in assignment.scored(spark.createDataFrame([], alone.schema), dated, RULES)._jdf.queryExecution().optimizedPlan().toString()


def plan(df, stage="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), stage)().toString()


RUN = "raw_id string, page int, seq int, x double, y double, text string"
PAGE = [
    ("a", 1, 1, 40.0, 800.0, "DESDE: 2024/01/01 HASTA: 2024/01/31"), ("a", 1, 2, 40.0, 780.0, "NÚMERO"), ("a", 1, 3, 120.0, 781.6, "99901"),
    ("a", 1, 4, 40.0, 760.0, "SALDO ANTERIOR"), ("a", 2, 1, 200.0, 700.0, "$1,000.00"), ("a", 2, 2, 40.0, 680.0, "2/01"),
    ("a", 2, 3, 110.0, 680.4, "PAGO"), ("a", 2, 4, 420.0, 679.6, "12.50-"), ("a", 2, 5, 540.0, 680.0, "987.50"),
    ("b", 1, 1, 40.0, 700.0, "nothing asked for"), (None, 1, 1, 40.0, 700.0, "lost"), ("b", None, 1, 40.0, 700.0, "lost"),
]


def test_days_are_asked_for_after_the_amounts(tables):
    """In a join, a function over an array is asked for every pair that meets; only pairs inside the band need it."""
    near = plan(candidates.merged(*tables[2:]))
    assert "exists(" in near
    assert not [line for line in near.splitlines() if "Join" in line and "exists(" in line]


def test_points_are_compared_and_candidates_are_summed_up_in_one_pass(spark, tmp_path):
    """Scores look through no table, and the field of all batches is read from the candidates once."""
    names = "account_id string, batch_id string, key string, rule int, first_date date, n_deposits int, deposit_ids array<string>, deduction_kinds int"
    merged = "merged_with date, merged_deposit string, merged_rate double"
    schema = f"{names}, {merged}, " + ", ".join(f"{c} string" for c in scoring.CHECKS)
    day = START

    def row(batch, key, amount, shape, multiple=None):
        paid = key != ""
        codes = (amount, "DATE_T1_EXACT", "DESCRIPTOR_MATCH", "IDENTITY_HOLDS") if paid else (None,) * 4
        return ("a", batch, key, 1 if paid else 3, day if paid else None, int(paid), [key] if paid else [], 3, day, "d9", 0.05, *codes, shape, multiple)

    rows = [
        row("b1", "d1", "AMOUNT_EXACT", "SETTLEMENT_SINGLE_CREDIT"), row("b1", "d2", "AMOUNT_WITHIN_ROUNDING", "SETTLEMENT_SINGLE_CREDIT"),
        row("b1", "", None, "SETTLEMENT_MERGED"), row("b2", "d3", "AMOUNT_MISMATCH", "SETTLEMENT_SINGLE_CREDIT"),
        row("b2", "", None, "SETTLEMENT_MERGED"), row("b3", "d4", "AMOUNT_EXACT", "SETTLEMENT_SINGLE_CREDIT", "SUBSET_SUM_MULTIPLE"),
    ]
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "c"))
    given = assignment.scored(spark.read.parquet(str(tmp_path / "c")), None, RULES)
    assert "map(" not in plan(given)
    points = {(r.batch_id, r.key): r.earned for r in given.collect()}
    scores = {(r.batch_id, r.key): r.score for r in given.collect()}
    w = RULES.weights
    common = sum(w[c] for c in ("DATE_T1_EXACT", "DESCRIPTOR_MATCH", "IDENTITY_HOLDS"))
    assert points[("b2", "d3")] == common + w.get("SETTLEMENT_SINGLE_CREDIT", 0)
    assert points[("b1", "d1")] - points[("b2", "d3")] == w["AMOUNT_EXACT"] and points[("b1", "")] == 0
    batches = spark.createDataFrame([("a", b, 3) for b in ("b1", "b2", "b3", "b4")], "account_id string, batch_id string, deduction_kinds int")
    won = spark.createDataFrame([("a", "b1", "d1"), ("a", "b3", "d4")], "account_id string, batch_id string, key string")
    settled = assignment.settle(batches, given, won, RULES)
    assert len(re.findall(r"Relation \[account_id[^\n]*shape_code", plan(settled))) == 1
    got = {r.batch_id: r for r in settled.collect()}
    assert (got["b1"].others, got["b1"].runner_up, got["b1"].candidates) == (2, scores[("b1", "d2")], 3)
    assert (got["b2"].candidates, got["b2"].shape_code, got["b2"].merged_deposit, got["b2"].amount_code) == (2, "SETTLEMENT_MERGED", "d9", "AMOUNT_MISMATCH")
    assert (got["b3"].others, got["b3"].runner_up, got["b4"].candidates, got["b4"].date_code) == (0, 0, 0, "DATE_OUT_OF_WINDOW")


def test_pairs_travel_once_to_charges_that_know_their_batch(spark):
    pairs = spark.createDataFrame([("c1", "d1"), ("c1", "d2"), ("c2", "d3"), ("c3", "d1"), (None, "d1")], "charge_id string, credit_id string")
    shares = spark.createDataFrame([("c1", "b1", 90, 100), ("c2", "b2", 40, 50)], "movement_id string, batch_id string, attributed_cents bigint, amount_cents bigint")
    results = spark.createDataFrame([("b1", "m1", True, ["d1"]), ("b2", "m2", False, None)], "batch_id string, match_id string, matched boolean, deposit_ids array<string>")
    batches = spark.createDataFrame([("b1", 400), ("b2", 0)], "batch_id string, gross_cents bigint")
    found = lineage.correlate(pairs, shares, results, batches)
    joins = [line for line in plan(found).splitlines() if "Join " in line]
    assert len(joins) == 3 and "charge_id" in joins[0] and all("batch_id" in j for j in joins[1:])
    got = {(r.charge_id, r.credit_id): (r.verdict, r.attributed_cents, r.share_of_batch) for r in found.collect()}
    assert got == {
        ("c1", "d1"): ("SETTLED_IN", 90, 0.25), ("c1", "d2"): ("SETTLED_ELSEWHERE", None, None), ("c2", "d3"): ("UNSETTLED", None, None),
        ("c3", "d1"): ("UNRELATED", None, None), (None, "d1"): ("UNRELATED", None, None),
    }


def test_statement_runs_travel_once_and_each_cell_is_read_once(spark):
    rows = statement.rows(spark.createDataFrame(PAGE, RUN))
    assert plan(rows, "executedPlan").count("Exchange") == 1
    got = [(r.raw_id, r.page, r.row, r.y, r.line) for r in rows.orderBy("raw_id", "page", "row").collect()]
    assert got == [
        ("a", 1, 0, 800, "DESDE: 2024/01/01 HASTA: 2024/01/31"), ("a", 1, 1, 780, "NÚMERO 99901"), ("a", 1, 2, 760, "SALDO ANTERIOR"),
        ("a", 2, 0, 700, "$1,000.00"), ("a", 2, 1, 680, "2/01 PAGO 12.50- 987.50"), ("b", 1, 0, 700, "nothing asked for"),
    ]
    heads = statement.headers(rows)
    found = {r.raw_id: (r.account_number, r.opening_cents, r.closing_cents, r.missing) for r in heads.collect()}
    assert found == {"a": ("99901", 100_000, None, "CLOSING"), "b": ("", None, None, "PERIOD")}
    entries = statement.entries(rows, heads)
    assert plan(entries).count("filter(cells") == len(statement.COLUMNS)
    assert [(r.amount_cents, r.balance_cents, str(r.value_date)) for r in entries.collect()] == [(-1250, 98_750, "2024-01-02")]


def test_plain_amounts_are_what_the_careful_reading_gives(spark):
    texts = ["1,234.56", "-1,234.56", "1,234.56-", "-1.00-", "(12.00)", "$ 5.10", "0.00", "12.3", "1.234", ",1.00", " 7.00 ", "1.00\n", "9" * 20 + ".00", "", None]
    cents = [123456, -123456, -123456, None, -1200, 510, 0, 1230, None, None, 700, 100, None, None, None]
    errors = [None, None, None, "NON_NUMERIC", None, None, None, None, "MANY_DECIMALS", None, None, None, "TOO_LARGE", "EMPTY", "EMPTY"]
    table = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    rows = table.select("n", parse_amount(F.col("t")).alias("p"), parse_amount(F.concat(F.col("t"), F.lit("          "))).alias("slow")).orderBy("n").collect()
    assert [r.p for r in rows] == [r.slow for r in rows]
    known = [n for n, t in enumerate(texts) if t != ",1.00"]
    assert [(rows[n].p.cents, rows[n].p.error) for n in known] == [(cents[n], errors[n]) for n in known]


def test_a_first_load_is_not_written_again_and_known_rows_only_count(spark, tmp_path):
    def written():
        return set(Path(shared_dir(spark).removeprefix("file:")).glob("saldo/upsert-judged-*"))

    table = versions.VersionedTable(spark, str(tmp_path / "t"), T.StructType.fromDDL("id string, run_id string, v int"), "id", {"_b": F.lit("0")})
    load = spark.createDataFrame([("a", "r", 1), ("b", "r", 2)], "id string, run_id string, v int")
    before = written()
    assert tuple(table.upsert(load, F.lit(1)).first()) == (2, 0, 1) and written() == before
    more = load.unionByName(spark.createDataFrame([("b", "r", 3), ("c", "r", 4)], "id string, run_id string, v int"))
    assert tuple(table.upsert(more, F.col("v")).first()) == (1, 3, 2)
    (judged,) = written() - before
    assert sorted(r.v for r in spark.read.parquet(str(judged)).collect() if r.v is not None) == [3, 4]
    assert sorted((r.id, r.v) for r in table.read().collect()) == [("a", 1), ("b", 3), ("c", 4)]


def test_arrays_of_parts_are_computed_before_they_are_unrolled(spark, tmp_path):
    orders = [(5, 1, "1-URGENT", "P", date(2024, 1, 3), 100.0), (6, 1, "1-URGENT", "O", date(2024, 1, 4), 50.0), (7, 1, "2-HIGH", None, date(2024, 1, 4), 10.0)]
    schema = "o_orderkey bigint, o_custkey bigint, o_orderpriority string, o_orderstatus string, o_orderdate date, o_totalprice double"
    spark.createDataFrame(orders, schema).write.parquet(str(tmp_path / "orders.parquet"))
    w = Workspace(spark, str(tmp_path))
    parts = sorted((r.external_id, r.type, r.amount_cents) for r in w.order_movements.collect())
    assert [p for p in parts if p[0] == "ord-5"] == [("ord-5", "CHARGE", 10_000), ("ord-5", "FEE", -300), ("ord-5", "REFUND", -1000), ("ord-5", "TAX", -57), ("ord-5", "WITHHOLDING", -150)]
    assert len(parts) == 13
    for made in (w.order_movements, w.order_lines):
        generators = re.findall(r"Generate (?:explode|inline)\(([^\n]*?)\), ", plan(made))
        assert generators and all(re.fullmatch(r"\w+#\d+", g) for g in generators)


def test_sums_of_orders_are_worked_out_once(spark, tmp_path):
    orders = [(n, 1, "1-URGENT", "O", date(2024, 1, 3 + n % 2), 100.0 + n) for n in range(6)]
    schema = "o_orderkey bigint, o_custkey bigint, o_orderpriority string, o_orderstatus string, o_orderdate date, o_totalprice double"
    spark.createDataFrame(orders, schema).write.parquet(str(tmp_path / "orders.parquet"))
    w = Workspace(spark, str(tmp_path))
    for made in (w.order_heads, w.order_lines):
        assert "o_orderkey" not in plan(made)
    assert {r.entry_id for r in w.order_heads.collect()} >= {"s-ord-0", "s-ord-1", "s-ord-3", "s-ord-4"}
    assert w.order_lines.groupBy("entry_id").agg(F.sum("amount_cents").alias("s")).filter("s <> 0").isEmpty()
