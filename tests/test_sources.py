from __future__ import annotations

import json
import os

import pytest
from pyspark.sql import functions as F

from saldo.config import INFLOW_DESCRIPTORS
from saldo.operators import ledger
from saldo.sources import gateway, inbox, statement, store
from saldo.streaming import landing


def page(n, *transactions):
    data = [
        {"id": f"tx{i}", "reference": f"r{i}", "amount_in_cents": 100 * i, "currency": "COP", "status": status, "created_at": "2026-04-25T01:30:00Z",
         "finalized_at": "2026-04-25T06:00:00.000Z" if i % 2 else None, "payment_method_type": "CARD" if i % 2 else None}
        for i, status in transactions
    ]
    return json.dumps({"data": data, "meta": {"page": n, "page_size": 200, "total_results": len(data)}})


def test_landed_pages(spark, tmp_path):
    (tmp_path / "1.json").write_text(page(1, (1, "APPROVED"), (2, "APPROVED"), (3, "DECLINED"), (4, "DECLINED")))
    (tmp_path / "2.json").write_text('{"error": "no"}')
    raw = gateway.read_pages(spark, str(tmp_path), "gateway")
    decoded = gateway.decoded(raw)
    assert [r.code for r in gateway.rejected(decoded).collect()] == ["PARSE_INTEGRITY"]
    rows = gateway.transactions(decoded)
    assert [(r.status, r.transactions) for r in gateway.excluded(rows).collect()] == [("DECLINED", 2)]
    charges = {r.external_id: r for r in gateway.charges(rows, "gw", "GATEWAY").collect()}
    assert str(charges["r1"].value_date) == "2026-04-25" and str(charges["r2"].value_date) == "2026-04-24"
    assert (charges["r1"].description, charges["r2"].description, charges["r2"].metadata["paymentMethod"]) == ("Pago aprobado CARD", "Pago aprobado", "UNKNOWN")
    assert inbox.unroutable(raw).count() == 1


def test_incremental_landing(spark, tmp_path):
    pages, out, mark = tmp_path / "in", tmp_path / "out", tmp_path / "mark"
    pages.mkdir()
    (pages / "1.json").write_text(page(1, (1, "APPROVED"), (2, "APPROVED")))

    def run():
        charges = landing.new_charges(spark, str(pages), "gateway", "gw", "GATEWAY")
        landing.ingest_available(charges, str(out), "pages", str(mark)).awaitTermination()
        return sorted(r.external_id for r in spark.read.parquet(str(out)).collect())

    assert run() == ["r1", "r2"]
    (pages / "2.json").write_text(page(2, (2, "APPROVED"), (5, "APPROVED")))
    assert run() == ["r1", "r2", "r5"]
    assert run() == ["r1", "r2", "r5"]


def test_inbox(spark, tmp_path):
    assert inbox.scan(spark, str(tmp_path / "nowhere"), ".pdf").isEmpty()
    (tmp_path / "b.PDF").write_bytes(b"%PDF-1")
    (tmp_path / "a.pdf").write_bytes(b"%PDF-22")
    (tmp_path / "c.txt").write_bytes(b"x")
    files = inbox.scan(spark, str(tmp_path), ".pdf")
    assert [(r.name, r.bytes) for r in inbox.listing(files).collect()] == [("a.pdf", 7), ("b.PDF", 6)]
    assert inbox.as_raw(files, "s").select(inbox.route(F.col("payload"))).distinct().collect()[0][0] == "bank-statement"
    assert os.listdir(tmp_path)


def runs(doc, rows, page=1, seq=0):
    return [(doc, page, seq + n, float(x), float(y), t) for n, (y, x, t) in enumerate(rows)]


HEADER = [
    (800, 40, "DESDE: 2025/12/01 HASTA: 2026/01/31"), (790, 40, "NÚMERO 123"), (780, 40, "SALDO ANTERIOR"), (780, 200, "100.00"),
    (770, 40, "SALDO ACTUAL"), (760, 200, "$130.00"), (750, 40, "TOTAL ABONOS"), (750, 200, "50.00"), (740, 40, "TOTAL CARGOS"), (740, 200, "20.00"),
]


def entry(y, day, text, value, balance):
    return [(y, 40, day), (y + 1, 110, text), (y - 1, 420, value), (y, 540, balance)]


def test_statements_fail_closed(spark):
    good = HEADER + entry(700, "30/12", "PAGO DE PROV ACME", "50.00", "150.00") + entry(680, "2/01", "CUOTA", "-20.00", "130.00")
    no_close = [r for r in good if r[2] not in ("SALDO ACTUAL", "$130.00")]
    cent = HEADER + entry(700, "30/12", "PAGO DE PROV ACME", "50.00", "150.01") + entry(680, "2/01", "CUOTA", "-20.00", "130.00")
    dropped = HEADER + entry(700, "30/12", "PAGO DE PROV ACME", "50.00", "150.00")
    letters = HEADER + entry(700, "30/12", "X", "5O.00", "150.00")
    data = [r for d, rows in (("good", good), ("noclose", no_close), ("cent", cent), ("dropped", dropped), ("letters", letters), ("bare", HEADER)) for r in runs(d, rows)]
    table = spark.createDataFrame(data, "raw_id string, page int, seq int, x double, y double, text string")
    rows = statement.rows(table)
    heads = statement.headers(rows)
    entries = statement.entries(rows, heads)
    verdicts = statement.verdicts(rows, heads, statement.chain(entries, heads))
    got = {r.raw_id: (r.accepted, r.rejected_because, r.locator) for r in verdicts.collect()}
    assert got == {
        "good": (True, None, None), "noclose": (False, "NO_CLOSING", None), "cent": (False, "CHAIN_BREAKS", "page=1;y=700"),
        "dropped": (False, "CHAIN_DOES_NOT_CLOSE", None), "letters": (False, "NON_NUMERIC", "page=1;y=700"), "bare": (False, "NO_ROWS", None),
    }
    made = statement.movements(entries, verdicts, F.concat(F.lit("bank:"), "account_number"), "statement", INFLOW_DESCRIPTORS)
    got = sorted((str(r.value_date), r.type, r.counterparty, r.amount_cents, r.account_id, str(r.occurred_at)) for r in made.collect())
    assert got == [
        ("2025-12-30", "TRANSFER_IN", "ACME", 5000, "bank:123", "2025-12-30 05:00:00"), ("2026-01-02", "OTHER", None, -2000, "bank:123", "2026-01-02 05:00:00"),
    ]
    assert {r.description for r in statement.unclassified(entries, INFLOW_DESCRIPTORS).collect()} == {"CUOTA", "X"}


def test_upserts_are_idempotent(spark):
    schema = "id string, amount_cents bigint, run_id string"
    old = spark.createDataFrame([("a", 1, None), ("b", 2, "run_1")], schema)
    new = spark.createDataFrame([("a", 1, "run_2"), ("b", 2, "run_2"), ("c", 3, "run_2"), ("c", 3, "run_2")], schema)
    merged, counts = store.upsert_movements(old, new)
    assert sorted(map(tuple, merged.collect())) == [("a", 1, "run_2"), ("b", 2, "run_1"), ("c", 3, "run_2")]
    assert tuple(counts.collect()[0]) == (1, 3)
    _, again = store.upsert_movements(merged, merged)
    assert tuple(again.collect()[0]) == (0, 3)
    raw = "raw_id string, payload string, run_id string"
    kept = store.upsert_raw(spark.createDataFrame([("r", "p", "run_1")], raw), spark.createDataFrame([("r", "p", "run_2"), ("s", "q", "run_2")], raw))
    assert sorted(map(tuple, kept.collect())) == [("r", "p", "run_2"), ("s", "q", "run_2")]


def test_reports_replace_their_own_part_only(spark, tmp_path):
    path = str(tmp_path / "reports")
    rows = spark.createDataFrame([(1,)], "n int")
    store.save_report(rows, path, "run_1", "flow", "a")
    store.save_report(rows.select(F.lit(2).alias("n")), path, "run_1", "flow", "b")
    store.save_report(rows.select(F.lit(3).alias("n")), path, "run_1", "flow", "a")
    got = {r.scope: r.n for r in store.load_report(spark, path, "flow", "run_1").collect()}
    assert got == {"a": 3, "b": 2}
    listed = spark.createDataFrame([("run_1", "2026-01-01"), ("run_2", "2026-02-01")], "run_id string, started_at string")
    assert [r.n for r in store.latest_report(spark, path, "flow", "a", listed).collect()] == [3]
    assert store.resolve_run(listed, "latest").collect()[0].run_id == "run_2" and store.resolve_run(listed, "x").isEmpty()


def test_pages_walk_the_whole_ledger(spark):
    rows = [(f"m{n}", f"2026-01-0{1 + n // 3}") for n in range(8)]
    movements = spark.createDataFrame(rows, "id string, d string").withColumn("value_date", F.to_date("d"))
    cursor, seen = None, []
    for _ in range(3):
        got = ledger.page(movements, 3, cursor=cursor).collect()
        seen += [r.id for r in sorted(got, key=lambda r: r.id)]
        assert {r.total for r in got} == {8}
        cursor = got[0].next_cursor
    assert seen == [f"m{n}" for n in range(8)] and cursor is None


def test_a_cluster_must_name_its_folder(monkeypatch):
    from types import SimpleNamespace

    from saldo.session import shared_dir

    conf = SimpleNamespace(get=lambda *_: None)
    fake = SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(getConf=lambda: conf, master="spark://x", applicationId="a"))
    with pytest.raises(ValueError, match="checkpoint"):
        shared_dir(fake)
