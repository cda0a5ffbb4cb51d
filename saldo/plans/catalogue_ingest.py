"""Registered queries: sources, sinks, ingestion, scalar functions, statements, ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saldo.config import INFLOW_DESCRIPTORS, channel_table
from saldo.functions import calendar as cal
from saldo.functions import descriptors, money, parties
from saldo.operators import ledger
from saldo.plans.documents import Documents
from saldo.plans.fixtures import RULES, Workspace
from saldo.session import own_path
from saldo.sources import gateway, inbox, journal, statement, store, versions


def docs(w: Workspace) -> Documents:
    if not hasattr(w, "_documents"):
        w._documents = Documents(w)
    return w._documents


# ---- sources


def src_gateway_pages(w: Workspace) -> DataFrame:
    d = docs(w)
    rows = d.decoded.filter("page is not null").select("page.meta.page", F.explode("page.data").alias("tx"))
    return rows.select("page", F.col("tx.id").alias("tx_id"), F.col("tx.amount_in_cents").alias("amount_cents"), "tx.status")


def src_inbox(w: Workspace) -> DataFrame:
    files = w.table("pages").select(F.col("url").alias("path"), F.encode("html", "UTF-8").alias("content"))
    return inbox.as_raw(files, "inbox").select("origin", "content_hash", "raw_id")


def _uploads(w: Workspace) -> DataFrame:
    k = F.col("doc_id") % 3
    name = F.concat(
        F.lit("dir/"), F.col("source"), F.lit(" é#"), F.col("doc_id").cast("string"),
        F.when(k == 0, ".pdf").when(k == 1, ".PDF").otherwise(".txt"),
    )
    body = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("%PDF"), "text")).otherwise(F.col("text"))
    return w.table("documents").select("doc_id", name.alias("filename"), F.encode(body, "UTF-8").alias("content"))


def src_inbox_list(w: Workspace) -> DataFrame:
    files = _uploads(w).select(
        F.col("filename").alias("path"), F.length("content").cast("bigint").alias("length"),
        F.lit("2024-01-01").cast("timestamp").alias("modificationTime"),
    )
    return inbox.listing(files.filter(F.lower("path").endswith(".pdf"))).select("name", "bytes")


def src_admit(w: Workspace) -> DataFrame:
    return inbox.admit(_uploads(w)).select("doc_id", "name", "admitted", F.coalesce("rejected_because", F.lit("")).alias("reason"))


def src_route(w: Workspace) -> DataFrame:
    k = F.col("doc_id") % 3
    payload = F.concat(F.when(k == 0, " " * 80 + '{"data":').when(k == 1, "%PDF").otherwise(""), "text")
    return w.table("documents").select(
        "doc_id", F.coalesce(inbox.route(F.encode(payload, "UTF-8")), F.lit("UNKNOWN_LAYOUT")).alias("parser")
    )


def _export_moves(w: Workspace) -> tuple[DataFrame, DataFrame]:
    orders = w.table("orders")
    moves = orders.select(
        F.col("o_orderkey").alias("id"), F.lit(48).alias("journal_id"),
        F.when(F.col("o_orderstatus") == "O", "false").otherwise(F.concat(F.lit("ORD/"), "o_orderkey")).alias("name"),
        F.when(F.col("o_orderstatus") == "F", "").otherwise(F.concat(F.lit("Ord-"), "o_orderkey")).alias("ref"),
        F.col("o_orderdate").alias("date"),
        F.when(F.col("o_orderstatus") == "F", "posted").when(F.col("o_orderstatus") == "P", "cancel").otherwise("waiting").alias("state"),
    )

    def side(n: int, account: str, debit: Column, credit: Column) -> Column:
        return F.struct(
            (F.col("o_orderkey") * 2 + n).alias("id"), F.lit(account).alias("account"), debit.alias("debit"), credit.alias("credit")
        )

    price, zero = F.col("o_totalprice"), F.lit(0.0)
    lines = orders.select(
        F.col("o_orderkey").alias("move_id"),
        F.explode(F.array(side(0, "2000010 Main account", price, zero), side(1, "700100 Other sales", zero, price))).alias("l"),
    ).select("l.id", "move_id", "l.account", "l.debit", "l.credit", F.lit("x").alias("name"))
    return moves, lines


def src_journal_norm(w: Workspace) -> DataFrame:
    moves, lines = _export_moves(w)
    return journal.heads(moves).join(journal.lines(lines), "entry_id").select(
        F.col("entry_id").cast("bigint").alias("entry_id"), "name", F.coalesce("ref", F.lit("")).alias("ref"), "date", "state", "line_id", "account_code",
        "account_name", "amount_cents",
    )


def src_journal(w: Workspace) -> DataFrame:
    moves, lines = _export_moves(w)
    heads, kept = journal.read_journal(journal.heads(moves), journal.lines(lines), "1996-01-01", "1998-12-31", 48)
    joined = heads.join(kept, "entry_id", "left")
    return joined.groupBy(F.col("entry_id").cast("bigint").alias("entry_id"), "date").agg(
        F.count("line_id").alias("lines"), F.sum("amount_cents").alias("signed_cents"),
        F.sum(F.abs("amount_cents")).alias("moved_cents"),
    )


def _own(w: Workspace) -> DataFrame:
    """The journal with a part of its entries written by this system."""
    mine = F.substring("external_id", 5, 20).cast("bigint") % 7 == 0
    return w.movements.select(
        F.concat(F.lit("o"), F.substring("id", 5, 32)).alias("entry_id"), F.col("account_id").alias("journal_key"),
        (F.substring("account_id", 4, 10).cast("int") + 48).alias("journal_id"), F.lit("J").alias("name"),
        F.when(mine, F.concat(F.lit("mov:"), "id")).otherwise(F.upper("external_id")).alias("ref"),
        F.col("value_date").alias("date"), F.when(F.col("amount_cents") % 4000 == 0, "draft").otherwise("posted").alias("state"),
    )


def src_own_entries(w: Workspace) -> DataFrame:
    return journal.own_entries(_own(w)).select("entry_id", "ref", "date", "state")


def src_find_by_ref(w: Workspace) -> DataFrame:
    wanted = w.movements.select(F.col("external_id").alias("ref"))
    return journal.find_by_ref(w.heads, wanted).select(F.col("upper_ref").alias("ref"), "entry_id", "date")


# ---- sinks


def snk_raw_upsert(w: Workspace) -> DataFrame:
    files = w.table("documents").select(
        "doc_id", F.concat(F.lit("doc="), "doc_id").alias("path"), F.encode("text", "UTF-8").alias("content")
    )
    raw = inbox.as_raw(files.select("path", "content"), "inbox").dropDuplicates(["raw_id"]).select("raw_id", "content_hash")
    early = F.substring("content_hash", 1, 1)
    stored = raw.filter(early < "a").withColumn("run_id", F.lit("run_1"))
    incoming = raw.filter(early >= "5").withColumn("run_id", F.lit("run_2"))
    table = versions.raw_table(w.spark, own_path(w.spark, "store"), stored.schema)
    for load in (stored, incoming):
        table.upsert(load, F.xxhash64("raw_id"))
    return table.read()


def _loads(w: Workspace) -> tuple[DataFrame, DataFrame]:
    k = F.substring("external_id", 5, 20).cast("bigint") % 3
    base = w.movements
    stored = base.filter(k != 0).withColumn("run_id", F.when(k == 1, "run_1"))
    incoming = base.filter(k != 1).withColumn("run_id", F.lit("run_2"))
    return stored, incoming


def snk_mov_upsert(w: Workspace) -> DataFrame:
    """Two loads into the versioned table, the second in part known."""
    stored, incoming = _loads(w)
    table = versions.movement_table(w.spark, own_path(w.spark, "store"), stored.schema)
    for load in (stored, incoming):
        table.upsert(load, F.substring("external_id", 5, 20).cast("bigint"))
    return table.read().select("id", "run_id", "amount_cents")


def snk_mov_upsert_counts(w: Workspace) -> DataFrame:
    stored, incoming = _loads(w)
    table = versions.movement_table(w.spark, own_path(w.spark, "store"), stored.schema)
    table.upsert(stored, F.xxhash64("id"))
    return table.upsert(incoming, F.xxhash64("id")).select("inserted", "updated")


def _runs(w: Workspace) -> DataFrame:
    day = F.date_trunc("day", "ts")
    return w.events.groupBy(day.alias("started_at")).agg(F.count(F.lit(1)).alias("events")).select(
        F.concat(F.lit("run_"), F.date_format("started_at", "yyyyMMddHHmmss")).alias("run_id"), "started_at", "events"
    )


def snk_run(w: Workspace) -> DataFrame:
    every = _runs(w)
    stored = every.filter(F.dayofmonth("started_at") % 2 == 0).withColumn("events", F.lit(0).cast("bigint"))
    merged = store.add_runs(stored, every)
    return store.newest_runs(merged, 20).select("run_id", "events")


def run_resolve(w: Workspace) -> DataFrame:
    runs = _runs(w)
    latest = store.resolve_run(runs, "latest").withColumn("wanted", F.lit("latest"))
    known = store.resolve_run(runs, "run_20240105000000").withColumn("wanted", F.lit("known"))
    return latest.unionByName(known).unionByName(store.resolve_run(runs, "run_x").withColumn("wanted", F.lit("unknown")))


# ---- ingestion


def ing_gateway_charge(w: Workspace) -> DataFrame:
    return docs(w).charges.select(
        "id", "external_id", F.unix_micros("occurred_at").alias("occurred_us"), "value_date", "type", "amount_cents",
        "counterparty", "description", F.col("metadata")["paymentMethod"].alias("method"), F.col("source.locator").alias("locator"),
    )


def ing_excluded(w: Workspace) -> DataFrame:
    d = docs(w)
    return gateway.excluded(d.transactions).join(d.raw_pages.select("raw_id", "origin"), "raw_id").select(
        "origin", "status", "transactions"
    )


def ing_shape_check(w: Workspace) -> DataFrame:
    return gateway.rejected(docs(w).decoded).select("origin", "code")


def ing_parse_amount(w: Workspace) -> DataFrame:
    k = F.col("o_orderkey") % 12
    plain = F.format_number("o_totalprice", 2)
    text = (
        F.when(k == 0, plain).when(k == 1, F.concat(F.lit("-"), plain)).when(k == 2, F.concat(plain, F.lit("-")))
        .when(k == 3, F.concat(F.lit("("), plain, F.lit(")"))).when(k == 4, F.concat(F.lit("+$ "), plain))
        .when(k == 5, F.concat(F.lit(" −"), plain)).when(k == 6, F.lit("  ")).when(k == 7, F.concat(plain, F.lit(".1")))
        .when(k == 8, F.concat(plain, F.lit("x"))).when(k == 9, F.concat(plain, F.lit("5")))
        .when(k == 10, F.concat(F.lit("99999999999999999999"), plain)).otherwise(F.regexp_replace(plain, r"\.\d+$", ""))
    )
    parsed = money.parse_amount(text)
    return w.table("orders").select(
        "o_orderkey", F.coalesce(parsed["cents"], F.lit(0)).alias("cents"), F.coalesce(parsed["error"], F.lit("")).alias("error")
    )


def ing_major_units(w: Workspace) -> DataFrame:
    return w.table("lineitem").select(
        "l_orderkey", "l_linenumber", "l_partkey", money.from_major(F.col("l_extendedprice")).alias("cents")
    ).groupBy("l_orderkey", "l_linenumber").agg(F.sum("cents").alias("cents"))


def _described(w: Workspace) -> DataFrame:
    k = F.col("doc_id") % 5
    text = (
        F.when(k == 0, F.concat(F.lit("PAGO DE PROV "), "source")).when(k == 1, F.concat(F.lit(" pago de terc "), "lang", F.lit(" ")))
        .when(k == 2, F.lit("PAGO DE PROV ")).when(k == 3, F.concat(F.lit("PAGO DE  PROV "), "lang")).otherwise(F.col("text"))
    )
    return w.table("documents").select("doc_id", descriptors.classify(text, INFLOW_DESCRIPTORS).alias("c"))


def ing_classify(w: Workspace) -> DataFrame:
    return _described(w).select("doc_id", "c.type", "c.rule", "c.recognised")


def ing_counterparty(w: Workspace) -> DataFrame:
    return _described(w).select("doc_id", F.coalesce("c.counterparty", F.lit("")).alias("counterparty"))


def ing_ids(w: Workspace) -> DataFrame:
    return w.movements.select("id", "account_id", "external_id", "value_date", "amount_cents")


def _page_codes(w: Workspace) -> DataFrame:
    """The code of every page that is not taken, one for each: pages are routed before they are decoded."""
    d = docs(w)
    lost = inbox.unroutable(d.raw_pages).select("raw_id", "origin", "code")
    return lost.unionByName(gateway.rejected(d.decoded).select("raw_id", "origin", "code"))


def ing_report(w: Workspace) -> DataFrame:
    """One load of pages into a store that knows half of their charges."""
    d = docs(w)
    incoming = d.charges.withColumn("run_id", F.lit("run_2"))
    table = versions.movement_table(w.spark, own_path(w.spark, "store"), incoming.schema)
    table.upsert(incoming.filter("amount_cents % 2000 = 0").withColumn("run_id", F.lit("run_1")), F.xxhash64("id"))
    counts = table.upsert(incoming, F.xxhash64("id"))
    return store.ingestion_report(d.raw_pages, incoming, counts, _page_codes(w))


def ing_pipeline(w: Workspace) -> DataFrame:
    """Pages, statements and unknown layouts in one load: what each document came to, read back from the store."""
    d = docs(w)
    accepted = d.charges.withColumn("run_id", F.lit("run_1"))
    table = versions.movement_table(w.spark, own_path(w.spark, "store"), accepted.schema)
    table.upsert(accepted, F.xxhash64("id"))
    held = table.read().groupBy(F.col("source.raw_record_id").alias("raw_id")).agg(F.count(F.lit(1)).alias("movements"))
    pages = d.raw_pages.withColumn("parser", inbox.route(F.encode("payload", "UTF-8")))
    page_docs = pages.join(held, "raw_id", "left").join(_page_codes(w).select("raw_id", "code"), "raw_id", "left").select(
        "origin", F.coalesce("parser", F.lit("none")).alias("parser"), F.coalesce("code", F.lit("ACCEPTED")).alias("outcome"),
        F.coalesce("movements", F.lit(0)).alias("movements"),
    )
    stm = d.statement_verdicts.select(
        F.col("raw_id").alias("origin"), F.lit("bank-statement").alias("parser"),
        F.when(F.col("accepted"), "ACCEPTED").otherwise(F.col("rejected_because")).alias("outcome"),
        F.when(F.col("accepted"), F.col("entries")).otherwise(0).alias("movements"),
    )
    return page_docs.unionByName(stm)


# ---- scalar functions


def fn_scale(w: Workspace) -> DataFrame:
    cents = F.round(F.col("l_extendedprice") * 100).cast("bigint")
    value = F.when(F.col("l_returnflag") == "R", -cents).otherwise(cents)
    num, den = F.col("l_quantity").cast("int"), F.col("l_linenumber") * 7 + 3
    base = w.table("lineitem")
    return base.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
        *[money.scale(value, num, den, r).alias(r.lower()) for r in ("TRUNCATE", "HALF_UP", "HALF_EVEN")],
    )


def fn_money_format(w: Workspace) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    signed = F.when(F.col("o_orderstatus") == "P", -cents).when(F.col("o_orderkey") % 50 == 0, cents % 7).otherwise(cents)
    return w.table("orders").select("o_orderkey", money.format_money(signed).alias("text"))


def fn_humanise(w: Workspace) -> DataFrame:
    cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
    text = F.concat(F.lit("delta COP "), -cents, F.lit(" sobre COP "), cents, F.lit("; COP x"))
    return w.table("orders").select("o_orderkey", money.humanise(text).alias("text"))


# ---- statements


def stm_rows(w: Workspace) -> DataFrame:
    return docs(w).statement_rows.select("raw_id", "page", "y", "line", F.size("cells").alias("cells"))


def stm_columns(w: Workspace) -> DataFrame:
    rows = docs(w).statement_rows.filter("page > 0")
    return rows.select("raw_id", "page", "y", *[statement.cell(c).alias(c) for c in statement.COLUMNS])


def stm_header(w: Workspace) -> DataFrame:
    return docs(w).statement_headers.select("raw_id", "account_number", "from_date", "to_date")


def stm_summary(w: Workspace) -> DataFrame:
    return docs(w).statement_headers.select(
        "raw_id", "opening_cents", F.coalesce("closing_cents", F.lit(0)).alias("closing_cents"), "credits_cents", "debits_cents",
        F.coalesce("missing", F.lit("")).alias("missing"),
    )


def stm_entries(w: Workspace) -> DataFrame:
    return docs(w).statement_entries.select("raw_id", "locator", "description", "amount_cents", "balance_cents")


def stm_year(w: Workspace) -> DataFrame:
    return docs(w).statement_entries.groupBy("raw_id", "value_date").agg(F.count(F.lit(1)).alias("entries"))


def stm_chain(w: Workspace) -> DataFrame:
    return docs(w).statement_chain.select(
        "raw_id", "locator", "expected_cents", "balance_cents", (F.col("expected_cents") != F.col("balance_cents")).alias("breaks")
    )


def stm_totals(w: Workspace) -> DataFrame:
    return docs(w).statement_verdicts.select(
        "raw_id", "entries", "accepted", F.coalesce("rejected_because", F.lit("")).alias("reason"),
        F.coalesce("locator", F.lit("")).alias("locator"), F.coalesce("expected_cents", F.lit(0)).alias("expected_cents"),
        F.coalesce("observed_cents", F.lit(0)).alias("observed_cents"),
    )


def stm_unknown(w: Workspace) -> DataFrame:
    return statement.unclassified(docs(w).statement_entries, INFLOW_DESCRIPTORS)


def stm_to_movement(w: Workspace) -> DataFrame:
    d = docs(w)
    made = statement.movements(
        d.statement_entries, d.statement_verdicts, F.concat(F.lit("bank:"), "account_number"), "statement", INFLOW_DESCRIPTORS
    )
    return made.select(
        "id", "account_id", F.unix_micros("occurred_at").alias("occurred_us"), "value_date", "type", "amount_cents",
        F.coalesce("counterparty", F.lit("")).alias("counterparty"), F.col("metadata")["rule"].alias("rule"),
        F.col("metadata")["runningBalance"].alias("running_balance"), F.col("source.locator").alias("locator"),
    )


# ---- ledger


def led_by_account(w: Workspace) -> DataFrame:
    return ledger.by_account(w.movements, "gw:3", "2024-01-05", "2024-01-20").orderBy(*ledger.ORDER).select(
        "id", "account_id", "value_date", "amount_cents"
    )


def led_by_ids(w: Workspace) -> DataFrame:
    wanted = w.order_movements.select("id").unionByName(w.movements.filter("account_id = 'gw:1'").select("id"))
    return ledger.by_ids(w.movements, wanted).select("id", "external_id")


def led_by_external(w: Workspace) -> DataFrame:
    return ledger.by_external(w.order_movements, "ord-100").orderBy(*ledger.ORDER).select("id", "type", "amount_cents")


def led_by_type(w: Workspace) -> DataFrame:
    return ledger.by_type(w.order_movements, "FEE", "TAX").groupBy("account_id", "type").agg(
        F.count(F.lit(1)).alias("n"), F.sum("amount_cents").alias("cents")
    )


def led_between(w: Workspace) -> DataFrame:
    return ledger.between(w.order_movements, "1997-03-01", "1997-03-31").select("id", "value_date", "amount_cents")


def led_count(w: Workspace) -> DataFrame:
    return ledger.count_by_account(w.order_movements.unionByName(w.movements))


def led_total(w: Workspace) -> DataFrame:
    return ledger.total(w.order_movements, "account_id")


def led_balance_at(w: Workspace) -> DataFrame:
    return ledger.balance_at(w.order_movements, "1998-06-30")


def led_daily_balance(w: Workspace) -> DataFrame:
    return ledger.daily_balances(w.order_movements).select("account_id", "value_date", "movements", "balance_cents")


def led_page(w: Workspace) -> DataFrame:
    return ledger.page(w.movements, 25, offset=50).select("id", "value_date", "total", "next_cursor")


def _stored(w: Workspace, movements: DataFrame) -> versions.VersionedTable:
    """A store of the movements, loaded in two parts of which the second comes late."""
    table = versions.movement_table(w.spark, own_path(w.spark, "store"), movements.schema, buckets=2)
    late = F.pmod(F.xxhash64("id"), F.lit(3)) == 0
    for part in (~late, late):
        table.upsert(movements.filter(part), F.xxhash64("id"))
    return table


def led_balance_stored(w: Workspace) -> DataFrame:
    return ledger.stored_balance_at(_stored(w, w.order_movements), "1998-06-30")


def led_page_stored(w: Workspace) -> DataFrame:
    table = _stored(w, w.movements)
    first = ledger.stored_page(table, 50)
    cursor = first.select(F.first("next_cursor")).first()[0]
    return ledger.stored_page(table, 25, cursor).select("id", "value_date", "total", "next_cursor")


def led_accounts(w: Workspace) -> DataFrame:
    return ledger.accounts(w.order_movements.unionByName(w.movements))


# ---- calendar and policy


def _days(w: Workspace) -> DataFrame:
    return w.movements.groupBy(F.col("value_date").alias("d")).agg(F.count(F.lit(1)).alias("movements"))


def cal_dim(w: Workspace) -> DataFrame:
    return _days(w).join(w.flow.calendar, "d").select("d", "movements", "is_business")


def cal_next(w: Workspace) -> DataFrame:
    days = _days(w).withColumn("n", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    return cal.with_business_day_after(days, w.flow.calendar, "d", F.col("n"), "next").select("d", "n", "next")


def cal_between(w: Workspace) -> DataFrame:
    days = _days(w).select("d").join(w.flow.calendar, "d").select("d", F.col("ord").alias("from_ord"))
    spans = days.withColumn("other", F.explode(F.array(*[F.date_add("d", n) for n in (-1, 0, 4, 9)])))
    to = w.flow.calendar.select(F.col("d").alias("other"), F.col("ord").alias("to_ord"))
    between = cal.days_between(F.col("from_ord"), F.col("to_ord"), F.col("d"), F.col("other"))
    return spans.join(to, "other").select("d", "other", between.alias("business_days"))


def cal_window(w: Workspace) -> DataFrame:
    return w.flow.windowed.select("batch_id", "batch_date", "window_start", "window_end")


def pol_accrual(w: Workspace) -> DataFrame:
    return w.flow.accrued.select("id", "accrual_date")


def pol_close(w: Workspace) -> DataFrame:
    return w.flow.accrued.select("id", "channel", "close_date")


def pol_due(w: Workspace) -> DataFrame:
    return w.flow.accrued.select("id", "due_date")


def _per_channel(w: Workspace) -> DataFrame:
    counts = w.movements.join(w.scopes, "account_id").groupBy("channel").agg(F.count(F.lit(1)).alias("movements"))
    return counts.join(channel_table(w.spark, RULES), "channel")


def pol_for_channel(w: Workspace) -> DataFrame:
    return _per_channel(w).select(
        "channel", "movements", "cadence", F.coalesce("cutoff_minutes", F.lit(-1)).alias("cutoff_minutes"), "window_from",
        "window_to", "band_lo", "band_hi", "vat_num", "wh_num", "own_band",
    )


def pol_describe(w: Workspace) -> DataFrame:
    words = cal.describe_cadence(F.col("cadence"), F.col("week_ends_on"), F.col("month_ends_on"))
    return _per_channel(w).select("channel", "movements", words.alias("cadence"))


# ---- whose money


def _named(w: Workspace) -> DataFrame:
    """Counterparties of movements and bank credits, each tried against every configured channel."""
    both = w.movements.select("counterparty").unionByName(w.bank.select("counterparty"))
    counted = both.groupBy("counterparty").agg(F.count(F.lit(1)).alias("rows"))
    return counted.withColumn("owners", parties.owners(F.col("counterparty"), RULES)).withColumn(
        "channel", F.explode(F.array(*[F.lit(k) for k in RULES.channel_keys]))
    )


def pred_channel(w: Workspace) -> DataFrame:
    return _named(w).select("counterparty", "rows", "channel", parties.is_channels(F.col("owners"), F.col("channel")).alias("is_channel"))


def pred_foreign(w: Workspace) -> DataFrame:
    return _named(w).select("counterparty", "rows", "channel", parties.is_foreign(F.col("owners"), F.col("channel")).alias("is_foreign"))


def pred_owner(w: Workspace) -> DataFrame:
    return w.bank.select("id", F.coalesce(parties.owner(F.col("counterparty"), RULES), F.lit("")).alias("owner"))


QUERIES = {
    f.__name__: f
    for f in (
        src_gateway_pages, src_inbox, src_inbox_list, src_admit, src_route, src_journal, src_journal_norm, src_own_entries,
        src_find_by_ref, snk_raw_upsert, snk_mov_upsert, snk_mov_upsert_counts, snk_run, run_resolve, ing_gateway_charge,
        ing_excluded, ing_shape_check, ing_parse_amount, ing_major_units, ing_classify, ing_counterparty, ing_ids, ing_pipeline,
        ing_report, fn_scale, fn_money_format, fn_humanise, stm_rows, stm_columns, stm_header, stm_summary, stm_entries, stm_year,
        stm_chain, stm_totals, stm_unknown, stm_to_movement, led_by_account, led_by_ids, led_by_external, led_by_type, led_between,
        led_count, led_total, led_balance_at, led_daily_balance, led_page, led_balance_stored, led_page_stored, led_accounts, cal_dim, cal_next, cal_between, cal_window,
        pol_accrual, pol_close, pol_due, pol_for_channel, pol_describe, pred_channel, pred_foreign, pred_owner,
    )
}
