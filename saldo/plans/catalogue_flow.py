"""Registered queries: batches, candidates, evidence, assignment, deductions, results, lineage.

Names without a suffix run over the purchases, whose channels state no deductions; names ending in
``_stated`` run over the orders, whose channel states its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saldo.functions import scoring
from saldo.functions.money import percent
from saldo.operators import assignment, batches, candidates, deductions, lineage, ranking, results
from saldo.plans.fixtures import ORDER_RULES, RULES, Workspace
from saldo.plans.flow import Flow
from saldo.plans.run import Run
from saldo.session import own_path, small_table
from saldo.sources import store

def text(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit("")).alias(column)


def number(column: str) -> Column:
    return F.coalesce(F.col(column), F.lit(0)).alias(column)


def six(column: str) -> Column:
    return F.round(F.coalesce(F.col(column), F.lit(-1.0)), 6).alias(column)


# ---- batches


def bat_build(w: Workspace) -> DataFrame:
    return w.flow.batches.select("batch_id", "account_id", "channel", "due_date", "batch_date", "n_charges", "gross_cents")


def bat_gross(w: Workspace) -> DataFrame:
    return w.order_flow.batches.select("batch_id", "account_id", "due_date", "batch_date", "n_charges", "gross_cents")


def bat_members(w: Workspace) -> DataFrame:
    return w.order_flow.members.select("batch_id", "movement_id", "type")


def bat_deductions(w: Workspace) -> DataFrame:
    return batches.deduction_rows(w.order_flow.batches)


def bat_net(w: Workspace) -> DataFrame:
    return w.order_flow.batches.select("batch_id", "deductions_cents", "expected_net_cents")


def bat_identity(w: Workspace) -> DataFrame:
    return w.order_flow.batches.select("batch_id", batches.identity_holds(ORDER_RULES.identity_cents).alias("holds"))


def bat_list(w: Workspace) -> DataFrame:
    listed = batches.in_range(w.order_flow.batches, "1997-01-01", "1997-06-30")
    return results.page(
        listed.select("batch_id", "batch_date", "account_id", "gross_cents"), [F.col("batch_date"), F.col("account_id")], 50, 100
    )


def bat_find(w: Workspace) -> DataFrame:
    return w.flow.batches.filter("account_id = 'gw:0' and batch_date = date'2024-01-10'").select("batch_id", "gross_cents", "n_charges")


# ---- candidates


def cand_bank_range(w: Workspace) -> DataFrame:
    last = F.to_date(F.lit("2024-01-24"))  # the third business day after the 19th
    return candidates.bank_range(w.bank, "2024-01-10", last).select("id", "account_id", "value_date", "amount_cents")


def _eligible(flow: Flow) -> DataFrame:
    return flow.pairs.select("batch_id", "deposit_id", "value_date", "cents", "names_channel")


def cand_eligible(w: Workspace) -> DataFrame:
    return _eligible(w.flow)


def cand_eligible_stated(w: Workspace) -> DataFrame:
    return _eligible(w.order_flow)


def _targets(flow: Flow) -> DataFrame:
    cents, slack = candidates.target(flow.rules)
    return flow.windowed.select("batch_id", cents.alias("target_cents"), slack.alias("slack_cents"))


def cand_target(w: Workspace) -> DataFrame:
    return _targets(w.flow)


def cand_target_stated(w: Workspace) -> DataFrame:
    return _targets(w.order_flow)


def _of_rule(flow: Flow, rule: int) -> DataFrame:
    return flow.candidates.filter(F.col("rule") == rule)


def codes() -> list[Column]:
    return [text(c) for c in scoring.CHECKS]


def cand_single(w: Workspace) -> DataFrame:
    return _of_rule(w.flow, 1).select("batch_id", "key", "observed_cents", *codes())


def cand_single_stated(w: Workspace) -> DataFrame:
    return _of_rule(w.order_flow, 1).select("batch_id", "key", "observed_cents", *codes())


def _split(flow: Flow) -> DataFrame:
    return _of_rule(flow, 2).select("batch_id", "key", "n_deposits", "observed_cents", number("solutions"), *codes())


def cand_split(w: Workspace) -> DataFrame:
    return _split(w.flow)


def cand_split_stated(w: Workspace) -> DataFrame:
    return _split(w.order_flow)


def _subset(flow: Flow) -> DataFrame:
    from saldo.operators import subsets

    cents, slack = candidates.target(flow.rules)
    aimed = flow.pairs.withColumn("target_cents", cents).withColumn("slack_cents", slack)
    columns = ("batch_id", "deposit_id", "value_date", "cents", "target_cents", "slack_cents")
    found, _ = subsets.search(aimed.select(*columns), flow.rules)
    return found.select("batch_id", "solution", F.size("positions").alias("size"), F.array_join("deposits", "+").alias("key"), "complete")


def cand_subset(w: Workspace) -> DataFrame:
    return _subset(w.flow)


def cand_subset_stated(w: Workspace) -> DataFrame:
    return _subset(w.order_flow)


def _merged(flow: Flow) -> DataFrame:
    found = candidates.merged(flow.windowed, flow.money_in)
    return found.select("batch_id", "merged_with", "merged_deposit", six("merged_rate"))


def cand_merged(w: Workspace) -> DataFrame:
    return _merged(w.flow)


def cand_merged_stated(w: Workspace) -> DataFrame:
    return _merged(w.order_flow)


def cand_dedupe(w: Workspace) -> DataFrame:
    """Which rule keeps each set of credits."""
    return w.flow.candidates.filter("n_deposits > 0").select("batch_id", "key", "rule", "n_deposits")


def amt_describe(w: Workspace) -> DataFrame:
    known = _of_rule(w.flow, 1).select("batch_id", "key", "observed_cents").join(
        w.flow.windowed.select("batch_id", "gross_cents", "expected_net_cents", "deductions_cents"), "batch_id"
    )
    rate = candidates.implied_rate(F.col("observed_cents"))
    return known.select(
        "batch_id", "key", "gross_cents", "deductions_cents", "expected_net_cents", "observed_cents",
        (F.col("observed_cents") - F.col("expected_net_cents")).alias("delta_cents"), F.round(rate, 6).alias("implied_rate"),
    )


# ---- evidence and scores


def _code(flow: Flow, column: str) -> DataFrame:
    return flow.candidates.filter("n_deposits > 0").select("batch_id", "key", text(column))


def ev_amount(w: Workspace) -> DataFrame:
    return _code(w.flow, "amount_code")


def ev_amount_stated(w: Workspace) -> DataFrame:
    return _code(w.order_flow, "amount_code")


def ev_date(w: Workspace) -> DataFrame:
    return _code(w.order_flow, "date_code")


def ev_descriptor(w: Workspace) -> DataFrame:
    return _code(w.flow, "descriptor_code")


def ev_identity(w: Workspace) -> DataFrame:
    return _code(w.order_flow, "identity_code").unionByName(_code(w.flow, "identity_code"))


def sc_score(w: Workspace) -> DataFrame:
    return w.flow.candidates.select("batch_id", "key", "rule", "earned", "attainable", "score")


def sc_score_stated(w: Workspace) -> DataFrame:
    return w.order_flow.candidates.select("batch_id", "key", "rule", "earned", "attainable", "score")


def sc_attainable(w: Workspace) -> DataFrame:
    """What could be earned, per account: less where a channel states nothing to check."""
    out = scoring.attainable(F.col("deduction_kinds") > 0, RULES)
    both = w.flow.batches.select("account_id", out.alias("attainable")).unionByName(
        w.order_flow.batches.select("account_id", out.alias("attainable"))
    )
    return both.groupBy("account_id", "attainable").agg(F.count(F.lit(1)).alias("batches"))


def sc_gate(w: Workspace) -> DataFrame:
    return w.order_flow.candidates.select("batch_id", "key", text("gate"), text("first_failed"))


def sc_stamp(w: Workspace) -> DataFrame:
    parts = w.flow.candidates.select(
        "batch_id", "key", F.explode(F.array_compact(F.array(*[F.col(c) for c in scoring.CHECKS]))).alias("code")
    )
    return parts.select("batch_id", "key", "code", scoring.weight(F.col("code"), RULES).alias("weight"))


def sc_band(w: Workspace) -> DataFrame:
    return w.flow.first_pass.select("batch_id", "score", "contested", "status")


def _rubric(w: Workspace) -> DataFrame:
    seen = w.flow.explained.select(F.explode("evidence").alias("e")).groupBy("e.code").agg(F.count(F.lit(1)).alias("results"))
    return results.rubric(w.spark, RULES).join(seen, "code", "left").withColumn("results", F.coalesce("results", F.lit(0)))


def rubric(w: Workspace) -> DataFrame:
    return _rubric(w).select("code", "dimension", number("weight"), "disqualifying", "attainable", "results")


def rubric_glossary(w: Workspace) -> DataFrame:
    return results.glossary(_rubric(w)).select("dimension", "code", number("weight"), "results")


# ---- assignment


def asg_pairs(w: Workspace) -> DataFrame:
    return w.flow.candidates.filter("n_deposits > 0 and gate is null").select("batch_id", "key", "score", "n_deposits")


def asg_pairs_stated(w: Workspace) -> DataFrame:
    return w.order_flow.candidates.filter("n_deposits > 0 and gate is null").select("batch_id", "key", "score", "n_deposits")


def asg_greedy(w: Workspace) -> DataFrame:
    return w.flow.won.select("batch_id", "key")


def asg_greedy_stated(w: Workspace) -> DataFrame:
    return w.order_flow.won.select("batch_id", "key")


def asg_contest(w: Workspace) -> DataFrame:
    won = w.flow.first_pass.filter("matched")
    return won.select("batch_id", "others", "runner_up", "provisional_score", "contested", "uniqueness_code")


def asg_final(w: Workspace) -> DataFrame:
    return w.flow.first_pass.filter("matched").select("batch_id", "earned", "attainable", "score", "status")


def asg_reject(w: Workspace) -> DataFrame:
    return w.flow.alternatives.select("batch_id", "key", "score", "rejected_because")


def asg_unmatched(w: Workspace) -> DataFrame:
    rows = w.flow.first_pass.filter("not matched")
    return rows.select("batch_id", "candidates", *codes(), text("first_shape"), F.coalesce("merged_deposit", F.lit("")).alias("merged_deposit"))


def asg_invariants(w: Workspace) -> DataFrame:
    """What must never happen, per account: all counts are zero.

    A credit or a batch taken twice, or a pair left over whose claims are all free.
    """
    flow = w.order_flow
    pairs = flow.candidates.filter("n_deposits > 0 and gate is null").select("account_id", "batch_id", "key", "deposit_ids")
    won = pairs.join(flow.won, ["account_id", "batch_id", "key"], "left_semi")
    used = won.select("account_id", F.explode("deposit_ids").alias("deposit"))
    twice = used.groupBy("account_id", "deposit").count().filter("count > 1").groupBy("account_id").agg(F.count(F.lit(1)).alias("credits_twice"))
    double = won.groupBy("account_id", "batch_id").count().filter("count > 1").groupBy("account_id").agg(F.count(F.lit(1)).alias("batches_twice"))
    lost = pairs.join(won.select("batch_id"), "batch_id", "left_anti")
    blocked = lost.select("batch_id", "key", F.explode("deposit_ids").alias("deposit"), "account_id").join(used, ["account_id", "deposit"], "left_semi")
    free = lost.join(blocked.select("batch_id", "key").distinct(), ["batch_id", "key"], "left_anti").groupBy("account_id").agg(F.count(F.lit(1)).alias("pairs_left"))
    every = flow.batches.select("account_id").distinct()
    return every.join(twice, "account_id", "left").join(double, "account_id", "left").join(free, "account_id", "left").na.fill(0)


def res_match(w: Workspace) -> DataFrame:
    return w.flow.first_pass.select(
        "match_id", "batch_id", "batch_date", "status", F.array_join(F.array_sort(F.coalesce("deposit_ids", F.array().cast("array<string>"))), "+").alias("right"),
        "gross_cents", "expected_net_cents", number("observed_cents"), number("delta_cents"), "window_start", "window_end", "score",
    )


def res_rule(w: Workspace) -> DataFrame:
    return w.flow.results.select("batch_id", "rule_id", "rule_version")


def settlements(w: Workspace) -> DataFrame:
    """The flagship: every batch with its verdict."""
    return w.flow.results.select(
        "match_id", "account_id", "channel", "batch_date", "status", "rule_id", "score", "gross_cents", "expected_net_cents",
        number("observed_cents"), number("derived_total"), text("amount_code"), text("date_code"), text("shape_code"),
    )


def settlements_stated(w: Workspace) -> DataFrame:
    return w.order_flow.results.select(
        "match_id", "account_id", "batch_date", "status", "rule_id", "score", "gross_cents", "expected_net_cents", number("observed_cents")
    )


def scheduled_only(w: Workspace) -> DataFrame:
    return w.order_flow.scheduled_only().select("batch_id", "gross_cents", "expected_net_cents", text("deposit_id"), number("score"))


# ---- deductions


def ded_derive(w: Workspace) -> DataFrame:
    """Every eligible single credit taken as the net of its batch."""
    known = _of_rule(w.flow, 1).select("batch_id", "key", "observed_cents").join(w.flow.windowed, "batch_id")
    return deductions.derive(known).select(
        "batch_id", "key", "gap_cents", F.coalesce("derived_fee", F.lit(0)).alias("fee"), F.coalesce("derived_tax", F.lit(0)).alias("tax"),
        F.coalesce("derived_withholding", F.lit(0)).alias("withholding"), F.coalesce("vat_drift", F.lit(-1)).alias("vat_drift"),
        F.round("implied_rate", 6).alias("implied_rate"), "consistent", "in_band",
    )


def ded_apply(w: Workspace) -> DataFrame:
    return w.flow.first_pass.filter("derived_total is not null").select(
        "batch_id", "derived_fee", "derived_tax", "derived_withholding", "derived_total", "derived_consistent"
    )


def cal_rates(w: Workspace) -> DataFrame:
    return w.flow.calibration.select("account_id", "settlements", six("median"), six("deviation"), six("typical_lo"), six("typical_hi"))


def cal_typical(w: Workspace) -> DataFrame:
    return w.flow.results.select("batch_id", text("amount_code"), "score", "status", "first_pass_status")


# ---- outputs


def out_unattributed(w: Workspace) -> DataFrame:
    return w.flow.unattributed.select("account_id", "movement_id", "value_date", "amount_cents", "reason")


def out_unattributed_stated(w: Workspace) -> DataFrame:
    return w.order_flow.unattributed.select("account_id", "movement_id", "value_date", "amount_cents", "reason")


def out_unattributed_anywhere(w: Workspace) -> DataFrame:
    return results.unattributed_anywhere(w.flow.results, w.bank).select("id", "amount_cents")


def out_totals(w: Workspace) -> DataFrame:
    return results.totals(w.flow.results, "account_id")


def out_totals_stated(w: Workspace) -> DataFrame:
    return results.totals(w.order_flow.results, "account_id")


def out_summary(w: Workspace) -> DataFrame:
    return results.summary(w.flow.results, w.flow.unattributed)


def out_list(w: Workspace) -> DataFrame:
    rows = results.listing(w.flow.results, "ambiguous", "2024-01-08", "2024-01-20").select("match_id", "batch_date", "account_id", "score")
    return results.page(rows, [F.col("batch_date"), F.col("account_id")], 10, 2)


def out_find(w: Workspace) -> DataFrame:
    first = w.flow.results.agg(F.min("match_id").alias("match_id"))
    return w.flow.results.join(first, "match_id", "left_semi").select("match_id", "batch_id", "status", "score")


def _members(w: Workspace) -> DataFrame:
    return results.match_members(w.flow.results, w.flow.members, w.flow.alternatives, w.bank)


def out_members(w: Workspace) -> DataFrame:
    return _members(w).select("match_id", "role", "movement_id", "value_date", "amount_cents", number("score"), text("reason"))


def out_member_sums(w: Workspace) -> DataFrame:
    return results.member_sums(_members(w))


def out_unattr_list(w: Workspace) -> DataFrame:
    theirs = results.unattributed_by_owner(w.flow.unattributed, "alpha").withColumn("wanted", F.lit("alpha"))
    others = results.unattributed_by_owner(w.flow.unattributed, "other").withColumn("wanted", F.lit("other"))
    return theirs.unionByName(others).select("wanted", "movement_id", "value_date", "amount_cents", text("owner"))


def out_channels(w: Workspace) -> DataFrame:
    rows = results.channel_overview(w.flow.results, w.flow.channels, w.flow.calibration)
    return rows.select(
        "account_id", "channel", "settlements", "observed_count", six("lowest_rate"), six("highest_rate"), "cadence", "cutoff",
        "declares_own_band", "reports_own_deductions", six("typical_lo"), six("typical_hi"),
    )


def out_exceptions(w: Workspace) -> DataFrame:
    return results.exceptions(w.flow.results).select("match_id", "status", "at_risk_cents")


def out_agent_summary(w: Workspace) -> DataFrame:
    return results.totals(w.flow.results.withColumn("run", F.lit("latest")), "run")


def out_agent_list(w: Workspace) -> DataFrame:
    """Pages an agent is shown: one status, all of them further on, and the first unattributed credits."""
    some = results.agent_page(w.flow.results, "unmatched").withColumn("asked", F.lit("unmatched"))
    every = results.agent_page(w.flow.results, None, 10, 30).withColumn("asked", F.lit("all"))
    pages = some.unionByName(every).select("asked", F.col("match_id").alias("id"), "status", results.amount_at_risk().alias("cents"), "total")
    loose = results.unattributed_page(w.flow.unattributed).select(
        F.lit("unattributed").alias("asked"), F.col("movement_id").alias("id"), F.lit("").alias("status"),
        F.col("amount_cents").alias("cents"), F.lit(0).cast("bigint").alias("total"),
    )
    return pages.unionByName(loose)


def out_evidence(w: Workspace) -> DataFrame:
    parts = w.flow.explained.select("batch_id", F.posexplode("evidence").alias("position", "e"))
    return parts.select("batch_id", "position", "e.code", "e.dimension", "e.passed", "e.weight")


def out_rates_shown(w: Workspace) -> DataFrame:
    return w.flow.results.filter("implied_rate is not null").select("batch_id", percent(F.round("implied_rate", 6)).alias("rate"))


def snk_report(w: Workspace) -> DataFrame:
    """Totals saved under a run and read back as the latest of their kind."""
    path = own_path(w.spark, "reports")
    totals = results.totals(w.flow.results, "account_id").withColumn("scope", F.lit("all"))
    for run in ("run_20240201000000", "run_20240301000000"):
        store.save_report(totals, path, run, "flow")
    runs = small_table(
        w.spark, [("run_20240201000000", "2024-02-01"), ("run_20240301000000", "2024-03-01")], "run_id string, started_at string"
    )
    return store.latest_report(w.spark, path, "flow", "all", runs).select(
        "run_id", "account_id", "batches", "gross_cents", "observed_cents"
    )


def snk_revive(w: Workspace) -> DataFrame:
    """Results saved per account and read back with their types: dates compare, cents add up."""
    path = own_path(w.spark, "reports")
    rows = w.flow.results.select("match_id", "batch_date", "gross_cents", F.col("account_id").alias("scope"))
    store.save_report(rows, path, "run_20240201000000", "results")
    back = store.load_report(w.spark, path, "results", "run_20240201000000")
    return back.filter(F.col("batch_date") >= F.to_date(F.lit("2024-01-10"))).select("scope", "match_id", "batch_date", "gross_cents")


def snk_run_report(w: Workspace) -> DataFrame:
    """Every line of the run's artifact: what it is about, and an amount from its body."""
    run = w.flow.batches.agg(F.min("batch_date").alias("from"), F.max("batch_date").alias("to"))
    lines = results.run_report(
        run, results.totals(w.flow.results, "account_id"), w.flow.explained, w.flow.unattributed, w.plain_books.totals,
        results.rubric(w.spark, RULES),
    )

    def field(*names: str) -> Column:
        return F.coalesce(*[F.get_json_object("body", f"$.{n}") for n in names])

    of = field("match_id", "movement_id", "journal_key", "code", "account_id", "from")
    return lines.select(
        "section", of.alias("id"), F.coalesce(field("gross_cents", "amount_cents", "erp_once_cents", "weight"), F.lit("0")).cast("bigint").alias("figure"),
        F.coalesce(field("status", "reason", "dimension"), F.lit("")).alias("what"),
    )


def _order_run(w: Workspace) -> Run:
    """A run over half a year of the orders: their movements and their bank's, loaded in turn into a store of its own."""
    flow = w.order_flow
    run = Run(
        w.spark, own_path(w.spark, "store"), "run_19970701000000", "1997-07-01T00:00:00Z", "1997-01-01", "1997-06-30",
        w.order_scopes, flow.rules, flow.holidays,
    )
    run.load("orders", w.order_movements, F.substring("external_id", 5, 20).cast("bigint"))
    run.load("bank", flow.bank, F.xxhash64("id"))
    return run


def run_flow(w: Workspace) -> DataFrame:
    """The range settled from the store and read back from the saved reports."""
    run = _order_run(w)
    run.save()
    back = store.load_report(w.spark, f"{run.root}/reports", "results", run.run_id)
    return back.select(
        "match_id", "account_id", "batch_date", "status", "score", "gross_cents", "expected_net_cents",
        F.coalesce("observed_cents", F.lit(0)).alias("observed_cents"),
    )


def run_loads(w: Workspace) -> DataFrame:
    """What each source's load brought, and what the same loads bring a second time."""
    run = _order_run(w)
    again = run.load("orders again", w.order_movements, F.substring("external_id", 5, 20).cast("bigint"))
    first, second = run.loaded[:2]
    return first.unionByName(second).unionByName(again).select("source", "inserted", "updated", "version")


def snk_run_record(w: Workspace) -> DataFrame:
    """The run's stored row: its range, its rules, and a digest of each source's raw records."""
    run = Run(
        w.spark, own_path(w.spark, "store"), "run_20240201000000", "2024-02-01T00:00:00Z", "2024-01-01", "2024-01-31", w.scopes, RULES, []
    )
    uploads = w.table("documents").select(F.concat_ws("|", "doc_id", "text").alias("content"))
    stored = run.record({"pages": (w.table("pages"), "html"), "documents": (uploads, "content")})
    digests = stored.select("run_id", "range_from", "range_to", "ruleset_version", F.explode("input_hashes").alias("source", "digest"), "finished_at")
    return digests.select("run_id", "range_from", "range_to", "ruleset_version", "source", "digest", F.col("finished_at").isNotNull().alias("finished"))


# ---- lineage


def alloc_largest(w: Workspace) -> DataFrame:
    """Each order's total shared out over its lines by price."""
    lines = w.table("lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("weight")
    )
    totals = w.table("orders").select(
        F.col("o_orderkey").alias("l_orderkey"),
        F.when(F.col("o_orderstatus") == "P", -F.round(F.col("o_totalprice") * 100)).otherwise(F.round(F.col("o_totalprice") * 100)).cast("bigint").alias("total_cents"),
    )
    shared = ranking.allocate(lines.join(totals, "l_orderkey"), ["l_orderkey"], "weight", [F.col("l_linenumber")], {"total_cents": "share_cents"})
    return shared.select("l_orderkey", "l_linenumber", "share_cents")


def lin_attribute(w: Workspace) -> DataFrame:
    return w.flow.attributed.select("movement_id", "batch_id", "amount_cents", "settled_cents", "attributed_cents")


def lin_attribute_stated(w: Workspace) -> DataFrame:
    """What each charge of a channel that states its deductions got of its settlement."""
    return w.order_flow.attributed.select("movement_id", "batch_id", "attributed_cents")


def lin_attribute_orders(w: Workspace) -> DataFrame:
    """Shares of what the order flow's batches settled for, and of the expected net of those without a match."""
    return w.order_flow.attributed.select("movement_id", "batch_id", "settled_cents", "attributed_cents")


def lin_trace(w: Workspace) -> DataFrame:
    rows = lineage.trace(w.flow.attributed, w.flow.results, w.flow.batches, w.bank)
    return rows.select(
        "movement_id", "batch_id", "match_id", text("bank_credit_id"), "settled", "attributed_cents",
        F.array_join(F.transform("steps", lambda s: F.concat_ws("=", s["stage"], s["amount_cents"].cast("string"))), ";").alias("steps"),
    )


def lin_correlate(w: Workspace) -> DataFrame:
    """Every charge against each credit of its batch's match, the first of its bank account, and a charge of no batch."""
    flow = w.flow
    first = w.bank.groupBy(F.col("account_id").alias("bank_account_id")).agg(F.min("id").alias("credit_id"))
    anywhere = w.movements.join(w.scopes.select("account_id", "bank_account_id"), "account_id").join(first, "bank_account_id")
    matched = flow.results.filter("matched").select("batch_id", F.explode("deposit_ids").alias("credit_id"))
    pairs = anywhere.select(F.col("id").alias("charge_id"), "credit_id").unionByName(
        flow.shared_out.select(F.col("movement_id").alias("charge_id"), "batch_id").join(matched, "batch_id").select("charge_id", "credit_id")
    ).distinct()
    strays = w.order_movements.filter("type = 'CHARGE'").select(F.col("id").alias("charge_id"), F.lit("none").alias("credit_id"))
    rows = lineage.correlate(pairs.unionByName(strays), flow.shared_out, flow.results, flow.batches)
    return rows.select("charge_id", "credit_id", "verdict", number("attributed_cents"), six("share_of_batch"))


def lin_correlate_orders(w: Workspace) -> DataFrame:
    """Every charge of the order flow against every credit of its batch's match, and against one that settles nothing."""
    flow = w.order_flow
    charges = flow.shared_out.select(F.col("movement_id").alias("charge_id"), "batch_id")
    matched = flow.results.filter("matched").select("batch_id", F.explode("deposit_ids").alias("credit_id"))
    pairs = charges.join(matched, "batch_id").select("charge_id", "credit_id")
    pairs = pairs.unionByName(charges.select("charge_id", F.lit("none").alias("credit_id")))
    rows = lineage.correlate(pairs, flow.shared_out, flow.results, flow.batches)
    return rows.select("charge_id", "credit_id", "verdict", number("attributed_cents"), six("share_of_batch"))


def ded_shares(w: Workspace) -> DataFrame:
    return w.flow.shares.select("batch_id", "movement_id", "fee_cents", "tax_cents", "withholding_cents")


QUERIES = {
    f.__name__: f
    for f in (
        settlements, settlements_stated, scheduled_only, bat_build, bat_gross, bat_members, bat_deductions, bat_net, bat_identity,
        bat_list, bat_find, cand_bank_range, cand_eligible, cand_eligible_stated, cand_target, cand_target_stated, cand_single,
        cand_single_stated, cand_subset, cand_subset_stated, cand_split, cand_split_stated, cand_merged, cand_merged_stated,
        cand_dedupe, amt_describe, ev_amount, ev_amount_stated, ev_date, ev_descriptor, ev_identity, sc_score, sc_score_stated,
        sc_attainable, sc_gate, sc_stamp, sc_band, rubric, rubric_glossary, asg_pairs, asg_pairs_stated, asg_greedy,
        asg_greedy_stated, asg_contest, asg_final, asg_reject, asg_unmatched, asg_invariants, res_match, res_rule, ded_derive,
        ded_apply, cal_rates, cal_typical, out_unattributed, out_unattributed_stated, out_unattributed_anywhere, out_totals,
        out_totals_stated, out_summary, out_list, out_find, out_members, out_member_sums, out_unattr_list, out_channels,
        out_exceptions, out_agent_summary, out_agent_list, out_evidence, out_rates_shown, snk_report, snk_revive, snk_run_report,
        run_flow, run_loads, snk_run_record,
        alloc_largest, lin_attribute, lin_attribute_stated, lin_attribute_orders, lin_trace, lin_correlate, lin_correlate_orders, ded_shares,
    )
}
