"""Match results, what nobody claimed, and the figures read from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saldo.config import EVIDENCE_DIMENSIONS, RuleSet
from saldo.functions import calendar as cal
from saldo.functions import ids, parties, scoring
from saldo.functions.money import money_text, percent
from saldo.operators import deductions
from saldo.session import small_table

# The names results give to the three ways of settling.
RULE_NAMES = {1: ("SCHEDULED_SETTLEMENT", 2), 2: ("SPLIT_SETTLEMENT", 1), 3: ("MERGED_SETTLEMENT", 1)}


def match_results(settled: DataFrame, windowed: DataFrame, rules: RuleSet, run: str | None = None) -> DataFrame:
    """One row per batch: status, both sides, amounts, derived deductions, score and its parts."""
    batch = windowed.select(
        "batch_id", "channel", "bank_account_id", "batch_date", "due_date", "n_charges", "gross_cents",
        "deductions_cents", "expected_net_cents", "window_start", "window_end", "window_from", "window_to",
        "vat_num", "vat_den", "wh_num", "wh_den", "band_lo", "band_hi", "slack", "batch_ord",
    )
    rows = settled.join(batch, "batch_id")
    won = F.col("matched")
    is_split = won & (F.col("n_deposits") > 1)
    rows = deductions.derive(rows)
    silent = won & (F.col("deduction_kinds") == 0) & F.col("derived_fee").isNotNull()
    for part in ("derived_fee", "derived_tax", "derived_withholding"):
        rows = rows.withColumn(part, F.when(silent, F.col(part)))
    return rows.select(
        ids.match_id(F.col("batch_id"), F.when(won, F.col("key"))).alias("match_id"),
        F.lit(run).cast("string").alias("run_id"),
        F.lit(rules.version).alias("ruleset_version"),
        F.lit("CHANNEL_TO_BANK").alias("kind"),
        "account_id", "channel", "bank_account_id", "batch_id", "batch_date", "due_date", "n_charges", "status",
        "matched", "deposit_ids", F.coalesce("n_deposits", F.lit(0)).alias("n_deposits"), "first_date",
        F.when(is_split, RULE_NAMES[2][0]).otherwise(RULE_NAMES[1][0]).alias("rule_id"),
        F.when(is_split, RULE_NAMES[2][1]).otherwise(RULE_NAMES[1][1]).alias("rule_version"),
        "gross_cents", "deductions_cents", "deduction_kinds", "expected_net_cents",
        F.when(won, F.col("observed_cents")).alias("observed_cents"),
        F.when(won, F.col("observed_cents") - F.col("expected_net_cents")).alias("delta_cents"),
        F.when(won, F.col("implied_rate")).alias("implied_rate"),
        "window_start", "window_end", "window_from", "window_to", "band_lo", "band_hi", "score", "earned",
        "attainable", "contested", "runner_up", "others", "candidates", "provisional_score",
        *scoring.CHECKS, "uniqueness_code", "first_shape", "solutions",
        "merged_with", "merged_deposit", "merged_rate",
        "derived_fee", "derived_tax", "derived_withholding",
        F.when(silent, F.col("gap_cents")).alias("derived_total"),
        F.when(silent, F.col("consistent")).alias("derived_consistent"),
    )


def evidence(results: DataFrame, rules: RuleSet) -> DataFrame:
    """Add ``evidence``: the ordered checks of each result with what was expected and observed."""

    def money(c: str) -> Column:
        return money_text(F.col(c))

    observed = F.coalesce(F.col("observed_cents"), F.lit(0))
    gap = money_text(F.col("gross_cents") - observed)
    by_rate = F.col("amount_code").isin("IMPLIED_FEE_IN_BAND", "IMPLIED_FEE_TYPICAL")
    silent = F.col("deduction_kinds") == 0
    amount = scoring.check(
        F.col("amount_code"), "AMOUNT", rules,
        F.when(by_rate, F.concat(percent(F.col("band_lo")), F.lit("–"), percent(F.col("band_hi")))).otherwise(money("expected_net_cents")),
        F.when(by_rate, F.concat(percent(F.col("implied_rate")), F.lit(" · "), gap)).otherwise(money_text(observed)),
    )
    date = scoring.check(
        F.col("date_code"), "DATE", rules,
        F.concat(F.lit("T+"), F.col("window_from").cast("string")),
        F.col("first_date").cast("string"),
    )
    merged_text = F.concat(F.col("merged_with").cast("string"), F.lit(" "), percent(F.col("merged_rate")))
    shape = scoring.check(
        F.col("shape_code"), "INTEGRITY", rules, F.lit("1"),
        F.when(F.col("shape_code") == "SETTLEMENT_MERGED", F.col("merged_deposit")).otherwise(F.col("n_deposits").cast("string")),
        F.when(F.col("shape_code") == "SETTLEMENT_MERGED", merged_text),
    )
    merged_first = F.col("matched") | (F.col("shape_code") != "SETTLEMENT_MERGED")
    identity = scoring.check(
        F.col("identity_code"), "INTEGRITY", rules, money("gross_cents"),
        money_text(F.col("expected_net_cents") + F.col("deductions_cents")),
        applicable=~((F.col("identity_code") == "IDENTITY_BROKEN") & silent),
    )
    derived = scoring.check(
        F.when(F.col("derived_total").isNotNull(), "DEDUCTIONS_DERIVED"), "AMOUNT", None, None,
        percent(F.col("implied_rate")),
        F.concat_ws(" · ", money("derived_fee"), money("derived_tax"), money("derived_withholding")),
        passed=F.coalesce(F.col("derived_consistent"), F.lit(False)),
    )
    parts = [
        F.when(~merged_first, shape),
        amount,
        date,
        scoring.check(F.col("descriptor_code"), "DESCRIPTOR", rules, F.col("channel")),
        identity,
        F.when(merged_first, shape),
        scoring.check(F.col("first_shape"), "INTEGRITY", rules),
        scoring.check(F.col("multiple_code"), "AMOUNT", rules, F.lit("1"), F.col("solutions").cast("string")),
        scoring.check(F.col("uniqueness_code"), "UNIQUENESS", rules, None, F.col("runner_up").cast("string")),
        derived,
    ]
    return results.withColumn("evidence", F.array_compact(F.array(*parts)))


def unattributed(results: DataFrame, scopes: DataFrame, bank: DataFrame, rules: RuleSet) -> DataFrame:
    """Per gateway account: credits of its bank account that none of its batches claimed.

    ``scopes`` is (account_id, channel, bank_account_id).
    """
    claimed = results.filter("matched").select("account_id", F.explode("deposit_ids").alias("id"))
    money_in = bank.filter("amount_cents > 0").withColumnRenamed("account_id", "bank_account_id")
    listed = money_in.join(scopes.select("account_id", "channel", "bank_account_id"), "bank_account_id")
    names = parties.owners(F.col("counterparty"), rules)
    return (
        listed.join(claimed, ["account_id", "id"], "left_anti")
        .withColumn("named", parties.is_channels(names, F.col("channel")))
        .select(
            "account_id", "channel", "bank_account_id", F.col("id").alias("movement_id"), "value_date",
            "amount_cents", "counterparty", "description", parties.owner(F.col("counterparty"), rules).alias("owner"),
            F.when(F.col("named"), "AMOUNT_MISMATCH").otherwise("DESCRIPTOR_FOREIGN").alias("reason"),
        )
    )


def unattributed_anywhere(results: DataFrame, bank: DataFrame) -> DataFrame:
    """The cross-channel view: credits no channel claimed at all."""
    claimed = results.filter("matched").select(F.explode("deposit_ids").alias("id"))
    return bank.filter("amount_cents > 0").join(claimed, "id", "left_anti")


STATUSES = ("CONFIRMED", "PROBABLE", "AMBIGUOUS", "UNMATCHED")


def totals(results: DataFrame, *keys: str) -> DataFrame:
    """The funnel: what was sold, kept, expected, received and left unexplained."""
    summed = results.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("batches"),
        *[F.count(F.when(F.col("status") == s, 1)).alias(s.lower()) for s in STATUSES],
        F.coalesce(F.sum("gross_cents"), F.lit(0)).alias("gross_cents"),
        F.coalesce(F.sum(F.col("gross_cents") - F.col("expected_net_cents")), F.lit(0)).alias("__stated"),
        F.coalesce(F.sum("derived_total"), F.lit(0)).alias("__derived"),
        F.coalesce(F.sum("observed_cents"), F.lit(0)).alias("observed_cents"),
    )
    silent = F.col("__stated") == 0
    kept = F.when(silent, F.col("__derived")).otherwise(F.col("__stated"))
    return summed.select(
        *keys, "batches", *[s.lower() for s in STATUSES], "gross_cents",
        kept.alias("deductions_cents"),
        (silent & (F.col("__derived") != 0)).alias("deductions_derived"),
        (F.col("gross_cents") - kept).alias("expected_cents"),
        "observed_cents",
        (F.col("gross_cents") - kept - F.col("observed_cents")).alias("unexplained_cents"),
    )


def summary(results: DataFrame, unclaimed: DataFrame) -> DataFrame:
    """Totals per account, with the unattributed credits split into the channel's and the others'."""
    theirs = F.col("reason") == "AMOUNT_MISMATCH"
    loose = unclaimed.groupBy("account_id").agg(
        F.count(F.when(theirs, 1)).alias("unattributed_channel"),
        F.coalesce(F.sum(F.when(theirs, F.col("amount_cents"))), F.lit(0)).alias("unattributed_channel_cents"),
        F.count(F.when(~theirs, 1)).alias("unattributed_other"),
    )
    return totals(results, "account_id").join(loose, "account_id", "left").na.fill(
        0, ["unattributed_channel", "unattributed_channel_cents", "unattributed_other"]
    )


def listing(
    results: DataFrame, status: str | None = None, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Results of one status (any case) and an inclusive range of closing dates, both optional."""
    if status:
        results = results.filter(F.col("status") == status.upper())
    if start:
        results = results.filter(F.col("batch_date") >= F.to_date(F.lit(start)))
    if end:
        results = results.filter(F.col("batch_date") <= F.to_date(F.lit(end)))
    return results


def page(df: DataFrame, order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """One page of an ordered listing, each row with the total of the whole listing."""
    ordered = df.orderBy(*order)
    rows = (ordered.offset(offset) if offset else ordered).limit(limit)
    return rows.withColumn("total", df.agg(F.count(F.lit(1))).scalar())


def amount_at_risk() -> Column:
    return F.abs(F.coalesce(F.col("delta_cents"), F.col("expected_net_cents")))


def exceptions(results: DataFrame) -> DataFrame:
    """Everything not confirmed, with what is at stake; the reader orders and limits."""
    return results.filter("status <> 'CONFIRMED'").withColumn("at_risk_cents", amount_at_risk())


def agent_page(results: DataFrame, status: str | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of the results of one status, or of all, in the order of their batches, with the total of the list."""
    return page(listing(results, status), [F.col("batch_date"), F.col("account_id")], limit, offset)


def unattributed_page(loose: DataFrame, limit: int = 15, offset: int = 0) -> DataFrame:
    """A page of the credits that nothing explains, oldest first."""
    return loose.orderBy("value_date", "movement_id").offset(offset).limit(limit)


def match_members(
    results: DataFrame, batch_members: DataFrame, alternatives: DataFrame, bank: DataFrame
) -> DataFrame:
    """The movements behind each result: its charges, its credits, and the candidates it rejected."""
    match = results.select("match_id", "batch_id", "deposit_ids")
    charges = batch_members.filter("type = 'CHARGE'").join(match.select("match_id", "batch_id"), "batch_id").select(
        "match_id", F.lit("CHARGE").alias("role"), "movement_id", "value_date", "amount_cents",
        F.lit(None).cast("int").alias("score"), F.lit(None).cast("string").alias("reason"),
    )
    credit_side = bank.select(F.col("id").alias("movement_id"), "value_date", "amount_cents")
    credits = match.select("match_id", F.explode("deposit_ids").alias("movement_id")).join(credit_side, "movement_id").select(
        "match_id", F.lit("CREDIT").alias("role"), "movement_id", "value_date", "amount_cents",
        F.lit(None).cast("int").alias("score"), F.lit(None).cast("string").alias("reason"),
    )
    rejected = (
        alternatives.join(match.select("match_id", "batch_id"), "batch_id")
        .select("match_id", F.explode("deposit_ids").alias("movement_id"), "score", F.col("rejected_because").alias("reason"))
        .join(credit_side, "movement_id")
        .select("match_id", F.lit("REJECTED").alias("role"), "movement_id", "value_date", "amount_cents", "score", "reason")
    )
    return charges.unionByName(credits).unionByName(rejected)


def member_sums(members: DataFrame) -> DataFrame:
    return members.filter("role <> 'REJECTED'").groupBy("match_id").agg(
        F.coalesce(F.sum(F.when(F.col("role") == "CHARGE", F.col("amount_cents"))), F.lit(0)).alias("charges_cents"),
        F.coalesce(F.sum(F.when(F.col("role") == "CREDIT", F.col("amount_cents"))), F.lit(0)).alias("credits_cents"),
    )


def unattributed_by_owner(unclaimed: DataFrame, wanted: str = "all") -> DataFrame:
    """Unattributed credits of one channel, of nobody known (``other``), or all."""
    if wanted == "all":
        return unclaimed
    if wanted == "other":
        return unclaimed.filter("owner is null")
    return unclaimed.filter(F.col("owner") == wanted)


def channel_overview(results: DataFrame, channels: DataFrame, calibration: DataFrame) -> DataFrame:
    """How each account's channel is set up next to what was observed of it."""
    seen = results.groupBy("account_id", "channel").agg(
        F.count(F.when(F.col("matched"), 1)).alias("settlements"),
        F.count("derived_total").alias("observed_count"),
        F.min(F.when(F.col("derived_total").isNotNull(), F.col("implied_rate"))).alias("lowest_rate"),
        F.max(F.when(F.col("derived_total").isNotNull(), F.col("implied_rate"))).alias("highest_rate"),
    )
    setup = channels.select(
        "channel", F.array_join("patterns", ",").alias("patterns"),
        cal.describe_cadence(F.col("cadence"), F.col("week_ends_on"), F.col("month_ends_on")).alias("cadence"),
        F.concat_ws(" ", "cutoff", "cutoff_zone").alias("cutoff"), "window_from", "window_to", "band_lo", "band_hi",
        F.col("own_band").alias("declares_own_band"),
    )
    usual = calibration.select("account_id", "median", "deviation", "typical_lo", "typical_hi")
    return (
        seen.join(setup, "channel")
        .join(usual, "account_id", "left")
        .withColumn("reports_own_deductions", (F.col("settlements") > 0) & (F.col("observed_count") == 0))
    )


def run_report(
    run: DataFrame, flow_summary: DataFrame, results: DataFrame, unclaimed: DataFrame, erp_totals: DataFrame, rubric_rows: DataFrame
) -> DataFrame:
    """The run artifact as JSON documents, one row per line of the report.

    A run has any number of results, so the artifact is written as JSON lines tagged with their
    section instead of one document gathered in a single task.
    """

    def section(name: str, df: DataFrame) -> DataFrame:
        return df.select(F.lit(name).alias("section"), F.to_json(F.struct("*")).alias("body"))

    return (
        section("run", run)
        .unionByName(section("summary", flow_summary))
        .unionByName(section("reconciliations", results))
        .unionByName(section("unattributed", unclaimed))
        .unionByName(section("erp", erp_totals))
        .unionByName(section("rubric", rubric_rows))
    )


def rubric(spark, rules: RuleSet) -> DataFrame:
    """Every code of the vocabulary with its weight, gate and the codes it excludes."""
    rows = []
    for ordinal, (code, dimension) in enumerate(EVIDENCE_DIMENSIONS.items()):
        group = next((m for m in rules.exclusive.values() if code in m), ())
        rows.append(
            (ordinal, code, dimension, rules.weights.get(code), code in rules.disqualifying,
             [c for c in group if c != code], rules.attainable)
        )
    return small_table(
        spark,
        rows,
        "ordinal int, code string, dimension string, weight int, disqualifying boolean, "
        "exclusive_with array<string>, attainable int",
    )


def glossary(rubric_rows: DataFrame) -> DataFrame:
    return rubric_rows.orderBy("dimension", F.col("weight").desc_nulls_last(), "ordinal")
