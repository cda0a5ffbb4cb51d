"""Where one payment's money went, computed for every payment of a run at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from saldo.operators.ranking import allocate
from saldo.session import materialise


def attribute(members: DataFrame, results: DataFrame, batches: DataFrame) -> DataFrame:
    """Each charge's share of what its batch settled for, weighted by its gross, ordered by id.

    What landed is shared out where something did; the expected net where nothing did.
    """
    settled = batches.select("batch_id", "gross_cents", "expected_net_cents").join(
        results.select("batch_id", "match_id", "matched", "observed_cents", "deposit_ids"), "batch_id", "left"
    )
    # only what sharing out needs travels through the ranking; the credits of a match join in later
    shares = (
        members.filter("type = 'CHARGE'")
        .withColumn("weight", F.abs("amount_cents"))
        .join(
            settled.select(
                "batch_id", F.coalesce("observed_cents", "expected_net_cents").alias("settled_cents")
            ),
            "batch_id",
        )
    )
    # sizes are measured before shares are cut: both read the rows, which are joined once
    shares = materialise(shares, "shares-of-batches")
    shared = allocate(shares, ["batch_id"], "weight", [F.col("movement_id")], {"settled_cents": "attributed_cents"})
    return shared.withColumn("attributed_cents", F.coalesce("attributed_cents", F.lit(0).cast("bigint"))).drop("weight")


def trace(attributed: DataFrame, results: DataFrame, batches: DataFrame, bank: DataFrame) -> DataFrame:
    """The steps of each charge: charge, batch, settlement, and the first bank credit if any."""
    match = results.select(
        "batch_id", "match_id", "observed_cents", F.get("deposit_ids", F.lit(0)).alias("bank_credit_id")
    )
    credit = bank.select(
        F.col("id").alias("bank_credit_id"), F.col("value_date").alias("credit_date"),
        F.col("amount_cents").alias("credit_cents"),
    )
    batch = batches.select("batch_id", "gross_cents", "n_charges")
    # one row per batch, joined before the charges
    known = batch.join(match, "batch_id", "left").join(credit, "bank_credit_id", "left")
    rows = attributed.join(known, "batch_id")

    def step(stage: str, ref: str, day: str, amount: str):
        return F.struct(
            F.lit(stage).alias("stage"), F.col(ref).alias("ref"), F.col(day).alias("date"), F.col(amount).alias("amount_cents")
        )

    landed = F.col("credit_date").isNotNull()
    steps = F.array_compact(
        F.array(
            step("CHARGE", "movement_id", "value_date", "amount_cents"),
            step("BATCH", "batch_id", "batch_date", "gross_cents"),
            step("SETTLEMENT", "batch_id", "batch_date", "settled_cents"),
            F.when(landed, step("BANK_CREDIT", "bank_credit_id", "credit_date", "credit_cents")),
        )
    )
    return rows.select(
        "account_id", "movement_id", F.col("amount_cents").alias("gross_cents"), "attributed_cents", "batch_id",
        "match_id", "bank_credit_id", landed.alias("settled"), steps.alias("steps"),
    )


def correlate(pairs: DataFrame, attributed: DataFrame, results: DataFrame, batches: DataFrame) -> DataFrame:
    """Verdict for (charge, credit) pairs: columns ``charge_id, credit_id``."""
    share = attributed.select(
        F.col("movement_id").alias("charge_id"), "batch_id", "attributed_cents", F.col("amount_cents").alias("charge_cents")
    )
    match = results.select("batch_id", "match_id", "matched", "deposit_ids")
    gross = batches.select("batch_id", "gross_cents")
    # what a batch says joins its charges, which pairs repeat
    known = share.join(match, "batch_id", "left").join(gross, "batch_id", "left")
    rows = pairs.join(known, "charge_id", "left")
    paid = F.coalesce("matched", F.lit(False))
    inside = paid & F.array_contains("deposit_ids", F.col("credit_id"))
    verdict = (
        F.when(F.col("batch_id").isNull(), "UNRELATED")
        .when(~paid, "UNSETTLED")
        .when(inside, "SETTLED_IN")
        .otherwise("SETTLED_ELSEWHERE")
    )
    fraction = F.when(
        F.col("gross_cents") > 0, F.abs("charge_cents").cast("double") / F.col("gross_cents").cast("double")
    ).otherwise(0.0)
    settled_in = verdict == "SETTLED_IN"
    return rows.select(
        "charge_id", "credit_id", verdict.alias("verdict"), "batch_id", "match_id",
        F.when(settled_in, F.col("attributed_cents")).alias("attributed_cents"),
        F.when(settled_in, fraction).alias("share_of_batch"),
    )


def deduction_shares(members: DataFrame, results: DataFrame, ledger: DataFrame) -> DataFrame:
    """Every charge's part of the fee, tax and withholding derived for its settlement.

    Only consistent derivations are shared out, and only when all charges of the batch are in the
    ledger range at hand.
    """
    derived = results.filter("derived_consistent").select(
        "batch_id", "n_charges", "derived_fee", "derived_tax", "derived_withholding"
    )
    charges = members.filter("type = 'CHARGE'").join(
        ledger.select(F.col("id").alias("movement_id")), "movement_id", "left_semi"
    )
    complete = (
        charges.groupBy("batch_id")
        .agg(F.count(F.lit(1)).alias("present"))
        .join(derived, "batch_id")
        .filter("present = n_charges")
        .drop("present", "n_charges")
    )
    weighed = charges.withColumn("weight", F.greatest("amount_cents", F.lit(0).cast("bigint"))).join(
        complete, "batch_id"
    )
    shared = allocate(
        weighed,
        ["batch_id"],
        "weight",
        [F.col("value_date"), F.col("movement_id")],
        {"derived_fee": "fee_cents", "derived_tax": "tax_cents", "derived_withholding": "withholding_cents"},
    )
    return shared.filter("weight > 0 and fee_cents is not null").select(
        "batch_id", "movement_id", "fee_cents", "tax_cents", "withholding_cents"
    )
