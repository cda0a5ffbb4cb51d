"""What a silent gateway kept: the fee, tax and withholding behind a gap, and the usual rate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saldo.config import RuleSet
from saldo.functions import scoring
from saldo.functions.money import scale

#: Fewer settlements than this say nothing about what is usual.
MINIMUM_OBSERVATIONS = 3


def derive(
    df: DataFrame, gross: str = "gross_cents", observed: str = "observed_cents", charges: str = "n_charges"
) -> DataFrame:
    """Split gross − observed into withholding (statutory), tax (statutory on the fee) and fee.

    All in truncated integer cents. A negative gap, or one smaller than the withholding, is left
    unsplit, and so is a batch without positive gross: such a row gets no parts and is not consistent.
    """
    positive = F.col(gross) > 0
    gap = F.col(gross) - F.col(observed)
    step = df.withColumn("gap_cents", gap).withColumn(
        "__wh", scale(F.col(gross), F.col("wh_num"), F.col("wh_den"))
    )
    step = step.withColumn("__rest", F.col("gap_cents") - F.col("__wh"))
    explained = positive & (F.col("gap_cents") >= 0) & (F.col("__rest") >= 0)
    step = step.withColumn(
        "__base", scale(F.col("__rest"), F.col("vat_den"), F.col("vat_num") + F.col("vat_den"))
    )
    step = step.withColumn("__vat", scale(F.col("__base"), F.col("vat_num"), F.col("vat_den")))
    step = step.withColumn("__fee", F.col("__rest") - F.col("__vat"))
    drift = F.abs(F.col("__vat") - scale(F.col("__fee"), F.col("vat_num"), F.col("vat_den")))
    slack = F.greatest(F.lit(1), F.col(charges) * F.col("slack"))
    rate = F.when(positive, F.col("gap_cents").cast("double") / F.col(gross).cast("double"))
    return (
        step.withColumn("derived_fee", F.when(explained, F.col("__fee")))
        .withColumn("derived_tax", F.when(explained, F.col("__vat")))
        .withColumn("derived_withholding", F.when(explained, F.col("__wh")))
        .withColumn("vat_drift", F.when(explained, drift))
        .withColumn("implied_rate", rate)
        .withColumn("consistent", F.coalesce(explained & (drift <= slack), F.lit(False)))
        .withColumn("in_band", F.coalesce(rate.between(F.col("band_lo"), F.col("band_hi")), F.lit(False)))
        .drop("__wh", "__rest", "__base", "__vat", "__fee")
    )


def _four_decimals(x: Column) -> Column:
    return F.floor(x * 10_000 + F.lit(0.5)) / F.lit(10_000.0)


def calibrate(rates: DataFrame, *keys: str, rate: str = "implied_rate") -> DataFrame:
    """What a channel usually charges: median and spread of its settled rates, per ``keys``."""
    measured = rates.filter(F.col(rate).isNotNull()).groupBy(*keys).agg(
        F.count(F.lit(1)).alias("settlements"),
        F.percentile(rate, F.lit(0.5)).alias("median"),
        F.stddev_pop(rate).alias("deviation"),
    )
    return measured.filter(F.col("settlements") >= MINIMUM_OBSERVATIONS).select(
        *keys,
        "settlements",
        "median",
        "deviation",
        _four_decimals(F.col("median") - F.col("deviation")).alias("typical_lo"),
        _four_decimals(F.col("median") + F.col("deviation")).alias("typical_hi"),
    )


def credit_typical(results: DataFrame, calibration: DataFrame, rules: RuleSet) -> DataFrame:
    """Second pass: a settlement on the usual rate earns more. It never makes or breaks a match."""
    band = calibration.select("account_id", "typical_lo", "typical_hi")
    known = results.join(band, "account_id", "left")
    usual = (
        F.col("matched")
        & F.col("derived_total").isNotNull()
        & F.col("implied_rate").between(F.col("typical_lo"), F.col("typical_hi"))
    )
    known = known.withColumn("typical", F.coalesce(usual, F.lit(False)))
    lifted = known.withColumn("first_pass_status", F.col("status")).withColumn(
        "amount_code",
        F.when(
            F.col("typical") & (F.col("amount_code") == "IMPLIED_FEE_IN_BAND"), "IMPLIED_FEE_TYPICAL"
        ).otherwise(F.col("amount_code")),
    )
    codes = [F.col(c) for c in (*scoring.CHECKS, "uniqueness_code")]
    lifted = lifted.withColumn(
        "earned", F.when(F.col("typical"), scoring.earned(codes, rules)).otherwise(F.col("earned"))
    ).withColumn(
        "score",
        F.when(F.col("typical"), scoring.score(F.col("earned"), F.col("attainable"))).otherwise(F.col("score")),
    )
    again = scoring.band(F.col("score"), F.col("status") == "AMBIGUOUS", scoring.first_gate(codes, rules), rules)
    return lifted.withColumn("status", F.when(F.col("typical"), again).otherwise(F.col("status")))
