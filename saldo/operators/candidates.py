"""Which bank credits could have paid a batch.

All three ways (one credit, several credits, one credit shared with a neighbouring batch) give the
same columns, so that scoring and assignment never ask which rule a candidate came from.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saldo.config import RuleSet
from saldo.functions import calendar as cal
from saldo.functions import parties
from saldo.functions.money import round_half_up
from saldo.operators import subsets
from saldo.session import materialise

SCHEDULED, SPLIT, MERGED = 1, 2, 3

CANDIDATE_COLUMNS = (
    "account_id", "batch_id", "rule", "key", "deposit_ids", "n_deposits", "observed_cents",
    "first_date", "amount_code", "date_code", "descriptor_code", "identity_code", "shape_code",
    "multiple_code", "solutions", "merged_with", "merged_deposit", "merged_rate", "deduction_kinds",
)


def bank_range(movements: DataFrame, start: str, last_day: Column) -> DataFrame:
    """Bank rows from the start of the range to the end of the last window."""
    return movements.filter(
        (F.col("value_date") >= F.to_date(F.lit(start))) & (F.col("value_date") <= last_day)
    )


def credits(bank: DataFrame, rules: RuleSet) -> DataFrame:
    """Money that came in, with the channels its counterparty names."""
    return bank.filter("amount_cents > 0").select(
        F.col("account_id").alias("bank_account_id"),
        F.col("id").alias("deposit_id"),
        "value_date",
        F.col("amount_cents").alias("cents"),
        "counterparty",
        "description",
        parties.owners(F.col("counterparty"), rules).alias("owners"),
    )


#: The payee of a credit that names no channel.
ANYONE = ""


def with_windows(batches: DataFrame, channels: DataFrame, calendar: DataFrame) -> DataFrame:
    rates = ("window_from", "window_to", "band_lo", "band_hi", "vat_num", "vat_den", "wh_num", "wh_den", "slack")
    return cal.with_window(batches.join(channels.select("channel", *rates), "channel"), calendar, "batch_date")


def eligible(windowed: DataFrame, money_in: DataFrame, calendar: DataFrame) -> DataFrame:
    """Batch and credit pairs inside the window that do not name another channel.

    The window is spelled out as days and a credit by the channels it names, or by none, which turns
    the band join into an equi-join on (bank account, day, payee): pairs with another channel's money
    are never built. Credits are joined as rows, so AQE can split a day with very many of them.
    """
    # a batch stands here for each day and payee, and a pair keeps what its batch brings: only what candidates are made of
    slim = windowed.select(
        "account_id", "batch_id", "bank_account_id", "channel", "batch_ord", "window_start", "window_end", "window_from", "window_to",
        "band_lo", "band_hi", "gross_cents", "expected_net_cents", "deductions_cents", "deduction_kinds",
    )
    days = slim.withColumn("value_date", F.explode(F.sequence("window_start", "window_end"))).drop("window_start", "window_end")
    days = days.join(
        calendar.select(F.col("d").alias("value_date"), F.col("ord").alias("deposit_ord")), "value_date"
    )
    days = days.withColumn("payee", F.explode(F.array("channel", F.lit(ANYONE))))
    paid = money_in.withColumn("payee", F.explode(F.when(F.size("owners") > 0, F.col("owners")).otherwise(F.array(F.lit(ANYONE)))))
    pairs = days.join(paid.drop("counterparty", "description", "owners"), ["bank_account_id", "value_date", "payee"])
    return pairs.withColumn("names_channel", F.col("payee") != ANYONE).drop("payee", "channel", "bank_account_id")


def target(rules: RuleSet) -> tuple[Column, Column]:
    """What credits must total, and how far off they may be."""
    stated = F.col("deduction_kinds") > 0
    middle = (F.col("band_lo") + F.col("band_hi")) / 2
    gross = F.col("gross_cents").cast("double")
    cents = F.when(stated, F.col("expected_net_cents")).otherwise(round_half_up(gross * (1 - middle)))
    slack = F.when(stated, F.lit(rules.subset_tolerance_cents)).otherwise(
        round_half_up(gross * (F.col("band_hi") - F.col("band_lo")) / 2)
    )
    return cents, slack


def implied_rate(observed: Column) -> Column:
    gap = (F.col("gross_cents") - observed).cast("double")
    return F.when(F.col("gross_cents") > 0, gap / F.col("gross_cents").cast("double"))


def amount_code(observed: Column, rules: RuleSet) -> Column:
    """From strongest to weakest: exact, rounding, explainable as a fee, not this payment."""
    delta = observed - F.col("expected_net_cents")
    in_band = implied_rate(observed).between(F.col("band_lo"), F.col("band_hi"))
    return (
        F.when(delta == 0, "AMOUNT_EXACT")
        .when(F.abs(delta) <= rules.rounding_cents, "AMOUNT_WITHIN_ROUNDING")
        .when((F.col("deduction_kinds") == 0) & F.coalesce(in_band, F.lit(False)), "IMPLIED_FEE_IN_BAND")
        .otherwise("AMOUNT_MISMATCH")
    )


def date_code(arrival_ord: Column) -> Column:
    gap = arrival_ord - F.col("batch_ord")
    return (
        F.when(gap == F.col("window_from"), "DATE_T1_EXACT")
        .when(gap.between(F.col("window_from"), F.col("window_to")), "DATE_IN_WINDOW")
        .otherwise("DATE_OUT_OF_WINDOW")
    )


def identity_code(rules: RuleSet) -> Column:
    recomposed = F.col("expected_net_cents") + F.col("deductions_cents") - F.col("gross_cents")
    holds = (F.col("deduction_kinds") > 0) & (F.abs(recomposed) <= rules.identity_cents)
    return F.when(holds, "IDENTITY_HOLDS").otherwise("IDENTITY_BROKEN")


def _text() -> Column:
    return F.lit(None).cast("string")


def single(pairs: DataFrame, rules: RuleSet) -> DataFrame:
    """One batch, one credit."""
    return pairs.select(
        "account_id",
        "batch_id",
        F.lit(SCHEDULED).alias("rule"),
        F.col("deposit_id").alias("key"),
        F.array("deposit_id").alias("deposit_ids"),
        F.lit(1).alias("n_deposits"),
        F.col("cents").alias("observed_cents"),
        F.col("value_date").alias("first_date"),
        amount_code(F.col("cents"), rules).alias("amount_code"),
        date_code(F.col("deposit_ord")).alias("date_code"),
        F.when(F.col("names_channel"), "DESCRIPTOR_MATCH").otherwise("DESCRIPTOR_FOREIGN").alias("descriptor_code"),
        identity_code(rules).alias("identity_code"),
        F.lit("SETTLEMENT_SINGLE_CREDIT").alias("shape_code"),
        _text().alias("multiple_code"),
        F.lit(None).cast("bigint").alias("solutions"),
        F.lit(None).cast("date").alias("merged_with"),
        _text().alias("merged_deposit"),
        F.lit(None).cast("double").alias("merged_rate"),
        "deduction_kinds",
    )


def split(pairs: DataFrame, windowed: DataFrame, rules: RuleSet) -> DataFrame:
    """One batch, several credits: the first few subsets that reach the target.

    A search that was stopped without a solution says so with an empty candidate; the solutions of
    one that was stopped later are marked by ``complete``.
    """
    cents, slack = target(rules)
    aimed = pairs.withColumn("target_cents", cents).withColumn("slack_cents", slack)
    found, stopped = subsets.search(
        aimed.select("batch_id", "deposit_id", "value_date", "cents", "target_cents", "slack_cents"), rules
    )
    viable = found.filter(F.size("positions") > 1)
    per_batch = viable.groupBy("batch_id").agg(F.count(F.lit(1)).alias("solutions"))
    parts = (
        viable.select("batch_id", "solution", F.explode("deposits").alias("deposit_id"))
        .join(
            pairs.select("batch_id", "deposit_id", "value_date", "cents", "deposit_ord", "names_channel"),
            ["batch_id", "deposit_id"],
        )
        .groupBy("batch_id", "solution")
        .agg(
            # at most subset_max_size credits by construction
            F.sort_array(F.collect_list(F.struct("value_date", "deposit_id"))).alias("parts"),
            F.sum("cents").alias("observed_cents"),
            F.min("value_date").alias("first_date"),
            F.min("deposit_ord").alias("arrival_ord"),
            F.bool_and("names_channel").alias("all_named"),
        )
        .join(per_batch, "batch_id")
        .join(windowed, "batch_id")
    )
    deposits = F.transform("parts", lambda p: p["deposit_id"])
    solved = parts.select(
        "account_id",
        "batch_id",
        F.lit(SPLIT).alias("rule"),
        F.array_join(F.array_sort(deposits), "+").alias("key"),
        deposits.alias("deposit_ids"),
        F.size("parts").alias("n_deposits"),
        "observed_cents",
        "first_date",
        amount_code(F.col("observed_cents"), rules).alias("amount_code"),
        date_code(F.col("arrival_ord")).alias("date_code"),
        F.when(F.col("all_named"), "DESCRIPTOR_MATCH").otherwise("DESCRIPTOR_FOREIGN").alias("descriptor_code"),
        identity_code(rules).alias("identity_code"),
        F.lit("SETTLEMENT_SPLIT").alias("shape_code"),
        F.when(F.col("solutions") > 1, "SUBSET_SUM_MULTIPLE").alias("multiple_code"),
        "solutions",
        F.lit(None).cast("date").alias("merged_with"),
        _text().alias("merged_deposit"),
        F.lit(None).cast("double").alias("merged_rate"),
        "deduction_kinds",
    )
    given_up = _empty(
        windowed.join(stopped.filter("found = 0").select("batch_id"), "batch_id"),
        SPLIT,
        "UNRESOLVED_COMBINATORIAL",
        F.lit(None).cast("date"),
        _text(),
        F.lit(None).cast("double"),
    )
    return solved.unionByName(given_up)


def _empty(
    rows: DataFrame, rule: int, shape: str, merged_with: Column, deposit: Column, rate: Column
) -> DataFrame:
    """A candidate without credits: it explains, and can never win."""
    return rows.select(
        "account_id",
        "batch_id",
        F.lit(rule).alias("rule"),
        F.lit("").alias("key"),
        F.array().cast("array<string>").alias("deposit_ids"),
        F.lit(0).alias("n_deposits"),
        F.lit(0).cast("bigint").alias("observed_cents"),
        F.lit(None).cast("date").alias("first_date"),
        *[_text().alias(c) for c in ("amount_code", "date_code", "descriptor_code", "identity_code")],
        F.lit(shape).alias("shape_code"),
        _text().alias("multiple_code"),
        F.lit(None).cast("bigint").alias("solutions"),
        merged_with.alias("merged_with"),
        deposit.alias("merged_deposit"),
        rate.alias("merged_rate"),
        "deduction_kinds",
    )


#: Batches this many calendar days apart may have been paid together.
NEIGHBOUR_DAYS = 5
#: Days of a cell of a bank account's calendar, and the distinct credits of a cell that its batches look through one by one.
CELL_DAYS = 28
CELL_CREDITS = 4096
#: Width of an amount bucket on a log scale; a rate band of a few percent touches two or three.
BUCKET = 0.02


def merged(windowed: DataFrame, money_in: DataFrame, cell_credits: int = CELL_CREDITS) -> DataFrame:
    """Two batches, one credit: the pair whose joint rate sits closest to the middle of the band.

    A batch is one row with its few neighbours, spelled out by the cells of its bank account's calendar
    that it can reach, and meets the credits of these; its neighbours are spelled out beside a credit only, so pairs
    of batches never travel. In a cell with more than ``cell_credits`` credits it looks only at credits of the right
    size (a log-scale amount bucket), so a day with very many credits is not multiplied by every batch around it.
    """
    here = windowed.filter("batch_date is not null").select(
        "account_id", "batch_id", "batch_date", "bank_account_id", "channel", "deduction_kinds", "gross_cents", "window_start",
        "window_end", "band_lo", "band_hi",
    )
    # one row per account and due date: a frame holds a bounded number of days
    around = Window.partitionBy("account_id").orderBy(F.unix_date("batch_date")).rangeBetween(-NEIGHBOUR_DAYS, NEIGHBOUR_DAYS)
    near = here.withColumn(
        "near",
        F.collect_list(F.struct("batch_id", "batch_date", "gross_cents", "window_start", "window_end")).over(around),
    )
    near = near.withColumn("near", F.filter("near", lambda n: n["batch_id"] != F.col("batch_id"))).filter(F.size("near") > 0)
    starts = F.array_append(F.col("near")["window_start"], F.col("window_start"))
    ends = F.array_append(F.col("near")["window_end"], F.col("window_end"))
    reach = near.select(
        "account_id", "batch_id", "bank_account_id", "channel", "deduction_kinds", "gross_cents", "band_lo", "band_hi",
        F.col("near")["batch_date"].alias("other_dates"), F.col("near")["gross_cents"].alias("others"),
        starts.alias("starts"), ends.alias("ends"), F.array_min(starts).alias("first"), F.array_max(ends).alias("last"),
        (F.col("gross_cents") + F.array_min(F.col("near")["gross_cents"])).alias("least"),
        (F.col("gross_cents") + F.array_max(F.col("near")["gross_cents"])).alias("most"),
    )
    reach = reach.withColumn("cell", F.explode(F.sequence(_cell(F.col("first")), _cell(F.col("last")))))
    credits = money_in.select("bank_account_id", "value_date", "cents", "owners", "deposit_id", _cell(F.col("value_date")).alias("cell"))
    key = ["bank_account_id", "cell"]
    crowded = credits.groupBy(*key).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > cell_credits).select(*key)
    crowded = materialise(crowded, "crowded-cells")
    if crowded.isEmpty():
        met = reach.join(credits, key)
    else:
        # equal credits of a day explain equally well: only the first id of them can be the best
        sized = credits.join(crowded, key, "left_semi").groupBy(*key, "value_date", "cents", "owners").agg(F.min("deposit_id").alias("deposit_id"))
        sized = sized.withColumn("bucket", F.floor(F.log(F.col("cents").cast("double")) / BUCKET).cast("int"))
        looked = reach.join(crowded, key, "left_semi").withColumn("bucket", F.explode(_buckets()))
        met = reach.join(crowded, key, "left_anti").join(credits, key)
        met = met.unionByName(looked.join(sized, [*key, "bucket"]).drop("bucket"))
    # cheap tests first: a cent of slack keeps them a superset; the exact tests follow. A test that may be null would be
    # asked of the batches beforehand, where each of its arrays is built once more
    paid = F.col("cents").cast("double")
    met = met.filter(
        F.coalesce(F.col("value_date").between(F.col("first"), F.col("last")), F.lit(False))
        & F.coalesce(paid >= F.greatest("least", F.lit(0)).cast("double") * (1 - F.col("band_hi")) - 1, F.lit(False))
        & F.coalesce(paid <= F.col("most").cast("double") * (1 - F.col("band_lo")) + 1, F.lit(False))
        & ~parties.is_foreign(F.col("owners"), F.col("channel"))
    )
    slim = ("account_id", "batch_id", "deduction_kinds", "gross_cents", "band_lo", "band_hi", "value_date", "cents", "deposit_id")
    pairs = met.select(*slim, "starts", "ends", F.inline(F.arrays_zip("other_dates", "others")).alias("other_date", "other_gross"))
    combined = F.col("gross_cents") + F.col("other_gross")
    middle = (F.col("band_lo") + F.col("band_hi")) / 2
    inside = F.exists(F.arrays_zip("starts", "ends"), lambda w: F.col("value_date").between(w["starts"], w["ends"]))
    fits = (
        pairs.filter(combined > 0)
        .withColumn("rate", 1 - F.try_divide(F.col("cents").cast("double"), combined.cast("double")))
        # only a joint rate inside the band asks for the days, else Spark would ask for them in the join
        .filter(F.when(F.col("rate").between(F.col("band_lo"), F.col("band_hi")), inside).otherwise(F.lit(False)))
    )
    best = fits.groupBy("account_id", "batch_id", "deduction_kinds").agg(
        F.min(
            F.struct(
                F.abs(F.col("rate") - middle).alias("off"), "value_date", "deposit_id", "other_date", "rate"
            )
        ).alias("best")
    )
    return _empty(
        best, MERGED, "SETTLEMENT_MERGED", F.col("best.other_date"), F.col("best.deposit_id"), F.col("best.rate")
    )


def _buckets() -> Column:
    """The amount buckets of the credits that could pay a batch together with one of its neighbours."""
    def of(other: Column) -> Column:
        combined = (F.col("gross_cents") + other).cast("double")
        # a cent of slack on both ends keeps the buckets a superset; the exact test follows
        low = F.greatest(combined * (1 - F.col("band_hi")) - 1, F.lit(1.0))
        high = F.greatest(combined * (1 - F.col("band_lo")) + 1, F.lit(1.0))
        return F.sequence(F.floor(F.log(low) / BUCKET).cast("int"), F.floor(F.log(high) / BUCKET).cast("int"))

    # a pair that adds up to nothing or less has no payment
    some = F.filter("others", lambda other: F.col("gross_cents") + other > 0)
    return F.array_distinct(F.flatten(F.transform(some, of)))


def _cell(day: Column) -> Column:
    return F.floor(F.unix_date(day) / CELL_DAYS).cast("int")


def dedupe(candidates: DataFrame) -> DataFrame:
    """One candidate per batch and set of credits; the earlier rule keeps it."""
    # a key occurs at most once per rule and batch, so these partitions hold a few rows at most
    order = Window.partitionBy("batch_id", "key").orderBy("rule")
    return (
        candidates.withColumn("__n", F.row_number().over(order)).filter("__n = 1").drop("__n")
    )


def generate(
    windowed: DataFrame, money_in: DataFrame, calendar: DataFrame, rules: RuleSet
) -> tuple[DataFrame, DataFrame]:
    """All candidates of all rules, and the eligible pairs they came from."""
    pairs = materialise(eligible(windowed, money_in, calendar), "eligible")
    splits = split(pairs, windowed, rules)
    # a single credit and a split of two or more have different keys: only explanations without credits can meet
    keyless = dedupe(splits.filter("n_deposits = 0").unionByName(merged(windowed, money_in)))
    return single(pairs, rules).unionByName(splits.filter("n_deposits > 0")).unionByName(keyless), pairs
