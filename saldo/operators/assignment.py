"""Scores candidates and decides, over the whole field, which credits settle which batch."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from saldo.config import RuleSet
from saldo.functions import scoring
from saldo.operators import folds
from saldo.session import materialise


def _codes() -> list[Column]:
    return [F.col(c) for c in scoring.CHECKS]


def identity_applies() -> Column:
    """A source that stated no deductions leaves no identity to check."""
    return F.coalesce((F.col("identity_code") != "IDENTITY_BROKEN") | (F.col("deduction_kinds") > 0), F.lit(True))


def scored(candidates: DataFrame, batches: DataFrame, rules: RuleSet) -> DataFrame:
    """Add points, the provisional score, the first gate failed and the first check failed.

    Candidates that know their batch's ``deduction_kinds`` are not joined again.
    """
    known = candidates if "deduction_kinds" in candidates.columns else candidates.join(batches.select("batch_id", "deduction_kinds"), "batch_id")
    return (
        known.withColumn("earned", scoring.earned(_codes(), rules))
        .withColumn("attainable", scoring.attainable(identity_applies(), rules))
        .withColumn("score", scoring.score(F.col("earned"), F.col("attainable")))
        .withColumn("gate", scoring.first_gate(_codes(), rules))
        .withColumn("first_failed", scoring.first_failed(_codes()))
    )


def _rank() -> Column:
    """The total order in which pairs are taken: score, batch, fewer credits, key."""
    return F.struct(
        (-F.col("score")).alias("s"), F.col("batch_id").alias("b"), F.col("n_deposits").alias("n"), F.col("key").alias("k")
    )


def winners(candidates: DataFrame, max_rounds: int | None = None, group: int = folds.GROUP) -> DataFrame:
    """The pairs a serial best-first pass would take.

    Claims never cross accounts. An account with up to ``group`` pairs is walked once, in rank order; larger
    ones are settled in rounds.
    """
    pairs = candidates.filter("n_deposits > 0 and gate is null").select(
        "account_id", _rank().alias("rank"), "batch_id", "key",
        F.array_append(
            F.transform("deposit_ids", lambda d: F.concat(F.lit("d:"), d)), F.concat(F.lit("b:"), "batch_id")
        ).alias("claims"),
    )
    pairs = materialise(pairs, "pairs")
    small, large = folds.by_size(pairs, ["account_id"], group)
    won = materialise(folds.folded(small, ["account_id"], folds.best_first, [pairs.schema["batch_id"], pairs.schema["key"]], ["batch_id", "key", "claims"]), "won")
    return won if large is None else won.unionByName(_in_rounds(large, max_rounds))


def _in_rounds(pairs: DataFrame, max_rounds: int | None) -> DataFrame:
    """The same over pairs of any number.

    A pair is taken when it ranks first on everything it claims: its batch and each of its credits.
    That is the answer of the serial pass, because nothing better can ever take those claims away.
    Whatever touches a claim leaves, and the rest goes round again. The best remaining pair is
    always taken, so the rounds end. Ranks are compared by aggregation, never by sorting a batch's
    or a credit's pairs in one task.
    """
    taken: list[DataFrame] = []
    rounds = 0
    while not pairs.isEmpty():
        if max_rounds is not None and rounds >= max_rounds:
            raise RuntimeError(f"assignment did not settle in {max_rounds} rounds")
        rounds += 1
        claims = pairs.select("account_id", "batch_id", "key", "rank", F.explode("claims").alias("claim"))
        best = claims.groupBy("account_id", "claim").agg(F.min("rank").alias("best"))
        won = (
            claims.join(best, ["account_id", "claim"])
            .groupBy("account_id", "batch_id", "key")
            .agg(F.bool_and(F.col("rank") == F.col("best")).alias("dominant"))
            .filter("dominant")
            .select("account_id", "batch_id", "key")
        )
        won = materialise(won, "won")
        taken.append(won)
        gone = claims.join(won, ["account_id", "batch_id", "key"], "left_semi").select("account_id", "claim")
        touched = (
            claims.join(gone.distinct(), ["account_id", "claim"], "left_semi")
            .select("account_id", "batch_id", "key")
            .distinct()
        )
        pairs = materialise(
            pairs.join(touched, ["account_id", "batch_id", "key"], "left_anti"), "pairs"
        )
    result = taken[0]
    for more in taken[1:]:
        result = result.unionByName(more)
    return result


def _field(candidates: DataFrame, won: DataFrame) -> DataFrame:
    """What a batch's candidates say together, in one pass: how many lost and the best of these, or, where none won, what explains it."""
    seen = candidates.join(won.select("batch_id", F.col("key").alias("won_key")), "batch_id", "left")
    lost, unpaid = F.col("key") != F.col("won_key"), F.col("won_key").isNull()
    first = F.struct("rule", "first_date", "key", *[F.when(F.col(c).isin(*scoring.FAILED), F.col(c)).alias(c) for c in scoring.CHECKS])
    return seen.groupBy("batch_id").agg(
        F.max(F.when(lost, F.col("score"))).alias("runner_up"),
        F.count(F.when(lost, 1)).alias("others"),
        F.count(F.lit(1)).alias("candidates"),
        # the first candidate: scheduled credits by (date, id), then the other rules
        F.min(F.when(unpaid, first)).alias("first"),
        F.min(F.when(unpaid & (F.col("shape_code") == "SETTLEMENT_MERGED"), F.struct("merged_with", "merged_deposit", "merged_rate"))).alias("merged"),
    )


def settle(
    batches: DataFrame, candidates: DataFrame, won: DataFrame, rules: RuleSet
) -> DataFrame:
    """One row per batch: the winner's checks, whether it was contested, and the final score.

    A runner-up counts whether or not it passed the gates and whether or not its credits went to
    another batch. A batch without a winner keeps the failed checks that explain it.
    """
    winner = candidates.join(won, ["account_id", "batch_id", "key"], "left_semi")
    field = materialise(_field(candidates, won), "field")
    others = field.filter("others > 0").select("batch_id", "runner_up", "others")
    settled = (
        winner.join(others, "batch_id", "left")
        .withColumn("others", F.coalesce("others", F.lit(0)))
        .withColumn("runner_up", F.greatest(F.coalesce("runner_up", F.lit(0)), F.lit(0)))
        .withColumn(
            "contested",
            (F.col("others") > 0) & (F.col("score") - F.col("runner_up") <= rules.ambiguity_delta),
        )
        .withColumn(
            "uniqueness_code",
            F.when(F.col("contested"), "COMPETING_CANDIDATE").otherwise("UNIQUE_CANDIDATE"),
        )
        .withColumn("provisional_score", F.col("score"))
    )
    codes = [*_codes(), F.col("uniqueness_code")]
    settled = (
        settled.withColumn("earned", scoring.earned(codes, rules))
        .withColumn("score", scoring.score(F.col("earned"), F.col("attainable")))
        .withColumn("status", scoring.band(F.col("score"), F.col("contested"), F.col("gate"), rules))
        .withColumn("matched", F.lit(True))
        .withColumn("candidates", F.col("others") + 1)
    )

    lost = batches.select("account_id", "batch_id", "deduction_kinds").join(won, "batch_id", "left_anti")
    first = field.select("batch_id", "candidates", "first", "merged")
    unmatched = lost.join(first, "batch_id", "left")
    none = F.col("candidates").isNull()
    is_merged = F.col("merged").isNotNull()
    unmatched = (
        unmatched.withColumn("contested", F.lit(False))
        .withColumn("matched", F.lit(False))
        .withColumn("others", F.lit(0).cast("bigint"))
        .withColumn("runner_up", F.lit(0))
        .withColumn("amount_code", F.col("first.amount_code"))
        .withColumn("date_code", F.when(none, "DATE_OUT_OF_WINDOW").otherwise(F.col("first.date_code")))
        .withColumn("descriptor_code", F.col("first.descriptor_code"))
        .withColumn("identity_code", F.col("first.identity_code"))
        # the merged explanation leads and is not repeated when it is also the first candidate
        .withColumn("shape_code", F.when(is_merged, "SETTLEMENT_MERGED").otherwise(F.col("first.shape_code")))
        .withColumn("first_shape", F.when(is_merged & (F.col("first.shape_code") != "SETTLEMENT_MERGED"), F.col("first.shape_code")))
        .withColumn("multiple_code", F.col("first.multiple_code"))
        .withColumn("merged_with", F.col("merged.merged_with"))
        .withColumn("merged_deposit", F.col("merged.merged_deposit"))
        .withColumn("merged_rate", F.col("merged.merged_rate"))
        .withColumn("candidates", F.coalesce("candidates", F.lit(0).cast("bigint")))
        .withColumn("provisional_score", F.lit(0))
        .withColumn("earned", F.lit(0))
        .withColumn("attainable", scoring.attainable(identity_applies(), rules))
        .withColumn("score", F.lit(0))
        .withColumn("status", F.lit("UNMATCHED"))
    )
    return settled.unionByName(
        unmatched.drop("first", "merged"), allowMissingColumns=True
    )


def alternatives(candidates: DataFrame, settled: DataFrame) -> DataFrame:
    """Every candidate that did not win, its provisional score, and why it lost."""
    result = settled.select("batch_id", F.col("key").alias("won_key"), "contested")
    return (
        candidates.join(result, "batch_id")
        .filter(F.col("won_key").isNull() | (F.col("key") != F.col("won_key")))
        .select(
            "account_id",
            "batch_id",
            "key",
            "deposit_ids",
            "score",
            F.coalesce(
                F.col("first_failed"),
                F.when(F.col("contested"), "COMPETING_CANDIDATE").otherwise("AMOUNT_MISMATCH"),
            ).alias("rejected_because"),
        )
    )
