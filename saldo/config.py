"""Versioned configuration: rules, channels, chart of accounts, holidays, descriptors.

Configuration is read once on the driver (it is a few kilobytes by nature) and enters plans as
literals or as small tables that are joined on their key.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from saldo.session import small_table

# The closed vocabulary of evidence codes with the dimension each belongs to.
EVIDENCE_DIMENSIONS = {
    "AMOUNT_EXACT": "AMOUNT",
    "AMOUNT_WITHIN_ROUNDING": "AMOUNT",
    "IMPLIED_FEE_TYPICAL": "AMOUNT",
    "IMPLIED_FEE_IN_BAND": "AMOUNT",
    "AMOUNT_MISMATCH": "AMOUNT",
    "DATE_T1_EXACT": "DATE",
    "DATE_IN_WINDOW": "DATE",
    "DATE_OUT_OF_WINDOW": "DATE",
    "DESCRIPTOR_MATCH": "DESCRIPTOR",
    "DESCRIPTOR_FOREIGN": "DESCRIPTOR",
    "UNIQUE_CANDIDATE": "UNIQUENESS",
    "COMPETING_CANDIDATE": "UNIQUENESS",
    "IDENTITY_HOLDS": "INTEGRITY",
    "IDENTITY_BROKEN": "INTEGRITY",
    "SETTLEMENT_SINGLE_CREDIT": "INTEGRITY",
    "SETTLEMENT_SPLIT": "INTEGRITY",
    "SETTLEMENT_MERGED": "INTEGRITY",
    "SUBSET_SUM_UNIQUE": "AMOUNT",
    "SUBSET_SUM_MULTIPLE": "AMOUNT",
    "UNRESOLVED_COMBINATORIAL": "AMOUNT",
    "MATCHED_BY_REF": "ERP",
    "MATCHED_EXACT": "ERP",
    "MATCHED_AGGREGATED": "ERP",
    "INCOMPLETE_ENTRY": "ERP",
    "DATE_SHIFT": "ERP",
    "AMOUNT_MISMATCH_ERP": "ERP",
    "MISSING_IN_ERP": "ERP",
    "MISSING_IN_LEDGER": "ERP",
    "DUPLICATE_IN_ERP": "ERP",
    "NO_ACCOUNT_MAPPING": "ERP",
    "NO_CONTRA_ACCOUNT": "ERP",
    "BALANCE_CHAIN_OK": "INGESTION",
    "BALANCE_CHAIN_BROKEN": "INGESTION",
    "SUMMARY_TOTALS_OK": "INGESTION",
    "SUMMARY_TOTALS_MISMATCH": "INGESTION",
    "TRANSACTION_EXCLUDED_NOT_APPROVED": "INGESTION",
    "DESCRIPTOR_UNCLASSIFIED": "INGESTION",
    "SOURCE_STALE": "INGESTION",
    "DEDUCTIONS_DERIVED": "AMOUNT",
}

# Movement types, and the three that are deductions.
MOVEMENT_TYPES = (
    "CHARGE", "REFUND", "CHARGEBACK", "FEE", "TAX", "WITHHOLDING", "INTEREST", "TRANSFER_IN", "TRANSFER_OUT", "OTHER",
)
DEDUCTIONS = ("FEE", "TAX", "WITHHOLDING")
BATCHABLE = ("CHARGE", "REFUND", "CHARGEBACK", *DEDUCTIONS)
TRANSFERS = ("TRANSFER_IN", "TRANSFER_OUT")


class ConfigurationError(ValueError):
    """A configuration that would make results wrong or irreproducible."""


@dataclass(frozen=True)
class Policy:
    """How a channel batches its charges and how long it takes to pay them."""

    cadence: str = "DAILY"
    window_from: int = 1
    window_to: int = 3
    cutoff: str | None = None
    cutoff_zone: str | None = None
    week_ends_on: int | None = None
    month_ends_on: int | None = None

    def check(self, owner: str) -> "Policy":
        if self.window_from < 1 or self.window_to < self.window_from:
            raise ConfigurationError(f"{owner}: window {self.window_from} to {self.window_to} holds no business day")
        if self.cadence not in ("DAILY", "WEEKLY", "MONTHLY"):
            raise ConfigurationError(f"{owner}: cadence {self.cadence} is not DAILY, WEEKLY or MONTHLY")
        if self.cadence == "WEEKLY" and self.week_ends_on not in range(1, 8):
            raise ConfigurationError(f"{owner}: week_ends_on is needed, from 1 to 7")
        if self.cadence == "MONTHLY" and self.month_ends_on not in range(1, 32):
            raise ConfigurationError(f"{owner}: month_ends_on is needed, from 1 to 31")
        if self.cutoff is not None:
            self.cutoff_minutes  # noqa: B018 - raises on a malformed time
        return self

    @property
    def cutoff_minutes(self) -> int | None:
        if self.cutoff is None:
            return None
        parts = self.cutoff.split(":")
        if len(parts) != 2 or not all(p.strip().isdigit() for p in parts):
            raise ConfigurationError(f"cutoff {self.cutoff} is no time of the form HH:MM")
        return int(parts[0]) * 60 + int(parts[1])


@dataclass(frozen=True)
class Rates:
    """Exact statutory rates, and the band the total deduction may fall in."""

    vat: tuple[int, int] = (19, 100)
    withholding: tuple[int, int] = (15, 1000)
    band: tuple[float, float] = (0.04, 0.05)
    slack_per_charge: int = 3


@dataclass(frozen=True)
class Channel:
    key: str
    patterns: tuple[str, ...]
    policy: Policy | None = None
    rates: Rates | None = None


@dataclass(frozen=True)
class RuleSet:
    """Every threshold of the matching rubric. The defaults are the shipped numbers."""

    version: str = "v1"
    channels: tuple[Channel, ...] = ()
    window_from: int = 1
    window_to: int = 3
    rounding_cents: int = 10_000
    identity_cents: int = 1
    fee_band: tuple[float, float] = (0.02, 0.08)
    weights: dict[str, int] = field(
        default_factory=lambda: {
            "AMOUNT_EXACT": 50,
            "AMOUNT_WITHIN_ROUNDING": 25,
            "IMPLIED_FEE_TYPICAL": 40,
            "IMPLIED_FEE_IN_BAND": 25,
            "DATE_T1_EXACT": 25,
            "DATE_IN_WINDOW": 15,
            "DESCRIPTOR_MATCH": 15,
            "UNIQUE_CANDIDATE": 10,
            "IDENTITY_HOLDS": 10,
            "SETTLEMENT_SINGLE_CREDIT": 25,
        }
    )
    exclusive: dict[str, tuple[str, ...]] = field(
        default_factory=lambda: {
            "AMOUNT": (
                "AMOUNT_EXACT",
                "IMPLIED_FEE_TYPICAL",
                "AMOUNT_WITHIN_ROUNDING",
                "IMPLIED_FEE_IN_BAND",
            ),
            "DATE": ("DATE_T1_EXACT", "DATE_IN_WINDOW"),
        }
    )
    confirmed: int = 85
    probable: int = 60
    ambiguous: int = 40
    ambiguity_delta: int = 10
    disqualifying: tuple[str, ...] = ("AMOUNT_MISMATCH", "DESCRIPTOR_FOREIGN", "DATE_OUT_OF_WINDOW")
    subset_max_size: int = 60
    subset_max_solutions: int = 5
    subset_tolerance_cents: int = 100
    subset_max_rows: int = 200_000

    def check(self) -> "RuleSet":
        if not self.version:
            raise ConfigurationError("version is empty")
        Policy(window_from=self.window_from, window_to=self.window_to).check("default")
        low, high = self.fee_band
        if low < 0 or high < low:
            raise ConfigurationError("fee_band has to rise from zero or more")
        for channel in self.channels:
            if channel.policy:
                channel.policy.check(channel.key)
        self.attainable  # noqa: B018 - raises when no point can be earned
        return self

    @property
    def attainable(self) -> int:
        """The most any match can earn: one best code per exclusive dimension, all the others once."""
        grouped = {code for codes in self.exclusive.values() for code in codes}
        total = sum(w for code, w in self.weights.items() if code not in grouped)
        for codes in self.exclusive.values():
            total += max([0, *(self.weights.get(code, 0) for code in codes)])
        if total <= 0:
            raise ConfigurationError("no match could earn a point with these weights")
        return total

    @property
    def channel_keys(self) -> tuple[str, ...]:
        return tuple(channel.key for channel in self.channels)

    def channel(self, key: str) -> Channel:
        return next((c for c in self.channels if c.key == key), Channel(key, ()))

    def policy_for(self, key: str) -> Policy:
        """The channel's own policy, else daily with the global window."""
        own = self.channel(key).policy
        return own.check(key) if own else Policy("DAILY", self.window_from, self.window_to)

    def rates_for(self, key: str) -> Rates:
        return self.channel(key).rates or Rates()

    def band_for(self, key: str) -> tuple[float, float]:
        own = self.channel(key).rates
        return own.band if own else self.fee_band

    @property
    def horizon(self) -> int:
        """How many business days ahead any policy of this ruleset looks."""
        return max([self.window_to, *(self.policy_for(k).window_to for k in self.channel_keys)])

    @staticmethod
    def from_json(text: str) -> "RuleSet":
        """Read the published JSON form of a ruleset."""
        raw = json.loads(text)
        channels = []
        for key, body in raw["channels"].items():
            settle, deduct = body.get("settlement"), body.get("deductions")
            policy = rates = None
            if settle:
                cutoff = settle.get("cutoff") or {}
                policy = Policy(
                    settle["cadence"],
                    settle["window"]["fromBusinessDays"],
                    settle["window"]["toBusinessDays"],
                    cutoff.get("time"),
                    cutoff.get("timeZone"),
                    settle.get("weekEndsOn"),
                    settle.get("monthEndsOn"),
                )
            if deduct:
                rates = Rates(
                    (deduct["vat"]["numerator"], deduct["vat"]["denominator"]),
                    (deduct["withholding"]["numerator"], deduct["withholding"]["denominator"]),
                    tuple(deduct["plausibleTotalBand"]),
                    deduct["truncationSlackPerCharge"],
                )
            channels.append(Channel(key, tuple(body["counterpartyPatterns"]), policy, rates))
        window, tolerances = raw["settlementWindow"], raw["tolerances"]
        subset, bands = raw["subsetSum"], raw["bands"]
        return RuleSet(
            version=raw["version"],
            channels=tuple(channels),
            window_from=window["fromBusinessDays"],
            window_to=window["toBusinessDays"],
            rounding_cents=tolerances["roundingCents"],
            identity_cents=tolerances["identityCents"],
            fee_band=tuple(tolerances["impliedFeeRateBand"]),
            weights=dict(raw["weights"]),
            exclusive={k: tuple(v) for k, v in raw["exclusiveDimensions"].items()},
            confirmed=bands["CONFIRMED"],
            probable=bands["PROBABLE"],
            ambiguous=bands["AMBIGUOUS"],
            ambiguity_delta=raw["ambiguityDelta"],
            disqualifying=tuple(raw.get("disqualifying", ())),
            subset_max_size=subset["maxSubsetSize"],
            subset_max_solutions=subset["maxSolutions"],
            subset_tolerance_cents=subset["toleranceCents"],
            subset_max_rows=subset["maxNodes"],
        ).check()

    def with_channels(self, *channels: Channel) -> "RuleSet":
        return replace(self, channels=channels)


CHANNEL_SCHEMA = """
    channel string, channel_ord int, patterns array<string>, cadence string, cutoff string,
    cutoff_minutes int, cutoff_zone string, week_ends_on int, month_ends_on int,
    window_from int, window_to int, vat_num int, vat_den int, wh_num int, wh_den int,
    band_lo double, band_hi double, slack int, own_policy boolean, own_band boolean
"""


def channel_table(spark: SparkSession, rules: RuleSet) -> DataFrame:
    """One row per configured channel, with defaults already resolved."""
    rows = [_channel_row(rules, channel, ordinal) for ordinal, channel in enumerate(rules.channels)]
    return small_table(spark, rows, CHANNEL_SCHEMA)


def _channel_row(rules: RuleSet, channel: Channel, ordinal: int) -> tuple:
    policy, rates = rules.policy_for(channel.key), rules.rates_for(channel.key)
    low, high = rules.band_for(channel.key)
    return (
        channel.key, ordinal, list(channel.patterns), policy.cadence, policy.cutoff,
        policy.cutoff_minutes, policy.cutoff_zone, policy.week_ends_on, policy.month_ends_on,
        policy.window_from, policy.window_to, *rates.vat, *rates.withholding,
        float(low), float(high), rates.slack_per_charge,
        channel.policy is not None, channel.rates is not None,
    )


def channels_in_scope(spark: SparkSession, rules: RuleSet, scopes: DataFrame) -> DataFrame:
    """The configured channels, and with the defaults every other channel that ``scopes`` names."""
    known = channel_table(spark, rules)
    others = scopes.select("channel").filter("channel is not null").distinct().join(known.select("channel"), "channel", "left_anti")
    default = _channel_row(rules, Channel("", ()), len(rules.channels))
    columns = [
        (F.array() if value == [] else F.lit(value)).cast(field.dataType).alias(field.name)
        for field, value in zip(known.schema.fields, default, strict=True)
    ]
    return known.unionByName(others.select("channel", *columns[1:]))


@dataclass(frozen=True)
class Journal:
    key: str
    id: int
    name: str
    main_account: str
    suspense_account: str | None = None


@dataclass(frozen=True)
class Chart:
    """Movement type to account, and the journals entries may be written to."""

    accounts: dict[str, tuple[str, str]]
    journals: tuple[Journal, ...]

    def check(self) -> "Chart":
        if not self.journals:
            raise ConfigurationError("journals is empty")
        return self

    def code(self, movement_type: str) -> str | None:
        found = self.accounts.get(movement_type)
        return found[0] if found else None

    @property
    def account_codes(self) -> list[str]:
        codes = [code for code, _ in self.accounts.values()]
        for journal in self.journals:
            codes += [c for c in (journal.main_account, journal.suspense_account) if c]
        return list(dict.fromkeys(codes))

    @staticmethod
    def from_json(text: str) -> "Chart":
        raw = json.loads(text)
        return Chart(
            {k: (v["code"], v["name"]) for k, v in raw["accounts"].items()},
            tuple(
                Journal(k, v["id"], v["name"], v["mainAccount"], v.get("suspenseAccount"))
                for k, v in raw["journals"].items()
            ),
        ).check()


def journal_table(spark: SparkSession, chart: Chart) -> DataFrame:
    return small_table(
        spark,
        [(j.key, j.id, j.name, j.main_account, j.suspense_account) for j in chart.journals],
        "journal_key string, journal_id int, journal_name string, main_account string, "
        "suspense_account string",
    )


def account_table(spark: SparkSession, chart: Chart) -> DataFrame:
    return small_table(
        spark,
        [(t, code, name) for t, (code, name) in chart.accounts.items()],
        "concept string, account_code string, account_name string",
    )


def holidays_from_json(text: str) -> list[str]:
    """Flatten the per-year holiday lists into dates."""
    raw = json.loads(text)
    return [day["date"] for year in raw["holidays"].values() for day in year]


@dataclass(frozen=True)
class Descriptor:
    """One ordered rule: what a statement line says, not which channel it belongs to."""

    id: str
    type: str
    starts_with: str | None = None
    contains: str | None = None
    counterparty: str | None = None
    after_prefix: str | None = None


# The shipped descriptor prefixes for money a payer sends us.
INFLOW_DESCRIPTORS = (
    Descriptor("supplier-payment-in", "TRANSFER_IN", "PAGO DE PROV ", after_prefix="PAGO DE PROV "),
    Descriptor("third-party-payment-in", "TRANSFER_IN", "PAGO DE TERC ", after_prefix="PAGO DE TERC "),
)


def descriptors_from_json(text: str) -> tuple[Descriptor, ...]:
    return tuple(
        Descriptor(
            r["id"],
            r["type"],
            r["match"].get("startsWith"),
            r["match"].get("contains"),
            r.get("counterparty"),
            (r.get("counterpartyFrom") or {}).get("afterPrefix"),
        )
        for r in json.loads(text)["rules"]
    )
