"""Ledgers, bank credits and journals derived from the given tables.

Purchases become charges of gateway accounts on three channels that state no deductions, two accounts
to a bank account; orders become charges of accounts whose channel states its own. Accounts grow in
number with users and customers, and so do batches and credits. The bank credits are cut from the
batches so that every way of settling occurs, one day of one bank account has a credit of another
channel for each error event, and journal entries are cut from the movements so that every way of
booking occurs.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saldo.config import Channel, Chart, Journal, Policy, Rates, RuleSet
from saldo.functions import calendar as cal
from saldo.functions import ids
from saldo.operators import batches
from saldo.plans.books import Books
from saldo.plans.flow import Flow
from saldo.session import configure, materialise, small_table, unrolled

HOLIDAYS = ["2024-01-01", "2024-01-08", "2024-01-22"]
ZONE = "America/Bogota"

RULES = RuleSet(
    version="v1",
    channels=(
        Channel("alpha", ("ALPHA",), Policy("DAILY", 1, 3, "21:00", ZONE), Rates()),
        Channel("beta", ("BETA",), Policy("WEEKLY", 1, 3, week_ends_on=7), Rates()),
        Channel("gamma", ("GAMMA",), Policy("MONTHLY", 1, 3, month_ends_on=31)),
    ),
)
ORDER_RULES = RuleSet(version="v1", channels=(Channel("delta", ("DELTA",)), Channel("omega", ("OMEGA",))))

CHART = Chart(
    accounts={
        "CHARGE": ("700100", "Other sales"),
        "FEE": ("810200", "Bank charges"),
        "TAX": ("820300", "Input tax"),
        "WITHHOLDING": ("830400", "Tax withheld"),
        "TRANSFER_OUT": ("100500", "Bank account"),
        "TRANSFER_IN": ("100500", "Bank account"),
    },
    journals=tuple(Journal(f"gw:{n}", 48 + n, f"Gateway {n}", "2000010", "2900010") for n in range(10))
    + tuple(Journal(f"ord:{n}", 60 + n, f"Orders {n}", "2000010", "2900010") for n in range(1, 6)),
)
#: The bank's own journals next to the channels' journals its transfers come from.
BANK_CHART = Chart(
    accounts=CHART.accounts,
    journals=tuple(Journal(key, 40 + n, f"Channel {key}", f"200001{n}") for n, key in enumerate(RULES.channel_keys))
    + tuple(Journal(f"bank:{n}", 70 + n, f"Bank {n}", "100500", "100600") for n in range(10)),
)

MOVEMENT_COLUMNS = (
    "id", "account_id", "external_id", "occurred_at", "value_date", "type", "amount_cents", "currency", "counterparty",
    "description", "source", "metadata", "run_id",
)


def _movements(rows: DataFrame, source: str) -> DataFrame:
    """Complete rows (account_id, external_id, occurred_at, value_date, type, amount_cents,
    counterparty, description, locator) to movements."""
    made = ids.movement_id(
        F.lit(source), F.col("external_id"), F.col("value_date"), F.col("amount_cents"), F.col("type"), F.col("locator")
    )
    return (
        rows.withColumn("id", made)
        .withColumn("currency", F.lit("COP"))
        .withColumn("source", F.struct(F.lit(source).alias("source_id"), F.lit(None).cast("string").alias("raw_record_id"), "locator"))
        .withColumn("metadata", F.create_map().cast("map<string,string>"))
        .withColumn("run_id", F.lit(None).cast("string"))
        .select(*MOVEMENT_COLUMNS)
    )


SCOPE_COLUMNS = "account_id string, channel string, bank_account_id string"


#: Users to a group of ten gateway accounts, and customers to a group of five order accounts.
USERS, CUSTOMERS = 75, 1500
#: The day and the bank account with very many credits.
CROWDED = ("2024-01-10", "bank:0")


def gateway_number() -> Column:
    return (F.col("user_id") % 10 + F.floor(F.col("user_id") / USERS) * 10).cast("int")


def bank_of(number: Column) -> Column:
    return F.concat(F.lit("bank:"), (number - number % 2).cast("string"))


def order_number() -> Column:
    return (F.substring("o_orderpriority", 1, 1).cast("int") + F.floor(F.col("o_custkey") / CUSTOMERS) * 10).cast("int")


class Workspace:
    """Everything derived from one directory of tables; stages are built once per workspace."""

    _shared: dict[tuple[str, str], "Workspace"] = {}

    def __init__(self, spark: SparkSession, directory: str):
        self.spark, self.directory = configure(spark), directory.rstrip("/")

    @classmethod
    def of(cls, spark: SparkSession, directory: str) -> "Workspace":
        """The workspace of this session and directory, so queries share the stages they need."""
        key = (spark.sparkContext.applicationId, directory.rstrip("/"))
        if key not in cls._shared:
            cls._shared[key] = cls(spark, directory)
        return cls._shared[key]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.directory}/{name}.parquet")

    # ---- purchases: silent channels

    @cached_property
    def events(self) -> DataFrame:
        return self.table("events").withColumn("ts", F.col("ts").cast("timestamp"))

    @cached_property
    def movements(self) -> DataFrame:
        local = F.from_utc_timestamp("ts", ZONE)
        account = gateway_number()
        rows = self.events.filter("event_type = 'purchase'").select(
            F.concat(F.lit("gw:"), account).alias("account_id"),
            F.concat(F.lit("evt-"), "event_id").alias("external_id"),
            F.col("ts").alias("occurred_at"),
            F.to_date(local).alias("value_date"),
            F.lit("CHARGE").alias("type"),
            (F.round(F.col("value") * 100).cast("bigint") * 1000).alias("amount_cents"),
            F.concat(F.upper(_channel(account)), F.lit(" S.A.S.")).alias("counterparty"),
            F.lit("Pago aprobado").alias("description"),
            F.concat(F.lit("evt="), "event_id").alias("locator"),
        )
        return _movements(rows, "events")

    @cached_property
    def scopes(self) -> DataFrame:
        """Which channel a gateway account is on and which bank account it is paid into."""
        number = F.substring("account_id", 4, 10).cast("int")
        accounts = self.movements.select("account_id").distinct()
        return materialise(accounts.select("account_id", _channel(number).alias("channel"), bank_of(number).alias("bank_account_id")), "scopes")

    @cached_property
    def flow(self) -> Flow:
        """The run over the purchases; its credits are cut from its own batches."""
        def cut(run: Flow) -> DataFrame:
            return materialise(_cut_credits(run.batches, run.calendar, silent=True).unionByName(self._crowd), "bank")

        return Flow(self.movements, cut, self.scopes, RULES, HOLIDAYS)

    @cached_property
    def _crowd(self) -> DataFrame:
        """A credit of a third channel for each error event, all on one day of one bank account."""
        day, account = CROWDED
        rows = self.events.filter("event_type = 'error'").select(
            F.lit(account).alias("account_id"), F.lit(None).cast("string").alias("external_id"),
            F.to_date(F.lit(day)).cast("timestamp").alias("occurred_at"), F.to_date(F.lit(day)).alias("value_date"),
            F.lit("TRANSFER_IN").alias("type"), (F.col("event_id") + 1000).cast("bigint").alias("amount_cents"),
            F.lit("GAMMA PAY").alias("counterparty"), F.lit("PAGO DE PROV GAMMA PAY").alias("description"),
            F.concat(F.lit("gw:0;"), "event_id", F.lit(";9;x")).alias("locator"),
        )
        return _movements(rows, "bank")

    @property
    def bank(self) -> DataFrame:
        return self.flow.bank

    # ---- orders: a channel that states its deductions

    @cached_property
    def order_movements(self) -> DataFrame:
        cents = F.round(F.col("o_totalprice") * 100).cast("bigint")
        fee = F.floor(cents * 3 / 100).cast("bigint")

        def part(kind: str, amount: Column) -> Column:
            return F.struct(F.lit(kind).alias("type"), amount.cast("bigint").alias("amount_cents"))

        returned = (F.col("o_orderstatus") == "P") & (F.col("o_orderkey") % 5 == 0)
        parts = F.array(
            part("CHARGE", cents),
            part("FEE", -fee),
            part("TAX", -F.floor(fee * 19 / 100)),
            part("WITHHOLDING", -F.floor(cents * 15 / 1000)),
            F.when(returned, part("REFUND", -F.floor(cents / 10))),
        )
        day = F.col("o_orderdate").cast("date")
        rows = (
            unrolled(self.table("orders"), parts, "part")
            .select(
                F.concat(F.lit("ord:"), order_number()).alias("account_id"),
                F.concat(F.lit("ord-"), "o_orderkey").alias("external_id"),
                F.col("o_orderdate").cast("timestamp").alias("occurred_at"),
                day.alias("value_date"),
                F.col("part.type").alias("type"),
                F.col("part.amount_cents").alias("amount_cents"),
                F.lit("DELTA S.A.S.").alias("counterparty"),
                F.lit("Orden").alias("description"),
                F.concat(F.lit("ord="), "o_orderkey", F.lit(";"), "part.type").alias("locator"),
            )
        )
        return _movements(rows, "orders")

    @cached_property
    def order_scopes(self) -> DataFrame:
        accounts = self.order_movements.select("account_id").distinct()
        theirs = accounts.select("account_id", F.lit("delta").alias("channel"), F.concat(F.lit("bank:"), "account_id").alias("bank_account_id"))
        # the second channel has an account without movements
        return materialise(theirs.unionByName(small_table(self.spark, [("ord:9", "omega", "bank:ord:9")], SCOPE_COLUMNS)), "order-scopes")

    @cached_property
    def order_flow(self) -> Flow:
        """The run over the orders; its credits are cut from its own batches."""
        def cut(run: Flow) -> DataFrame:
            return materialise(_cut_credits(run.batches, run.calendar, silent=False), "order-bank")

        return Flow(self.order_movements, cut, self.order_scopes, ORDER_RULES, [])

    # ---- journals

    def _journals(self, accounts: DataFrame, prefix: str, first: int, name: str, main: str = "2000010") -> DataFrame:
        """A journal for each account of a kind, numbered from a base; here a journal's key is the account it books."""
        number = F.substring("account_id", len(prefix) + 1, 10).cast("int")
        return accounts.filter(F.col("account_id").startswith(prefix)).select(
            F.col("account_id").alias("journal_key"), (number + first).alias("journal_id"),
            F.concat(F.lit(f"{name} "), number.cast("string")).alias("journal_name"), F.lit(main).alias("main_account"), "account_id",
        )

    @cached_property
    def journal_table(self) -> DataFrame:
        theirs = self._journals(self.scopes, "gw:", 48, "Gateway")
        own = self._journals(self.order_scopes.filter("account_id <> 'ord:9'"), "ord:", 60, "Orders")
        return materialise(theirs.unionByName(own), "journal-table")

    @cached_property
    def _booked(self) -> DataFrame:
        """Entries by event id mod 10; the comments say how each class is booked."""
        k = F.substring("external_id", 5, 20).cast("bigint") % 10
        own = F.concat(F.lit("e"), F.substring("id", 5, 32))
        base = self.movements.select(own.alias("entry_id"), "account_id", "external_id", "amount_cents", k.alias("k"), "value_date")
        upper = F.upper("external_id")
        first = base.filter(~F.col("k").isin(5, 6)).select(  # 6 is booked nowhere
            "entry_id", "account_id",
            F.when(F.col("k").isin(0, 1, 2, 9), upper).alias("ref"),  # these by reference
            F.when(F.col("k") == 4, F.date_add("value_date", 1)).otherwise(F.col("value_date")).alias("date"),  # 4 a day late
            F.when(F.col("k") == 2, "draft").otherwise("posted").alias("state"),
            (F.col("amount_cents") + F.when(F.col("k") == 8, 5000).otherwise(0)).alias("cents"),  # 8 off by 5000
        )
        second = base.filter("k = 9").select(  # 9 booked twice
            F.concat("entry_id", F.lit("d")).alias("entry_id"), "account_id", upper.alias("ref"), F.col("value_date").alias("date"),
            F.lit("posted").alias("state"), F.col("amount_cents").alias("cents"),
        )
        odd = base.filter("k = 5").select(  # 5 only as an odd amount
            F.concat("entry_id", F.lit("x")).alias("entry_id"), "account_id", F.lit(None).cast("string").alias("ref"),
            F.col("value_date").alias("date"), F.lit("posted").alias("state"), (F.col("amount_cents") + 777).alias("cents"),
        )
        return first.unionByName(second).unionByName(odd)

    @cached_property
    def heads(self) -> DataFrame:
        number = F.substring("account_id", 4, 10).cast("int")
        return self._booked.select(
            "entry_id", F.col("account_id").alias("journal_key"), (number + 48).alias("journal_id"),
            F.concat(F.lit("J/"), "entry_id").alias("name"), "ref", "date", "state",
        )

    @cached_property
    def lines(self) -> DataFrame:
        sides = F.array(
            F.struct(F.lit("2000010").alias("account_code"), F.col("cents").alias("amount_cents")),
            F.struct(F.lit("700100").alias("account_code"), (-F.col("cents")).alias("amount_cents")),
        )
        return unrolled(self._booked, sides, "l").select("entry_id", "l.account_code", "l.amount_cents")

    @cached_property
    def books(self) -> Books:
        """With settlement results: deductions are expected on the entries."""
        return Books(
            self.movements, self.heads, self.lines, self.journal_table, self.flow.calendar, CHART, RULES,
            materialise(self.flow.shares, "shares"),
        )

    @cached_property
    def plain_books(self) -> Books:
        """Without settlement results."""
        return Books(self.movements, self.heads, self.lines, self.journal_table, self.flow.calendar, CHART, RULES)

    # ---- journals of the orders: sales of several movements each

    @cached_property
    def _order_sums(self) -> DataFrame:
        """Per order: what its movements add up to, and the parts an entry may show."""

        def part(kind: str) -> Column:
            return F.sum(F.when(F.col("type") == kind, F.col("amount_cents"))).alias(kind)

        grouped = self.order_movements.groupBy("account_id", "external_id", "value_date").agg(
            F.sum("amount_cents").alias("net"), *[part(k) for k in ("CHARGE", "FEE", "TAX", "WITHHOLDING")]
        )
        # heads and lines read them twice each
        return materialise(grouped.withColumn("k", F.substring("external_id", 5, 20).cast("bigint") % 3), "order-sums")

    @cached_property
    def order_heads(self) -> DataFrame:
        """Order number mod 3: 0 booked at gross, 1 booked in full, 2 only in a total on even days."""
        own = self._order_sums.filter("k <> 2").select(
            F.concat(F.lit("s-"), "external_id").alias("entry_id"), "account_id", F.lit(None).cast("string").alias("ref"),
            F.concat(F.lit("Venta ("), "external_id", F.lit(") ")).alias("name"), F.col("value_date").alias("date"),
        )
        day = self._order_totals.select(
            "entry_id", "account_id", F.lit(" ").alias("ref"), F.lit("Ventas del dia").alias("name"), F.col("value_date").alias("date")
        )
        number = F.substring("account_id", 5, 10).cast("int")
        return own.unionByName(day).select(
            "entry_id", F.col("account_id").alias("journal_key"), (number + 60).alias("journal_id"), "name", "ref", "date",
            F.lit("posted").alias("state"),
        )

    @cached_property
    def _order_totals(self) -> DataFrame:
        return (
            self._order_sums.filter("k = 2")
            .groupBy("account_id", "value_date")
            .agg(F.sum("net").alias("net"))
            .filter("day(value_date) % 2 = 0")
            .withColumn("entry_id", F.concat_ws("-", F.lit("t"), "account_id", "value_date"))
        )

    @cached_property
    def order_lines(self) -> DataFrame:
        def line(code: str, amount: Column) -> Column:
            return F.struct(F.lit(code).alias("account_code"), amount.cast("bigint").alias("amount_cents"))

        charge, fee, tax, kept = (F.col(c) for c in ("CHARGE", "FEE", "TAX", "WITHHOLDING"))
        gross = F.array(line("2000010", charge), line("700100", -charge))
        full = F.array(
            line("2000010", charge + fee + tax + kept), line("810200", -fee), line("820300", -tax), line("830400", -kept),
            line("700100", -charge),
        )
        booked = unrolled(self._order_sums.filter("k <> 2"), F.when(F.col("k") == 0, gross).otherwise(full), "l")
        own = booked.select(F.concat(F.lit("s-"), "external_id").alias("entry_id"), "l")
        day = unrolled(self._order_totals, F.array(line("2000010", F.col("net")), line("700100", -F.col("net"))), "l").select("entry_id", "l")
        return own.unionByName(day).select("entry_id", "l.account_code", "l.amount_cents")

    @cached_property
    def order_books(self) -> Books:
        return Books(
            self.order_movements, self.order_heads, self.order_lines, self.journal_table, self.order_flow.calendar, CHART, ORDER_RULES
        )

    # ---- journals of the bank: transfers from the channels

    @cached_property
    def bank_heads(self) -> DataFrame:
        """Half of the credits are booked, as an entry of the same day and amount."""
        return self.bank.filter("amount_cents % 2 = 0").select(
            F.concat(F.lit("b"), F.substring("id", 5, 32)).alias("entry_id"), F.col("account_id").alias("journal_key"),
            (F.substring("account_id", 6, 10).cast("int") + 70).alias("journal_id"), F.lit("BNK").alias("name"),
            F.lit(None).cast("string").alias("ref"), F.col("value_date").alias("date"), F.lit("posted").alias("state"),
        )

    @cached_property
    def bank_lines(self) -> DataFrame:
        return self.bank.filter("amount_cents % 2 = 0").select(
            F.concat(F.lit("b"), F.substring("id", 5, 32)).alias("entry_id"), F.lit("100500").alias("account_code"), "amount_cents"
        )

    @cached_property
    def bank_journals(self) -> DataFrame:
        rows = [(j.key, j.id, j.name, j.main_account, j.key) for j in BANK_CHART.journals[: len(RULES.channel_keys)]]
        channels = small_table(self.spark, rows, "journal_key string, journal_id int, journal_name string, main_account string, account_id string")
        accounts = self.scopes.select(F.col("bank_account_id").alias("account_id")).distinct()
        return materialise(channels.unionByName(self._journals(accounts, "bank:", 70, "Bank", "100500")), "bank-journals")

    @cached_property
    def bank_books(self) -> Books:
        return Books(
            self.bank, self.bank_heads, self.bank_lines, self.bank_journals, self.flow.calendar, BANK_CHART, RULES
        )


#: Ways to split a settlement: into two credits and more.
SPLITS = 5


def _channel(number: Column) -> Column:
    return F.when(number % 3 == 0, "alpha").when(number % 3 == 1, "beta").otherwise("gamma")


def _cut_credits(built: DataFrame, calendar: DataFrame, silent: bool) -> DataFrame:
    """Bank credits by batch ordinal mod 8.

    Silent channels: 0 one credit, 1 split in two to six, 2 missing, 3 a day late, 4 two identical,
    5 a foreign payer, 6 merged with the next batch, 7 paid inside it. Channels that state their
    deductions: the same, but 6 is short by 5000 cents and 7 is one credit.
    """
    # one row per account and due date: a bounded number of days per account
    order = Window.partitionBy("account_id").orderBy("due_date")
    gross = F.col("gross_cents")
    rows = built.withColumn("o", F.row_number().over(order)).withColumn("kind", F.col("o") % 8)
    if silent:
        rate = 430 + 2 * (F.col("o") % 10)
        net = gross - F.floor(gross * rate / 10000).cast("bigint")
    else:
        net = F.col("expected_net_cents")
    rows = (
        rows.withColumn("net", net)
        .withColumn("next_gross", F.lead("gross_cents").over(order))
        .withColumn("next_due", F.lead("due_date").over(order))
    )
    rows = cal.with_business_day_after(rows, calendar, "due_date", F.lit(1), "late_date")
    payer = F.concat(F.upper("channel"), F.lit(" PAY"))
    split = (2 + F.floor(F.col("o") / 8) % SPLITS).cast("bigint")

    def part(n: int) -> Column:
        """The n-th credit of a split: the larger, the later."""
        upto = [F.floor(F.col("net") * k * (k + 1) / (split * (split + 1))).cast("bigint") for k in (n, n - 1)]
        return upto[0] - upto[1]


    def credit(when: Column, day: str, cents: Column, tag: str, party: Column = payer) -> Column:
        body = F.struct(
            F.col(day).alias("value_date"), cents.cast("bigint").alias("amount_cents"), party.alias("counterparty"), F.lit(tag).alias("tag")
        )
        return F.when(when, body)

    kind = F.col("kind")
    both = gross + F.col("next_gross")
    cuts = [
        credit(kind.isin(0, 4) if silent else kind.isin(0, 4, 7), "due_date", F.col("net"), "a"),
        *[credit((kind == 1) & (split >= n), "due_date", part(n), "abcdef"[n - 1]) for n in range(1, SPLITS + 2)],
        credit(kind == 3, "late_date", F.col("net"), "a"),
        credit(kind == 4, "due_date", F.col("net"), "b"),
        credit(kind == 5, "due_date", F.col("net"), "a", F.lit("OTHER PAYER")),
    ]
    if silent:
        cuts.append(
            credit((kind == 6) & F.col("next_gross").isNotNull(), "next_due", both - F.floor(both * 445 / 10000), "m")
        )
    else:
        cuts.append(credit(kind == 6, "due_date", F.col("net") - 5000, "a"))
    cut = unrolled(rows, F.array(*cuts), "c").select("account_id", "bank_account_id", "o", "kind", "c")
    made = cut.select(
        F.col("bank_account_id").alias("account_id"), F.lit(None).cast("string").alias("external_id"),
        F.col("c.value_date").cast("timestamp").alias("occurred_at"), F.col("c.value_date").alias("value_date"),
        F.lit("TRANSFER_IN").alias("type"), F.col("c.amount_cents").alias("amount_cents"),
        F.col("c.counterparty").alias("counterparty"), F.concat(F.lit("PAGO DE PROV "), "c.counterparty").alias("description"),
        F.concat_ws(";", F.col("account_id"), F.col("o").cast("string"), F.col("kind").cast("string"), F.col("c.tag")).alias("locator"),
    )
    return _movements(made, "bank")
