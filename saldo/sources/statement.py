"""Bank statements: positioned text runs to rows that balance.

Input is a table of text runs ``raw_id, page, seq, x, y, text``. A statement that fails one of its
own control figures contributes nothing, and the report says which row broke it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saldo.config import Descriptor
from saldo.functions import descriptors
from saldo.functions.money import parse_amount
from saldo.session import unrolled
from saldo.sources.gateway import BUSINESS_ZONE, with_ids

# Fixed layout: columns by x, the summary labels, the header patterns, the baseline tolerance.
COLUMNS = {"date": (0, 90), "description": (90, 300), "value": (380, 500), "balance": (500, 620)}
LABELS = {"opening": "SALDO ANTERIOR", "closing": "SALDO ACTUAL", "credits": "TOTAL ABONOS", "debits": "TOTAL CARGOS"}
PERIOD = r"DESDE:\s*(\d{4})/(\d{2})/(\d{2})\s*HASTA:\s*(\d{4})/(\d{2})/(\d{2})"
ACCOUNT = r"N[ÚU]MERO\s+(\d+)"
#: Words with which a period and an account number begin.
BEGINNINGS = ("DESDE:", "NÚMERO", "NUMERO")
AMOUNT_SHAPE = r"^[$\s-]*[\d,]+\.\d{2}$"
BASELINE = 2


def rows(runs: DataFrame) -> DataFrame:
    """Runs near the height of the first run met there are one visual row; rows read down, cells read right.

    A page is physically small, so its few heights are folded together in the order they are met;
    documents of any number of pages spread over tasks. Runs travel once, by page, and a height is placed
    once for all its runs.
    """
    kept = runs.filter((F.trim("text") != "") & F.col("raw_id").isNotNull() & F.col("page").isNotNull()).select(
        "raw_id", "page", "seq", F.floor(F.col("x") + 0.5).cast("int").alias("x"),
        F.floor(F.col("y") + 0.5).cast("int").alias("y"), F.trim("text").alias("text"),
    )
    def near(height: Column):
        return lambda line: F.abs(line - height) <= BASELINE

    level = kept.repartition("raw_id", "page").groupBy("raw_id", "page", "y").agg(
        F.min("seq").alias("met"), F.collect_list(F.struct("x", "seq", "text")).alias("cells")
    )
    pages = level.groupBy("raw_id", "page").agg(F.collect_list(F.struct("met", "y", "cells")).alias("heights"))
    met = F.transform(F.sort_array(F.transform("heights", lambda h: F.struct(h["met"], h["y"]))), lambda h: h["y"])
    lines = F.aggregate(
        met, F.array().cast("array<int>"), lambda found, y: F.when(F.exists(found, near(y)), found).otherwise(F.array_append(found, y))
    )
    pages = pages.select("raw_id", "page", "heights", lines.alias("lines"))
    pages = pages.select("raw_id", "page", "heights", "lines", F.sort_array("lines", asc=False).alias("places"))
    anchored = pages.select(
        "raw_id", "page", "places",
        F.inline(F.transform("heights", lambda h: F.struct(F.get(F.filter("lines", near(h["y"])), F.lit(0)).alias("y"), h["cells"].alias("cells")))),
    )
    place = F.array_position("places", F.col("y")) - 1
    cells = F.sort_array(F.flatten(F.collect_list("cells")))
    return anchored.withColumn("row", place).groupBy("raw_id", "page", "row").agg(
        F.first("y").alias("y"), cells.alias("cells")
    ).withColumn("line", F.array_join(F.transform("cells", lambda c: c["text"]), " "))


def cell(column: str) -> Column:
    """The first cell whose x lies in the column."""
    low, high = COLUMNS[column]
    inside = F.filter("cells", lambda c: (c["x"] >= low) & (c["x"] < high))
    return F.get(inside, F.lit(0))["text"]


def once(df: DataFrame, kept: Sequence[str], **columns: Column) -> DataFrame:
    """Columns that later filters and expressions read instead of computing them again."""
    return unrolled(df, F.array(F.struct(*[c.alias(name) for name, c in columns.items()])), "__once").select(*kept, "__once.*")


def _starts_with(label: str):
    return lambda c: F.startswith(F.upper(c["text"]), F.lit(label))


def headers(all_rows: DataFrame) -> DataFrame:
    """Period, account number and the four control figures of each document.

    A label's figure is the cell to its right, or else an amount in the next row (rows continue
    across pages). Of several the first in reading order counts. Only rows that hold the beginning of
    something asked for are looked at, and only their pages for the rows that follow.
    """
    place = F.struct("page", "row")
    upper = F.upper("line")
    holds = F.lit(False)
    for label in LABELS.values():
        holds = holds | F.contains(upper, F.lit(label))
    for word in BEGINNINGS:
        holds = holds | F.contains("line", F.lit(word))
    page_ends = all_rows.groupBy("raw_id", "page").agg(F.min_by("cells", "row").alias("first_cells"))
    per_doc = Window.partitionBy("raw_id").orderBy("page")  # one row per page
    page_ends = page_ends.withColumn("next_first", F.lead("first_cells").over(per_doc)).drop("first_cells")
    on_page = Window.partitionBy("raw_id", "page").orderBy("row")
    asked = all_rows.filter(holds).select("raw_id", "page").distinct()
    near = all_rows.join(asked, ["raw_id", "page"], "left_semi").withColumn("next_here", F.lead("cells").over(on_page))
    known = near.filter(holds).join(page_ends, ["raw_id", "page"]).withColumn("next_cells", F.coalesce("next_here", "next_first"))
    aggregates = []
    for name, label in LABELS.items():
        starts = F.transform("cells", _starts_with(label))
        at = F.array_position(starts, True)
        beside = F.when(at > 0, F.get("cells", at.cast("int"))["text"])
        below = F.get(F.filter("next_cells", lambda c: c["text"].rlike(AMOUNT_SHAPE)), F.lit(0))["text"]
        value = F.coalesce(beside, F.when(F.contains(F.upper("line"), F.lit(label)), below))
        known = known.withColumn(f"__{name}", value)
        aggregates.append(F.min(F.when(F.col(f"__{name}").isNotNull(), F.struct(place.alias("at"), F.col(f"__{name}").alias("v")))).alias(name))
    period = F.when(F.col("line").rlike(PERIOD), F.struct(place.alias("at"), "line"))
    # the number may stand in the row below its label
    below = F.coalesce(F.array_join(F.transform("next_cells", lambda c: c["text"]), " "), F.lit(""))
    account = F.regexp_extract(F.concat_ws(" ", "line", below), ACCOUNT, 1)
    found = known.groupBy("raw_id").agg(
        F.min(period).alias("period"),
        F.min(F.when(account != "", F.struct(place.alias("at"), account.alias("v")))).alias("account"),
        *aggregates,
    )

    def day(first: int) -> Column:
        parts = [F.regexp_extract("period.line", PERIOD, first + i).cast("int") for i in range(3)]
        return F.when(F.col("period").isNotNull(), _day(*parts, clamp=False))

    # a document without anything asked for has its row all the same
    found = page_ends.filter("raw_id is not null and page is not null").select("raw_id").distinct().join(found, "raw_id", "left")
    result = found.select(
        "raw_id", F.coalesce("account.v", F.lit("")).alias("account_number"), day(1).alias("from_date"), day(4).alias("to_date"),
        *[parse_amount(F.col(name)["v"]).alias(name) for name in LABELS],
    )
    missing = F.array_compact(
        F.array(
            F.when(F.col("from_date").isNull(), "PERIOD"),
            *[F.when(F.col(n)["cents"].isNull(), n.upper()) for n in LABELS],
        )
    )
    return result.select(
        "raw_id", "account_number", "from_date", "to_date",
        *[F.col(n)["cents"].alias(f"{n}_cents") for n in LABELS],
        F.get(missing, F.lit(0)).alias("missing"),
    )


def _day(year: Column, month: Column, day: Column, clamp: bool) -> Column:
    """A date; past the end of the year or month it is the last there if ``clamp``, else null. Never an error."""
    within = F.least(month, F.lit(12)) if clamp else month
    last = F.dayofmonth(F.last_day(F.make_date(year, within, F.lit(1))))
    right = year.isNotNull() & (within.between(1, 12))
    if not clamp:
        return F.when(right, F.when(day.between(1, last), F.make_date(year, within, day)))
    return F.when(right & (day >= 1), F.make_date(year, within, F.least(day, last)))


def entries(all_rows: DataFrame, header_rows: DataFrame) -> DataFrame:
    """Rows with all four columns and a day/month; the year comes from the period."""
    shaped = once(all_rows, ["raw_id", "page", "row", "y"], **{c: cell(c) for c in COLUMNS}).filter(" and ".join(f"{c} is not null" for c in COLUMNS)).filter(F.col("date").rlike(r"^\d{1,2}/\d{2}$"))
    dated = shaped.join(header_rows.select("raw_id", "from_date", "to_date"), "raw_id")
    day, month = F.split("date", "/")[0].cast("int"), F.split("date", "/")[1].cast("int")
    year = F.when(month < F.month("from_date"), F.year("to_date")).otherwise(F.year("from_date"))
    dated = once(dated, dated.columns, paid=parse_amount(F.col("value")), left=parse_amount(F.col("balance")))
    value, balance = F.col("paid"), F.col("left")
    return dated.select(
        "raw_id", "page", "row",
        F.concat(F.lit("page="), "page", F.lit(";y="), "y").alias("locator"),
        _day(year, month, day, clamp=True).alias("value_date"),
        "description", value["cents"].alias("amount_cents"), balance["cents"].alias("balance_cents"),
        F.coalesce(value["error"], balance["error"]).alias("amount_error"),
    )


def chain(entry_rows: DataFrame, header_rows: DataFrame) -> DataFrame:
    """Add ``expected_cents``: the balance printed before, plus this row's amount.

    The previous row is found inside the page; only the first row of a page takes the last balance
    of the page before, which is looked up on one row per page.
    """
    on_page = Window.partitionBy("raw_id", "page").orderBy("row")
    last = entry_rows.groupBy("raw_id", "page").agg(F.max_by("balance_cents", "row").alias("last_balance"))
    per_doc = Window.partitionBy("raw_id").orderBy("page")
    carried = last.withColumn("carried", F.lag("last_balance").over(per_doc)).drop("last_balance")
    opening = header_rows.select("raw_id", "opening_cents")
    rows_with = entry_rows.join(carried, ["raw_id", "page"]).join(opening, "raw_id")
    previous = F.coalesce(F.lag("balance_cents").over(on_page), "carried", "opening_cents")
    return rows_with.withColumn("expected_cents", previous + F.col("amount_cents")).drop("carried", "opening_cents")


def verdicts(all_rows: DataFrame, header_rows: DataFrame, chained: DataFrame, tolerance: int = 0) -> DataFrame:
    """One row per document: accepted, or the first control it fails with where and by how much."""
    at = F.struct("page", "row")
    broken = F.abs(F.col("expected_cents") - F.col("balance_cents")) > tolerance
    checked = chained.groupBy("raw_id").agg(
        F.count(F.lit(1)).alias("entries"),
        F.min(F.when(F.col("amount_error").isNotNull(), F.struct(at.alias("at"), "locator", "amount_error"))).alias("bad_amount"),
        F.min(F.when(F.col("value_date").isNull(), F.struct(at.alias("at"), "locator"))).alias("bad_date"),
        F.min(F.when(broken, F.struct(at.alias("at"), "locator", "expected_cents", "balance_cents"))).alias("break"),
        F.max_by("balance_cents", at).alias("last_balance"),
        F.coalesce(F.sum(F.when(F.col("amount_cents") > 0, F.col("amount_cents"))), F.lit(0)).alias("sum_credits"),
        F.coalesce(F.sum(F.when(F.col("amount_cents") < 0, -F.col("amount_cents"))), F.lit(0)).alias("sum_debits"),
    )
    docs = all_rows.select("raw_id").distinct().join(header_rows, "raw_id", "left").join(checked, "raw_id", "left")
    off_close = F.abs(F.col("last_balance") - F.col("closing_cents")) > tolerance
    off_totals = (F.abs(F.col("sum_credits") - F.col("credits_cents")) > tolerance) | (
        F.abs(F.col("sum_debits") - F.col("debits_cents")) > tolerance
    )

    def fails(code, locator=None, expected=None, observed=None) -> Column:
        return F.struct(
            (F.lit(code) if isinstance(code, str) else code).alias("code"),
            (locator if locator is not None else F.lit(None)).cast("string").alias("locator"),
            (expected if expected is not None else F.lit(None)).cast("bigint").alias("expected_cents"),
            (observed if observed is not None else F.lit(None)).cast("bigint").alias("observed_cents"),
        )

    bad, broke = F.col("bad_amount"), F.col("break")
    reason = (
        F.when(F.col("missing").isNotNull(), fails(F.concat(F.lit("NO_"), "missing")))
        .when(F.col("entries").isNull(), fails("NO_ROWS"))
        .when(F.col("bad_date").isNotNull(), fails("IMPOSSIBLE_DATE", F.col("bad_date.locator")))
        .when(bad.isNotNull(), fails(bad["amount_error"], bad["locator"]))
        .when(broke.isNotNull(), fails("CHAIN_BREAKS", broke["locator"], broke["expected_cents"], broke["balance_cents"]))
        .when(off_close, fails("CHAIN_DOES_NOT_CLOSE", None, F.col("closing_cents"), F.col("last_balance")))
        .when(off_totals, fails("TOTALS_DISAGREE", None, F.col("credits_cents"), F.col("sum_credits")))
    )
    return docs.withColumn("__r", reason).select(
        "raw_id", "account_number", "from_date", "to_date", F.coalesce("entries", F.lit(0)).alias("entries"),
        F.col("__r").isNull().alias("accepted"), F.col("__r.code").alias("rejected_because"), F.col("__r.locator").alias("locator"),
        F.col("__r.expected_cents").alias("expected_cents"), F.col("__r.observed_cents").alias("observed_cents"),
    )


def unclassified(entry_rows: DataFrame, rules: Sequence[Descriptor]) -> DataFrame:
    """Descriptions no rule knows, once per document."""
    return (
        entry_rows.filter(~descriptors.classify(F.col("description"), rules)["recognised"])
        .select("raw_id", "description")
        .distinct()
    )


def movements(
    entry_rows: DataFrame, verdict_rows: DataFrame, account_id: Column, source_id: str,
    rules: Sequence[Descriptor], zone: str = BUSINESS_ZONE,
) -> DataFrame:
    """The rows of accepted documents as movements at local midnight of their day.

    ``account_id`` may use ``account_number``.
    """
    kind = descriptors.classify(F.col("description"), rules)
    good = entry_rows.join(verdict_rows.filter("accepted").select("raw_id", "account_number"), "raw_id")
    made = good.withColumn("kind", kind).select(
        account_id.alias("account_id"),
        F.lit(None).cast("string").alias("external_id"),
        F.to_utc_timestamp(F.col("value_date").cast("timestamp"), zone).alias("occurred_at"),
        "value_date", F.col("kind.type").alias("type"), "amount_cents", F.lit("COP").alias("currency"),
        F.col("kind.counterparty").alias("counterparty"), "description",
        F.struct(F.lit(source_id).alias("source_id"), F.col("raw_id").alias("raw_record_id"), "locator").alias("source"),
        F.create_map(F.lit("rule"), F.col("kind.rule"), F.lit("runningBalance"), F.col("balance_cents").cast("string")).alias("metadata"),
    )
    return with_ids(made)
