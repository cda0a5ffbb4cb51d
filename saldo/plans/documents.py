"""Landed pages, uploads, statements and exports, derived from the given tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saldo.functions.money import from_major
from saldo.plans.fixtures import CUSTOMERS, Workspace
from saldo.sources import gateway, inbox, statement
from saldo.session import materialise, unrolled

PAGE_SIZE = 200


class Documents:
    """Documents of one workspace in the form a source lands them."""

    def __init__(self, workspace: Workspace):
        self.w = workspace

    # ---- gateway pages

    @cached_property
    def page_texts(self) -> DataFrame:
        """Purchases are approved, errors declined; 200 transactions to a page of JSON text.

        Every fifth page is damaged: by turns of no known layout, and of the known one without a list.
        """
        iso = "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"
        tx = F.struct(
            F.concat(F.lit("tx-"), "event_id").alias("id"),
            F.concat(F.lit("evt-"), "event_id").alias("reference"),
            (F.round(F.col("value") * 100).cast("bigint") * 1000).alias("amount_in_cents"),
            F.lit("COP").alias("currency"),
            F.when(F.col("event_type") == "purchase", "APPROVED").when(F.col("event_id") % 7 == 3, None).when(F.col("event_id") % 2 == 0, "DECLINED").otherwise("VOIDED").alias("status"),
            F.date_format("ts", iso).alias("created_at"),
            F.when(F.col("event_id") % 4 != 0, F.date_format(F.col("ts") + F.expr("interval 1 hour"), iso)).alias("finalized_at"),
            F.when(F.col("user_id") % 3 == 0, "CARD").when(F.col("user_id") % 3 == 1, "PSE").alias("payment_method_type"),
        )
        pages = (
            self.w.events.filter(F.col("event_type").isin("purchase", "error"))
            .withColumn("page", F.floor(F.col("event_id") / PAGE_SIZE).cast("int"))
            .groupBy("page")
            .agg(F.sort_array(F.collect_list(tx)).alias("data"))  # at most 200 by construction
        )
        meta = F.struct("page", F.lit(PAGE_SIZE).alias("page_size"), F.size("data").alias("total_results"))
        text = F.to_json(F.struct("data", meta.alias("meta")))
        unknown = F.replace(text, F.lit('{"data"'), F.lit('{"rows"'))
        damaged = F.when(F.col("page") % 10 == 4, unknown).otherwise(F.replace(text, F.lit('{"data":['), F.lit('{"data":3,"rows":[')))
        return pages.select(
            "page", F.when(F.col("page") % 5 == 4, damaged).otherwise(text).alias("payload"),
            F.concat(F.lit("page="), "page").alias("origin"),
        )

    @cached_property
    def raw_pages(self) -> DataFrame:
        return gateway.as_raw(self.page_texts, "gateway")

    @cached_property
    def decoded(self) -> DataFrame:
        """The pages that route to the gateway's parser; nothing else is decoded."""
        routed = inbox.route(F.encode("payload", "UTF-8")) == "gateway-transactions"
        return gateway.decoded(self.raw_pages.filter(F.coalesce(routed, F.lit(False))))

    @cached_property
    def transactions(self) -> DataFrame:
        return gateway.transactions(self.decoded)

    @cached_property
    def charges(self) -> DataFrame:
        return gateway.charges(self.transactions, "gateway:main", "GATEWAY S.A.S.")

    # ---- statements

    @cached_property
    def _statement_moves(self) -> DataFrame:
        """One statement per order priority, month and group of customers."""
        cents = from_major(F.col("o_totalprice"))
        priority = F.substring("o_orderpriority", 1, 1)
        month = F.date_format("o_orderdate", "yyyy-MM")
        return self.w.table("orders").select(
            F.concat_ws(":", F.lit("stm"), priority, month, F.floor(F.col("o_custkey") / CUSTOMERS).cast("string")).alias("raw_id"),
            F.col("o_orderdate").cast("date").alias("day"),
            F.col("o_orderkey").alias("k"),
            F.when(F.col("o_orderstatus") == "P", -cents).otherwise(cents).alias("cents"),
            F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("PAGO DE PROV CLIENTE "), "o_custkey"))
            .when(F.col("o_orderkey") % 3 == 1, F.lit("CUOTA DE MANEJO"))
            .otherwise(F.lit("pago de terc DELTA PAY")).alias("description"),
        )

    @cached_property
    def statement_lines(self) -> DataFrame:
        """The balance runs over a statement's rows."""
        rows = self._statement_moves
        w = Window.partitionBy("raw_id").orderBy("day", "k")
        n = F.row_number().over(w)
        sums = Window.partitionBy("raw_id").orderBy("day", "k").rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn("n", n).withColumn("balance", F.sum("cents").over(sums) + OPENING)

    @cached_property
    def text_runs(self) -> DataFrame:
        """The statements as positioned text runs, 20 movements to a page.

        Documents of February break their chain by one cent, those of March print no closing balance,
        those of April print a wrong total of credits, those of May print a label above its figure.
        """
        lines = self.statement_lines
        month = F.substring("raw_id", 12, 2)
        # the last balance is the sum of all rows, whatever their order
        totals = self._statement_moves.groupBy("raw_id").agg(
            (F.sum("cents") + OPENING).alias("closing"),
            F.sum(F.when(F.col("cents") > 0, F.col("cents")).otherwise(0)).alias("credits"),
            F.sum(F.when(F.col("cents") < 0, -F.col("cents")).otherwise(0)).alias("debits"),
        )
        year, mm = F.substring("raw_id", 7, 4), month

        def run(seq: int, y: float, x: float, text: Column) -> Column:
            return F.struct(F.lit(0).alias("page"), F.lit(seq).alias("seq"), F.lit(float(x)).alias("x"), F.lit(float(y)).alias("y"), text.alias("text"))

        last = F.date_format(F.last_day(F.to_date(F.concat(year, F.lit("-"), mm, F.lit("-01")))), "dd")
        period = F.concat(F.lit("DESDE: "), year, F.lit("/"), mm, F.lit("/01 HASTA: "), year, F.lit("/"), mm, F.lit("/"), last)
        wrong = F.when(mm == "04", 100).otherwise(0)
        header = F.array(
            run(1, 800.2, 40, period),
            run(2, 780.0, 40, F.lit("NÚMERO")), run(3, 780.9, 120, F.concat(F.lit("9990"), F.substring("raw_id", 5, 1))),
            run(4, 760.0, 40, F.lit("SALDO ANTERIOR")), run(5, 760.0, 200, F.concat(F.lit("$"), _text(F.lit(OPENING)))),
            F.when(mm != "03", run(6, 740.0, 40, F.lit("SALDO ACTUAL"))),
            F.when(mm != "03", run(7, 740.4, 200, _text(F.col("closing")))),
            F.when(mm != "05", run(8, 720.0, 40, F.lit("TOTAL ABONOS"))),
            F.when(mm != "05", run(9, 720.0, 200, _text(F.col("credits") + wrong))),
            F.when(mm == "05", run(8, 720.0, 40, F.lit("Ver TOTAL ABONOS"))),
            F.when(mm == "05", run(9, 710.0, 200, _text(F.col("credits")))),
            run(10, 700.0, 40, F.lit("TOTAL CARGOS")), run(11, 700.0, 200, _text(F.col("debits"))),
            run(12, 680.0, 40, F.lit("   ")),
        )
        head = unrolled(totals, header, "r").select("raw_id", "r.*")
        page = (F.floor((F.col("n") - 1) / 20) + 1).cast("int")
        slot = ((F.col("n") - 1) % 20).cast("int")
        y = F.lit(700.0) - slot * 12
        broken = F.when((month == "02") & (F.col("n") == 2), 1).otherwise(0)

        def cell(offset: int, x: float, up: float, text: Column) -> Column:
            return F.struct(
                page.alias("page"), (slot * 4 + offset).alias("seq"), F.lit(float(x)).alias("x"), (y + up).alias("y"), text.alias("text")
            )

        cells = F.array(
            cell(1, 40, 0.0, F.concat(F.dayofmonth("day").cast("string"), F.lit("/"), month)),
            cell(2, 110, 0.4, F.col("description")),
            cell(3, 420, -0.4, F.when(F.col("cents") < 0, F.concat(_text(-F.col("cents")), F.lit("-"))).otherwise(_text(F.col("cents")))),
            cell(4, 540, 0.0, _signed_text(F.col("balance") + broken)),
        )
        body = unrolled(lines, cells, "r").select("raw_id", "r.*")
        return head.unionByName(body)

    @cached_property
    def statement_rows(self) -> DataFrame:
        return materialise(statement.rows(self.text_runs), "statement-rows")

    @cached_property
    def statement_headers(self) -> DataFrame:
        return materialise(statement.headers(self.statement_rows), "statement-headers")

    @cached_property
    def statement_entries(self) -> DataFrame:
        return materialise(
            statement.entries(self.statement_rows, self.statement_headers), "statement-entries"
        )

    @cached_property
    def statement_chain(self) -> DataFrame:
        return statement.chain(self.statement_entries, self.statement_headers)

    @cached_property
    def statement_verdicts(self) -> DataFrame:
        return statement.verdicts(self.statement_rows, self.statement_headers, self.statement_chain)


OPENING = 1_000_000_000


def _text(cents: Column) -> Column:
    """``1,234.56`` for a non-negative amount, from its digits."""
    digits = F.lpad(cents.cast("string"), 20, "0")
    plain = F.format_number(F.substring(digits, 1, 18).try_cast("bigint"), 0)
    major = F.regexp_replace(F.substring(digits, 1, 18), "^0+(?=.)", "")
    grouped = F.when(cents >= 0, plain).otherwise(F.regexp_replace(major, r"\B(?=(\d{3})+(?!\d))", ","))
    return F.concat(grouped, F.lit("."), F.substring(digits, 19, 2))


def _signed_text(cents: Column) -> Column:
    return F.when(cents < 0, F.concat(F.lit("-"), _text(-cents))).otherwise(_text(cents))
