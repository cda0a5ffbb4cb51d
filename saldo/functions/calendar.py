"""Business days and settlement policies.

A calendar is a table of days. Each row holds the running number of business days up to it and the
next few business days, so "the n-th business day after d" is one equi-join on d. Its size depends
on the span of years only.
"""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, timedelta

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

FIRST_DAY, LAST_DAY = "1990-01-01", "2039-12-31"
#: What a calendar adds before the first and after the last movement.
ROOM = timedelta(days=120)


def calendar_table(
    spark: SparkSession,
    holidays: Iterable[str],
    horizon: int = 5,
    first: str = FIRST_DAY,
    last: str = LAST_DAY,
) -> DataFrame:
    """Columns ``d, is_business, ord, ahead``; ``ahead[n-1]`` is the n-th business day after d."""
    if horizon < 1:
        raise ValueError("a business-day count starts at 1")
    span = (date.fromisoformat(last) - date.fromisoformat(first)).days + 1
    days = spark.range(0, span, 1, 1).select(
        F.date_add(F.to_date(F.lit(first)), F.col("id").cast("int")).alias("d")
    )
    closed = [F.to_date(F.lit(h)) for h in sorted(set(holidays))]
    weekday = F.weekday("d") < 5
    is_business = weekday & ~F.col("d").isin(closed) if closed else weekday
    # one row per calendar day, some thousands in all: a single ordered pass is the right plan
    numbered = days.withColumn("is_business", is_business).withColumn(
        "ord", F.sum(F.col("is_business").cast("int")).over(Window.orderBy("d"))
    )
    # the next business days of a day are those its count of business days points at
    ahead = [
        numbered.filter("is_business").select((F.col("ord") - n).alias("ord"), F.col("d").alias(f"n{n}"))
        for n in range(1, horizon + 1)
    ]
    following = ahead[0]
    for column in ahead[1:]:
        following = following.join(column, "ord", "left")
    listed = F.array_compact(F.array(*[F.col(f"n{n}") for n in range(1, horizon + 1)]))
    return numbered.join(following, "ord", "left").select("d", "is_business", "ord", listed.alias("ahead"))


def days_of(movements: DataFrame) -> tuple[str, str]:
    """First and last day of a calendar over movements: theirs, with room for a month's close and for windows and shifts.

    Never less than the usual span, so that the days between two dates can be counted without movements.
    """
    lowest, highest = movements.agg(
        F.min(F.least("value_date", F.to_date("occurred_at"))), F.max(F.greatest("value_date", F.to_date("occurred_at")))
    ).first()
    first, last = date.fromisoformat(FIRST_DAY), date.fromisoformat(LAST_DAY)
    if lowest is not None:
        first, last = min(first, lowest - ROOM), max(last, highest + ROOM)
    return first.isoformat(), last.isoformat()


def covered(day: Column, found: Column, value: Column) -> Column:
    """``value``, or an error where a day has no row in the calendar: no movement may drop out for its date."""
    lost = F.concat(F.lit("the calendar does not reach "), day.cast("string"))
    return F.when(day.isNotNull() & found.isNull(), F.raise_error(lost)).otherwise(value)


def with_business_day_after(
    df: DataFrame, calendar: DataFrame, day: str, n: Column, out: str
) -> DataFrame:
    """Add ``out``: the n-th business day strictly after ``day``."""
    ahead = calendar.select(F.col("d").alias("__d"), F.col("ahead").alias("__ahead"))
    checked = F.when(n < 1, F.raise_error(F.lit("a business-day count starts at 1"))).otherwise(n)
    return (
        df.join(ahead, df[day] == F.col("__d"), "left")
        .withColumn(out, covered(F.col(day), F.get("__ahead", checked - 1), F.get("__ahead", checked - 1)))
        .drop("__d", "__ahead")
    )


def with_window(df: DataFrame, calendar: DataFrame, day: str) -> DataFrame:
    """Add ``window_start`` and ``window_end``, both inclusive, from ``window_from``/``window_to``."""
    ahead = calendar.select(
        F.col("d").alias("__d"), F.col("ahead").alias("__ahead"), F.col("ord").alias("batch_ord")
    )
    return (
        df.join(ahead, df[day] == F.col("__d"), "left")
        .withColumn("window_start", F.get("__ahead", F.col("window_from") - 1))
        .withColumn("__end", F.get("__ahead", F.col("window_to") - 1))
        .withColumn("window_end", covered(F.col(day), F.col("__end"), F.col("__end")))
        .drop("__end")
        .drop("__d", "__ahead")
    )


def days_between(from_ord: Column, to_ord: Column, from_day: Column, to_day: Column) -> Column:
    """Business days in (from, to]; -1 when ``to`` lies before ``from``."""
    return F.when(to_day < from_day, F.lit(-1)).otherwise(to_ord - from_ord)


def local_time(instant: Column, zone: Column | str) -> Column:
    return F.from_utc_timestamp(instant, zone)


def accrual_date(
    occurred_at: Column, value_date: Column, cutoff_minutes: Column, cutoff_zone: Column
) -> Column:
    """With a cutoff, a charge at or after it belongs to the next local day."""
    local = F.from_utc_timestamp(occurred_at, F.coalesce(cutoff_zone, F.lit("UTC")))
    past = F.hour(local) * 60 + F.minute(local) >= cutoff_minutes
    day = F.to_date(local)
    return F.when(cutoff_minutes.isNull(), value_date).otherwise(
        F.when(past, F.date_add(day, 1)).otherwise(day)
    )


def close_date(day: Column, cadence: Column, week_ends_on: Column, month_ends_on: Column) -> Column:
    """The day the period holding ``day`` closes."""
    ahead = F.pmod(week_ends_on - (F.weekday(day) + 1) + 7, F.lit(7))

    def month_close(first: Column) -> Column:
        target = F.least(month_ends_on, F.dayofmonth(F.last_day(first)))
        return F.date_add(first, target - 1)

    this_month = F.trunc(day, "MM")
    this_close = month_close(this_month)
    monthly = F.when(day <= this_close, this_close).otherwise(
        month_close(F.add_months(this_month, 1))
    )
    return F.when(cadence == "WEEKLY", F.date_add(day, ahead.cast("int"))).when(
        cadence == "MONTHLY", monthly
    ).otherwise(day)


# The words a cadence is described with.
WEEKDAYS = ["lunes", "martes", "miércoles", "jueves", "viernes", "sábado", "domingo"]


def describe_cadence(cadence: Column, week_ends_on: Column, month_ends_on: Column) -> Column:
    names = F.array(*[F.lit(day) for day in WEEKDAYS])
    return (
        F.when(cadence == "WEEKLY", F.concat(F.lit("corte semanal (cierra "), F.get(names, week_ends_on - 1), F.lit(")")))
        .when(cadence == "MONTHLY", F.concat(F.lit("corte mensual (cierra el día "), month_ends_on.cast("string"), F.lit(")")))
        .otherwise("corte diario")
    )
