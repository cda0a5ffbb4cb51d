"""Exact ranks inside groups of any size, and integer allocation built on them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from saldo.functions.money import WIDE
from saldo.session import materialise

#: Above this many rows a group is ranked by several tasks instead of one.
HOT_ROWS = 1_000_000


def ranked(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    out: str = "rank",
    running: tuple[str, str] | None = None,
    hot_rows: int = HOT_ROWS,
    sizes: DataFrame | None = None,
) -> DataFrame:
    """Add the 1-based rank of each row within ``keys``; ``order`` must leave no ties.

    ``running=(column, out)`` also adds the running sum of a column up to the row. Group sizes are
    measured first, or given as ``sizes`` with a ``count`` column. When a group is too large for one task, rows are range-partitioned on (keys,
    order), each slice is ranked on its own, and the sizes of earlier slices of the same group are
    added. At most one group continues across each slice boundary, so the offsets never number more
    than the partitions.
    """
    sizes = df.groupBy(*keys).count() if sizes is None else sizes
    if sizes.filter(F.col("count") > hot_rows).isEmpty():
        window = Window.partitionBy(*keys).orderBy(*order)
        result = df.withColumn(out, F.row_number().over(window).cast("bigint"))
        if running:
            rows = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
            result = result.withColumn(running[1], F.sum(running[0]).over(rows))
        return result

    by = [F.col(k) for k in keys]
    sliced = df.repartitionByRange(*by, *order).withColumn("__slice", F.spark_partition_id())
    sliced = materialise(sliced, "ranked")  # the slice of a row must not change on a retry
    measures = [F.count(F.lit(1)).alias("__rows")]
    if running:
        measures.append(F.sum(running[0]).alias("__sum"))
    per_slice = sliced.groupBy(*keys, "__slice").agg(*measures)
    earlier = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_slice.withColumn("__offset", F.sum("__rows").over(earlier))
    if running:
        offsets = offsets.withColumn("__sum_before", F.sum("__sum").over(earlier)).drop("__sum")
    offsets = offsets.drop("__rows").filter("__offset is not null")
    window = Window.partitionBy(*keys, "__slice").orderBy(*order)
    result = sliced.join(offsets, [*keys, "__slice"], "left").withColumn(
        out, F.row_number().over(window) + F.coalesce("__offset", F.lit(0))
    )
    if running:
        rows = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        result = result.withColumn(
            running[1], F.sum(running[0]).over(rows) + F.coalesce("__sum_before", F.lit(0))
        ).drop("__sum_before")
    return result.drop("__slice", "__offset")


def allocate(
    df: DataFrame,
    keys: Sequence[str],
    weight: str,
    order: Sequence[Column],
    totals: dict[str, str],
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Split each total of a group over its rows by weight; the parts add up exactly.

    ``totals`` maps a total column (equal on all rows of a group) to the column its shares go to.
    Each row gets the floor of its proportion; the units left go to the largest remainders, ties in
    ``order``. The sign of the total is kept. A group whose weights are all zero gets null shares.
    """
    group = df.groupBy(*keys).agg(
        F.sum(F.col(weight).cast(WIDE)).alias("__weights"),
        F.min(weight).alias("__lowest"),
        F.count(F.lit(1)).alias("count"),
    )
    group = materialise(group, "allocate-groups")
    if not group.filter("__lowest < 0").isEmpty():
        raise ValueError("weights must not be negative")
    if group.filter(F.col("count") > hot_rows).isEmpty():
        return _allocated_in_groups(df, keys, weight, order, totals)
    rows = materialise(df, "allocate")
    parts = rows.join(group.select(*keys, "__weights"), list(keys))
    for n, total in enumerate(totals):
        parts = _products(parts, total, weight, n)
    # the floors fall short of the total by the remainders, summed and divided once
    left = parts.groupBy(*keys).agg(
        *[(F.max(F.abs(F.col(t))) - F.sum(f"__units{n}")).alias(f"__left{n}") for n, t in enumerate(totals)]
    )
    result = parts.join(left, list(keys))
    for n, (total, share) in enumerate(totals.items()):
        by = [F.col(f"__rest{n}").desc(), *order]
        result = ranked(result, keys, by, "__rank", hot_rows=hot_rows, sizes=group)
        result = _shared(result, total, share, n)
    return result.drop("__weights")


def _products(parts: DataFrame, total: str, weight: str, n: int) -> DataFrame:
    """Add each row's whole units of a total and the remainder, from ``__weights``, the sum of its group."""
    divisor = F.when(F.col("__weights") > 0, F.col("__weights"))
    product = (F.abs(F.col(total)).cast(WIDE) * F.col(weight).cast("decimal(19,0)")).cast(WIDE)
    parts = parts.withColumn("__product", product)
    parts = parts.withColumn(f"__rest{n}", (F.col("__product") % divisor).cast(WIDE)).withColumn(
        f"__units{n}", ((F.col("__product") - F.col(f"__rest{n}")) / divisor).cast("bigint")
    )
    return parts.drop("__product")


def _shared(result: DataFrame, total: str, share: str, n: int) -> DataFrame:
    units = F.col(f"__units{n}") + F.when(F.col("__rank") <= F.col(f"__left{n}"), 1).otherwise(0)
    result = result.withColumn(share, F.when(F.col(total) < 0, -units).otherwise(units).cast("bigint"))
    return result.drop(f"__rest{n}", f"__units{n}", f"__left{n}", "__rank")


def _allocated_in_groups(df: DataFrame, keys: Sequence[str], weight: str, order: Sequence[Column], totals: dict[str, str]) -> DataFrame:
    """Groups that fit a task: every sum and rank is a window over one exchange, and nothing is written."""
    group = Window.partitionBy(*keys)
    result = df.withColumn("__weights", F.sum(F.col(weight).cast(WIDE)).over(group))
    for n, (total, share) in enumerate(totals.items()):
        result = _products(result, total, weight, n)
        # the floors fall short of the total by the remainders
        result = result.withColumn(f"__left{n}", F.max(F.abs(F.col(total))).over(group) - F.sum(f"__units{n}").over(group))
        by = group.orderBy(F.col(f"__rest{n}").desc(), *order)
        result = _shared(result.withColumn("__rank", F.row_number().over(by)), total, share, n)
    return result.drop("__weights")
