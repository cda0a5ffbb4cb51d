"""Serial choices inside groups that fit into one task, groups side by side.

A group of up to ``GROUP`` rows is one row with an ordered array, folded once in an Arrow task. Larger
groups stay with the callers, which settle them in rounds over tables.
"""

from __future__ import annotations

import heapq
import itertools
import sys
from collections.abc import Callable, Iterable, Iterator, Sequence

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Rows of a group that is folded in one piece.
GROUP = 50_000

# The folds travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def by_size(df: DataFrame, keys: Sequence[str], most: int) -> tuple[DataFrame, DataFrame | None]:
    """The rows of groups of up to ``most`` rows, and those of larger ones, if there are any."""
    large = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > most).drop("__n")
    if large.isEmpty():
        return df, None
    return df.join(large, list(keys), "left_anti"), df.join(large, list(keys), "left_semi")


def folded(df: DataFrame, keys: Sequence[str], fold: Callable[[list[dict]], Iterable[tuple]], fields: Sequence[T.StructField], read: Sequence[str] = ()) -> DataFrame:
    """``fold`` over each group's rows, sorted by their columns in order: its tuples, behind the group's keys.

    ``read`` names the columns that the fold looks at, if the others only sort.
    """
    others = [c for c in df.columns if c not in keys]
    names = list(read) or others
    grouped = df.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*others))).alias("__rows"))
    schema = T.StructType([*[df.schema[k] for k in keys], *fields])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made: list[tuple] = []
            listed = batch.column("__rows")
            rows = listed.flatten()
            parts = zip(*[rows.field(n).to_pylist() for n in names], strict=True)
            heads = zip(*[batch.column(k).to_pylist() for k in keys], strict=True)
            for head, size in zip(heads, listed.value_lengths().to_pylist(), strict=True):
                group = [dict(zip(names, part, strict=True)) for part in itertools.islice(parts, size)]
                made.extend(head + found for found in fold(group))
            columns = zip(*made, strict=True) if made else [[]] * len(arrow)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, arrow, strict=True)], schema=arrow)

    return grouped.mapInArrow(run, schema)


def best_first(rows: list[dict]) -> Iterator[tuple]:
    """Rows in rank order, each taken if all it claims is free: (batch_id, key)."""
    gone: set[str] = set()
    for row in rows:
        if gone.isdisjoint(row["claims"]):
            gone.update(row["claims"])
            yield row["batch_id"], row["key"]


def nearest_pairs(rows: list[dict]) -> Iterator[tuple]:
    """Groups and entries of a day, the closest pair first, then by group, then by entry: (group_key, entry_id).

    Equal amounts on a side are one class with its members in order. The closest pair lies side by side
    on the line of amounts, so a heap of neighbours is enough; a class that runs out joins its neighbours.
    """
    classes: list[list] = []  # amount, side, names, how many are used
    for row in rows:
        side, name = ("g", row["group_key"]) if row["group_key"] is not None else ("e", row["entry_id"])
        if classes and classes[-1][0] == row["cents"] and classes[-1][1] == side:
            classes[-1][2].append(name)
        else:
            classes.append([row["cents"], side, [name], 0])
    after = list(range(1, len(classes) + 1))
    before = list(range(-1, len(classes) - 1))
    heap: list[tuple] = []

    def meet(left: int, right: int) -> None:
        if left < 0 or right >= len(classes) or classes[left][1] == classes[right][1]:
            return
        if any(classes[at][3] == len(classes[at][2]) for at in (left, right)):
            return
        g, e = (left, right) if classes[left][1] == "g" else (right, left)
        gap = abs(classes[g][0] - classes[e][0])
        if gap < abs(classes[g][0]):
            heapq.heappush(heap, (gap, classes[g][2][classes[g][3]], classes[e][2][classes[e][3]], g, e, classes[g][3], classes[e][3]))

    for left in range(len(classes) - 1):
        meet(left, left + 1)
    while heap:
        _, group, entry, g, e, g_used, e_used = heapq.heappop(heap)
        if classes[g][3] != g_used or classes[e][3] != e_used:
            continue  # one of them has moved on; its new neighbours are in the heap
        yield group, entry
        for at in (g, e):
            classes[at][3] += 1
            if classes[at][3] == len(classes[at][2]):
                left, right = before[at], after[at]
                if left >= 0:
                    after[left] = right
                if right < len(classes):
                    before[right] = left
        for at in (g, e):
            if classes[at][3] < len(classes[at][2]):
                meet(before[at], at)
                meet(at, after[at])
            else:
                meet(before[at], after[at])


def earliest_days(rows: list[dict]) -> Iterator[tuple]:
    """Days of groups in order, each taking the earliest entries it reaches: (when, entry_date, g_used, e_used, units)."""
    g_used: dict = {}
    e_used: dict = {}
    for row in rows:
        g, e = g_used.get(row["when"], 0), e_used.get(row["entry_date"], 0)
        units = min(row["g_size"] - g, row["e_size"] - e)
        if units > 0:
            yield row["when"], row["entry_date"], g, e, units
            g_used[row["when"]], e_used[row["entry_date"]] = g + units, e + units
