"""Subset search: which sets of credits add up to a batch.

The answer wanted is: of all increasing position sequences (credits ordered by amount, largest
first) whose sum is within the tolerance of the target and none of whose proper prefixes is, the
first few in lexicographic order.

A batch with up to ``GROUP`` credits is one row and is searched in one piece, batches side by side.
What the credits behind a position can still add up to is kept as a set of states, so the search
never enters a branch that ends nowhere: sums whose tolerances touch are one interval, equal sums
are one state however many subsets reach them. Where these sets grow too large from the end, the
missing amounts that the credits before can leave are kept from the front, and the two meet in the
middle. Only if neither side stays within ``STATES`` is the search left to a budget of steps.

A batch with more credits stays rows: a table of partial sums grows in rounds. Each round every
batch opens its first few partial sums in order, one block of credits at a time; a batch is finished
when its solutions all precede whatever is still open.

Whatever stops early is reported, with or without solutions.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from saldo.config import RuleSet
from saldo.operators.ranking import ranked
from saldo.session import materialise

#: Credits looked at per opened partial sum, and partial sums opened per batch and round.
BLOCK = 64
#: Credits of a batch that is searched as one row.
GROUP = 4096
#: States kept for one position, and steps tried before any are built.
STATES = 1 << 19
EASY = 2000

# The search of a batch travels with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

SOLUTIONS = "batch_id string, solution int, positions array<int>, deposits array<string>, steps bigint, complete boolean"


class Limits(NamedTuple):
    """What a search is asked for: credits of a solution, solutions, and steps if states do not help."""

    credits: int
    solutions: int
    steps: int

    @classmethod
    def of(cls, rules: RuleSet) -> Limits:
        return cls(rules.subset_max_size, rules.subset_max_solutions, rules.subset_max_rows)


class Completions:
    """Which missing amounts the credits from a position on can still make up, from the last position backwards.

    ``known`` is the first position whose states are at hand. With a binding limit on the number of
    credits a state is a sum with the fewest credits that reach it, else an interval of amounts.
    """

    def __init__(self, cents: np.ndarray, target: int, slack: int, most_credits: int, states: int = STATES):
        n = len(cents)
        self.slack, self.most = slack, most_credits
        self.counted = n > most_credits
        before = np.concatenate([[0], np.cumsum(cents)])
        zero = np.zeros(1, np.int64)
        self.levels = [None] * n + [(zero, zero) if self.counted else (zero - slack, zero + slack)]
        self.known, total = n, 0
        for p in range(n - 1, -1, -1):
            least = target - int(before[p])  # more than all the credits before is never taken off
            low, high = self._counted(p, cents, target, least) if self.counted else self._merged(p, cents, target, least)
            total += len(low)
            if len(low) > states or total > 8 * states:
                break
            self.levels[p], self.known = (low, high), p

    def _merged(self, p: int, cents: np.ndarray, target: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        low, high = self.levels[p + 1]
        low, high = np.concatenate([low, low + cents[p]]), np.concatenate([high, high + cents[p]])
        inside = (low <= target) & (high >= least)
        order = np.argsort(low[inside], kind="stable")
        low, high = low[inside][order], np.maximum.accumulate(high[inside][order])
        opens = np.concatenate([[True], low[1:] > high[:-1] + 1])[: len(low)]
        return low[opens], high[np.concatenate([opens[1:], [True]])[: len(low)]]

    def _counted(self, p: int, cents: np.ndarray, target: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        sums, used = self.levels[p + 1]
        sums, used = np.concatenate([sums, sums + cents[p]]), np.concatenate([used, used + 1])
        inside = (sums <= target + self.slack) & (sums >= least - self.slack) & (used <= self.most)
        order = np.lexsort((used[inside], sums[inside]))
        sums, used = sums[inside][order], used[inside][order]
        first = np.concatenate([[True], sums[1:] != sums[:-1]])[: len(sums)]
        return sums[first], used[first]

    def reach(self, p: int, missing: int, used: int) -> bool:
        """Whether credits from ``p`` on bring ``missing`` within the tolerance."""
        low, high = self.levels[p]
        if self.counted:
            a, b = np.searchsorted(low, [missing - self.slack, missing + self.slack + 1])
            return a < b and int(high[a:b].min()) <= self.most - used
        at = int(np.searchsorted(low, missing, "right")) - 1
        return at >= 0 and int(high[at]) >= missing


def meeting(cents: np.ndarray, target: int, ends: Completions, states: int = STATES) -> list[np.ndarray] | None:
    """For each position before the known ones, the states that lead to a solution; none if there are too many.

    A state is the amount missing, with the number of credits used where that is limited.
    """
    slack, width = ends.slack, ends.most + 1 if ends.counted else 1
    rest = np.concatenate([np.cumsum(cents[::-1])[::-1], [0]])
    levels, total = [np.array([target * width], np.int64)], 0

    def after(p: int, level: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The states that taking the credit at ``p`` leaves, and which of these are solutions."""
        taken = level - int(cents[p]) * width + (1 if ends.counted else 0)
        missing = taken // width
        allowed = (missing >= -slack) & (taken % width <= ends.most if ends.counted else True)
        return taken, allowed & (missing <= slack)

    for p in range(ends.known):
        taken, solved = after(p, levels[p])
        missing = taken // width
        on = ~solved & (missing > slack) & (taken % width < ends.most if ends.counted else True)
        level = np.unique(np.concatenate([levels[p], taken[on]]))
        level = level[level // width - slack <= rest[p + 1]]
        total += len(level)
        if len(level) > states or total > 8 * states:
            return None
        levels.append(level)
    useful = [ends.reach(ends.known, int(s) // width, int(s) % width if ends.counted else 0) for s in levels[-1]]
    alive = [levels[-1][np.array(useful, bool)]]
    for p in range(ends.known - 1, -1, -1):
        taken, solved = after(p, levels[p])
        lead = solved | np.isin(levels[p], alive[-1]) | np.isin(taken, alive[-1])
        alive.append(levels[p][lead])
    return alive[::-1]


def first_sequences(
    cents: list[int], target: int, slack: int, most_credits: int, most: int, leads: Callable[[int, int, int], bool], budget: int | None
) -> tuple[list[list[int]], int, bool]:
    """The first ``most`` solutions in order, the steps taken, and whether that is all that was asked for.

    ``leads(position, missing, used)`` says whether a branch may hold a solution.
    """
    rest = [0] * (len(cents) + 1)
    for p in range(len(cents) - 1, -1, -1):
        rest[p] = rest[p + 1] + cents[p]
    found: list[list[int]] = []
    path: list[int] = []
    open_ = [[0, target]]  # for each credit chosen and the next: the position to try and what is missing
    steps = 0
    while open_ and len(found) < most:
        p, missing = open_[-1]
        if p == len(cents) or rest[p] < missing - slack:
            open_.pop()
            if path:
                path.pop()
            continue
        open_[-1][0] = p + 1
        left = missing - cents[p]
        if left < -slack:
            continue
        steps += 1
        if budget is not None and steps > budget:
            return found, steps, False
        if left <= slack:
            found.append([*path, p])
        elif len(path) + 1 < most_credits and leads(p + 1, left, len(path) + 1):
            path.append(p)
            open_.append([p + 1, left])
    return found, steps, True


def solve(cents: list[int], target: int, slack: int, limits: Limits, states: int = STATES, easy: int = EASY) -> tuple[list[list[int]], int, bool]:
    """The first solutions over one batch's credits, largest first; whether they are surely the first ones."""
    ask = (cents, target, slack, limits.credits, limits.solutions)
    answer = first_sequences(*ask, lambda p, missing, used: True, easy)
    if answer[2]:
        return answer
    amounts = np.array(cents, np.int64)
    ends = Completions(amounts, target, slack, limits.credits, states)
    front = meeting(amounts, target, ends, states) if ends.known else []
    width = ends.most + 1 if ends.counted else 1

    def leads(p: int, missing: int, used: int) -> bool:
        if p >= ends.known:
            return ends.reach(p, missing, used)
        if front is None:
            return True
        state = missing * width + (used if ends.counted else 0)
        at = int(np.searchsorted(front[p], state))
        return at < len(front[p]) and int(front[p][at]) == state

    return first_sequences(*ask, leads, limits.steps if front is None else None)


def _solved(limits: Limits, states: int, easy: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in SOLUTIONS.split(", ")]
        types = [pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.string()), pa.int64(), pa.bool_()]
        for batch in batches:
            rows, end = [], 0
            listed = batch.column("credits")
            credits = listed.flatten()
            # ids are read for solutions only, which few batches have
            cents, ids = credits.field("cents").to_pylist(), credits.field("deposit_id")
            asked = [batch.column(c).to_pylist() for c in ("batch_id", "target_cents", "slack_cents")]
            for name, target, slack, size in zip(*asked, listed.value_lengths().to_pylist(), strict=True):
                start, end = end, end + size
                found, steps, complete = solve(cents[start:end], target, slack, limits, states, easy)
                for n, places in enumerate(found, 1):
                    deposits = sorted(ids[start + p].as_py() for p in places)
                    rows.append((name, n, [p + 1 for p in places], deposits, steps, complete))
                if not complete:
                    rows.append((name, 0, [], [], steps, False))
            columns = list(zip(*rows, strict=True)) if rows else [[]] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=names)

    return run


def search(
    pairs: DataFrame, rules: RuleSet, block: int = BLOCK, group: int = GROUP, states: int = STATES, easy: int = EASY
) -> tuple[DataFrame, DataFrame]:
    """``pairs``: batch_id, deposit_id, value_date, cents > 0, target_cents, slack_cents.

    Returns the solutions (batch_id, solution, positions, deposits, complete) and the batches
    (batch_id, rows, found) whose search was stopped, with the steps it took and the solutions it
    has found so far; these need not be the first ones, and the solutions say so.
    """
    # A credit larger than the target can be in no solution, and a batch whose credits cannot add
    # up to the target has none, so neither is searched.
    whole = pairs.groupBy("batch_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(F.when(F.col("cents") <= F.col("target_cents") + F.col("slack_cents"), F.col("cents"))).alias("usable"),
    )
    searched = materialise(whole.filter("n >= 2"), "subset-sizes")
    usable = (
        pairs.filter(F.col("cents") <= F.col("target_cents") + F.col("slack_cents"))
        .join(searched, "batch_id")
        .filter(F.col("usable") >= F.col("target_cents") - F.col("slack_cents"))
    )
    # rows are grouped where the join has brought them
    narrow = (
        usable.filter(F.col("n") <= group)
        .groupBy("batch_id")
        .agg(
            F.sort_array(F.collect_list(F.struct((-F.col("cents")).alias("order"), "value_date", "deposit_id", "cents"))).alias("credits"),
            F.first("target_cents").cast("bigint").alias("target_cents"),
            F.first("slack_cents").cast("bigint").alias("slack_cents"),
        )
        .select("batch_id", F.transform("credits", lambda c: F.struct(c["cents"].alias("cents"), c["deposit_id"].alias("deposit_id"))).alias("credits"), "target_cents", "slack_cents")
    )
    solved = materialise(narrow.mapInArrow(_solved(Limits.of(rules), states, easy), SOLUTIONS), "subset-solved")
    found = solved.filter("solution > 0").select("batch_id", "solution", "positions", "deposits", "complete")
    stopped = solved.filter("solution = 0").select("batch_id", F.col("steps").alias("rows"))
    wide = None
    if not searched.filter(F.col("n") > group).isEmpty():
        wide = materialise(usable.filter(F.col("n") > group).drop("n"), "subset-input")
    if wide is not None and not wide.isEmpty():
        more, given_up = _search_wide(wide, rules, block)
        found, stopped = found.unionByName(more), stopped.unionByName(given_up)
    counts = found.groupBy("batch_id").agg(F.count(F.lit(1)).alias("found"))
    return found, stopped.join(counts, "batch_id", "left").withColumn("found", F.coalesce("found", F.lit(0).cast("bigint")))


def _search_wide(usable: DataFrame, rules: RuleSet, block: int) -> tuple[DataFrame, DataFrame]:
    """The same for batches of any number of credits, by rounds over a table of partial sums."""
    order = [F.col("cents").desc(), F.col("value_date"), F.col("deposit_id")]
    credits = ranked(usable, ["batch_id"], order, "pos", running=("cents", "upto"))
    credits = credits.select(
        "batch_id", "deposit_id", F.col("pos").cast("int").alias("pos"), "cents", "target_cents", "slack_cents",
        (F.col("usable") - F.col("upto") + F.col("cents")).alias("reach"),
        F.floor(F.col("pos") / block).cast("int").alias("block"),
    )
    credits = materialise(credits, "subset-credits")
    # what the credits from the start of a block onwards can still contribute
    starts = credits.groupBy("batch_id", "block").agg(
        F.max("reach").alias("block_reach"), F.min("pos").alias("block_pos")
    )

    # per batch: rows grown so far, and its first few solutions in order
    state = materialise(
        credits.groupBy("batch_id").agg(F.lit(0).cast("bigint").alias("rows")).withColumn(
            "solutions", F.array().cast("array<array<int>>")
        ),
        "subset-state",
    )
    # an open row: the credits chosen, what is missing, and the block to read next
    open_rows = credits.groupBy("batch_id").agg(
        F.first("target_cents").alias("missing"), F.first("slack_cents").alias("slack_cents")
    ).select(
        "batch_id",
        F.array().cast("array<int>").alias("chosen"),
        F.array(F.lit(0)).alias("place"),
        F.col("missing").cast("bigint").alias("missing"),
        F.col("slack_cents").cast("bigint").alias("slack_cents"),
        F.lit(0).alias("block"),
    )
    open_rows = materialise(open_rows, "subset-open")

    most = rules.subset_max_solutions
    while not open_rows.isEmpty():
        turn = Window.partitionBy("batch_id").orderBy("place")
        queue = open_rows.withColumn("__turn", F.row_number().over(turn))
        now, later = queue.filter(F.col("__turn") <= block), queue.filter(F.col("__turn") > block)
        now, later = now.drop("__turn"), later.drop("__turn")

        grown = (
            now.join(credits.select("batch_id", "block", "pos", "cents", "reach"), ["batch_id", "block"])
            .filter(
                F.col("pos") > F.coalesce(F.get("chosen", F.size("chosen") - 1), F.lit(-1))
            )
            .filter(F.col("reach") >= F.col("missing") - F.col("slack_cents"))
            .withColumn("missing", F.col("missing") - F.col("cents"))
            .filter(F.col("missing") >= -F.col("slack_cents"))
            .withColumn("rest", F.col("reach") - F.col("cents"))
            .withColumn("chosen", F.array_append("chosen", F.col("pos")))
            .withColumn("solved", F.abs("missing") <= F.col("slack_cents"))
        )
        grown = materialise(grown, "subset-grown")
        # a round grows at most block * block rows per batch
        news = grown.groupBy("batch_id").agg(
            F.count(F.lit(1)).alias("new_rows"), F.collect_list(F.when(F.col("solved"), F.col("chosen"))).alias("fresh")
        )
        state = state.join(news, "batch_id", "left").select(
            "batch_id",
            (F.col("rows") + F.coalesce("new_rows", F.lit(0))).alias("rows"),
            F.slice(F.array_sort(F.concat("solutions", F.coalesce("fresh", F.array().cast("array<array<int>>")))), 1, most).alias("solutions"),
        )
        state = materialise(state, "subset-state")
        children = grown.filter(
            ~F.col("solved")
            & (F.size("chosen") < rules.subset_max_size)
            & (F.col("rest") >= F.col("missing") - F.col("slack_cents"))
        ).select(
            "batch_id", "chosen", F.col("chosen").alias("place"), "missing", "slack_cents", "block"
        )
        onwards = (
            now.withColumn("block", F.col("block") + 1)
            .join(starts, ["batch_id", "block"])
            .filter(F.col("block_reach") >= F.col("missing") - F.col("slack_cents"))
            .select(
                "batch_id", "chosen", F.array_append("chosen", F.col("block_pos")).alias("place"), "missing",
                "slack_cents", "block",
            )
        )
        # open rows behind the last wanted solution, or of a batch out of budget, are done
        last = F.get("solutions", F.lit(most - 1))
        open_rows = (
            later.unionByName(children)
            .unionByName(onwards)
            .join(state.filter(F.col("rows") <= rules.subset_max_rows).select("batch_id", last.alias("last")), "batch_id")
            .filter(F.col("last").isNull() | (F.col("place") < F.col("last")))
            .drop("last")
        )
        open_rows = materialise(open_rows, "subset-open")

    solutions = state.select("batch_id", F.posexplode("solutions").alias("solution", "positions"))
    named = (
        solutions.select("batch_id", (F.col("solution") + 1).alias("solution"), "positions", F.explode("positions").alias("pos"))
        .join(credits.select("batch_id", "pos", "deposit_id"), ["batch_id", "pos"])
        .groupBy("batch_id", "solution", "positions")
        .agg(F.array_sort(F.collect_list("deposit_id")).alias("deposits"))
    )
    over = F.col("rows") > rules.subset_max_rows
    ended = state.select("batch_id", "rows", over.alias("over"))
    named = named.join(ended.select("batch_id", (~F.col("over")).alias("complete")), "batch_id")
    return named, ended.filter("over").select("batch_id", "rows")
