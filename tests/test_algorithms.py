"""The set-wise algorithms against plain serial versions on random small cases, hot paths included."""

from __future__ import annotations

import random
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from saldo.config import RuleSet
from saldo.functions import calendar as cal
from saldo.operators import assignment, folds, journals, ranking, subsets


@pytest.mark.parametrize("hot", [3, 10_000])
def test_rank_and_running_sum(spark, hot):
    rng = random.Random(1)
    rows = [(rng.choice("aab"), rng.randrange(50), i) for i in range(200)]
    df = spark.createDataFrame(rows, "k string, v int, i int")
    got = ranking.ranked(df, ["k"], [F.col("v").desc(), F.col("i")], "r", running=("v", "upto"), hot_rows=hot).collect()
    want = {}
    for key in "ab":
        total = 0
        for n, (k, v, i) in enumerate(sorted((x for x in rows if x[0] == key), key=lambda x: (-x[1], x[2])), 1):
            total += v
            want[i] = (n, total)
    assert {r.i: (r.r, r.upto) for r in got} == want


def shares(total, weights):
    whole = sum(weights)
    parts = [abs(total) * w // whole for w in weights]
    order = sorted(range(len(weights)), key=lambda i: (-(abs(total) * weights[i] % whole), i))
    for i in order[: abs(total) - sum(parts)]:
        parts[i] += 1
    return [-p if total < 0 else p for p in parts]


@pytest.mark.parametrize("hot", [3, 10_000])
def test_allocation_adds_up(spark, hot):
    rng = random.Random(2)
    rows, want = [], {}
    for g in range(12):
        weights = [rng.choice([0, 1, 7, 100, 31754900]) for _ in range(rng.randrange(1, 9))]
        total = rng.choice([0, 1, -1, 100, -1001, 1512484])
        if sum(weights) == 0:
            weights[0] = 5
        for i, (w, s) in enumerate(zip(weights, shares(total, weights), strict=True)):
            rows.append((g, i, w, total, -total))
            want[(g, i)] = s
    df = spark.createDataFrame(rows, "g int, i int, w bigint, t bigint, u bigint")
    got = ranking.allocate(df, ["g"], "w", [F.col("i")], {"t": "s", "u": "z"}, hot_rows=hot).collect()
    assert {(r.g, r.i): r.s for r in got} == want
    assert {(r.g, r.i): -r.z for r in got} == want


def test_allocation_of_zero_and_negative_weights(spark):
    zero = spark.createDataFrame([(1, 0, 0, 10), (1, 1, 0, 10)], "g int, i int, w bigint, t bigint")
    assert [r.s for r in ranking.allocate(zero, ["g"], "w", [F.col("i")], {"t": "s"}).collect()] == [None, None]
    with pytest.raises(ValueError, match="negative"):
        ranking.allocate(zero.withColumn("w", F.lit(-1)), ["g"], "w", [F.col("i")], {"t": "s"})


def first_subsets(credits, target, slack, size, most):
    """By definition: increasing position sequences in tolerance without such a prefix, in order."""
    ordered = sorted(credits, key=lambda c: (-c[1], c[0]))
    hits = []
    for n in range(1, min(size, len(ordered)) + 1):
        for combo in combinations(range(len(ordered)), n):
            sums, ok = 0, False
            for j, p in enumerate(combo):
                sums += ordered[p][1]
                ok = abs(target - sums) <= slack
                if ok and j < n - 1:
                    ok = False
                    break
            if ok:
                hits.append(combo)
    return [tuple(sorted(ordered[p][0] for p in c)) for c in sorted(hits)[:most]]


#: Ways through the search: one piece with all states, met in the middle, by steps alone, and in rounds.
WAYS = ({}, {"easy": 0}, {"easy": 0, "states": 3}, {"easy": 0, "states": 0}, {"group": 1, "block": 3})


@pytest.mark.parametrize("way", WAYS)
def test_subset_search(spark, way):
    rng = random.Random(3)
    rules = RuleSet(subset_max_size=4, subset_max_solutions=3)
    rows, want = [], {}
    for b in range(30):
        n = rng.randrange(1, 9)
        credits = [(f"d{i}", rng.choice([1, 2, 3, 5, 8, 13, 40])) for i in range(n)]
        target, slack = rng.randrange(1, 40), rng.choice([0, 1])
        rows += [(f"b{b}", d, c, target, slack) for d, c in credits]
        if n >= 2 and first_subsets(credits, target, slack, 4, 3):
            want[f"b{b}"] = first_subsets(credits, target, slack, 4, 3)
    df = spark.createDataFrame(rows, "batch_id string, deposit_id string, cents bigint, target_cents bigint, slack_cents bigint")
    found, out = subsets.search(df.withColumn("value_date", F.to_date(F.lit("2026-01-01"))), rules, **way)
    got = {}
    for r in sorted(found.collect(), key=lambda r: (r.batch_id, r.solution)):
        got.setdefault(r.batch_id, []).append(tuple(r.deposits))
        assert r.complete
    assert got == want
    assert out.isEmpty()


@pytest.mark.parametrize("way", [{}, {"easy": 0}, {"easy": 0, "states": 40}, {"easy": 0, "states": 12}])
def test_one_batch_searched_by_states(way):
    rng = random.Random(31)
    met = 0
    for n in range(150):
        size = rng.choice([2, 5, 20])
        amounts = sorted((rng.choice([rng.randrange(1, 2000), 700, 701, 350]) for _ in range(rng.randrange(2, 12))), reverse=True)
        target, slack = rng.randrange(1, 6000), rng.choice([0, 0, 3, 60])
        found, _, complete = subsets.solve(amounts, target, slack, subsets.Limits(size, 5, 200_000), **way)
        named = [(f"{i:02}", c) for i, c in enumerate(amounts)]
        assert complete and [tuple(f"{p:02}" for p in s) for s in found] == first_subsets(named, target, slack, size, 5), n
        ends = subsets.Completions(np.array(amounts), target, slack, size, way.get("states", subsets.STATES))
        met += 0 < ends.known < len(amounts)
    assert met or way.get("states") is None


@pytest.mark.parametrize("slack", [0, 3])
def test_two_hundred_equal_and_near_equal_credits(slack):
    rules = subsets.Limits.of(RuleSet())
    equal = [7_000] * 200
    assert subsets.solve(equal, 7_000 * 50 + 100, slack, rules) == ([], subsets.solve(equal, 7_000 * 50 + 100, slack, rules)[1], True)
    found, steps, complete = subsets.solve(equal, 7_000 * 50, slack, rules)
    assert complete and found[0] == list(range(50)) and found[1] == [*range(49), 50] and steps < 20_000
    rng = random.Random(6)
    near = sorted((100_000 + 2 * rng.randrange(60) for _ in range(200)), reverse=True)
    odd, _, complete = subsets.solve(near, 100_000 * 59 + 1, 0, rules)
    assert complete and odd == []  # no even sum is odd, and no search says so faster than the states
    target = sum(rng.sample(near, 40))
    found, _, complete = subsets.solve(near, target, slack, rules)
    assert complete and len(found) == 5 and found == sorted(found)
    assert all(abs(sum(near[p] for p in s) - target) <= slack for s in found)


def test_halves_meet_where_neither_side_is_small():
    rng = random.Random(8)
    amounts = sorted((rng.randrange(10**9, 10**10) for _ in range(32)), reverse=True)
    chosen = sorted(rng.sample(range(32), 13))
    target = sum(amounts[p] for p in chosen)
    found, _, complete = subsets.solve(amounts, target, 0, subsets.Limits(60, 5, 10), states=1 << 17)
    assert complete and found == [chosen]


def test_subset_search_says_when_it_gives_up(spark):
    rows = [("b", f"d{i:02}", 2 * (i + 1), 201) for i in range(30)]  # no solution
    rows += [("c", f"d{i:02}", c, 101) for i, c in enumerate([99, 2, *range(40, 2, -2)])]  # one at once, and no other
    schema = "batch_id string, deposit_id string, cents bigint, target_cents bigint"
    df = spark.createDataFrame(rows, schema).select("*", F.lit(0).cast("bigint").alias("slack_cents"), F.current_date().alias("value_date"))
    for way in ({"group": 1, "block": 8}, {"easy": 10, "states": 4}):
        found, out = subsets.search(df, RuleSet(subset_max_rows=200), **way)
        assert {(r.batch_id, r.found > 0) for r in out.collect()} == {("b", False), ("c", True)}
        assert {(r.batch_id, r.complete) for r in found.collect()} == {("c", False)}
    found, out = subsets.search(df, RuleSet(subset_max_rows=200))
    assert out.isEmpty() and all(r.complete for r in found.collect())


@pytest.mark.parametrize("group", [folds.GROUP, 8])
def test_assignment_equals_the_serial_pass(spark, group):
    rng = random.Random(4)
    rows = []
    for a in range(25):
        seen = set()
        for _ in range(rng.randrange(1, 25)):
            deposits = sorted(rng.sample([f"d{i}" for i in range(6)], rng.choice([1, 1, 1, 2, 3])))
            batch, key = f"a{a}b{rng.randrange(6)}", "+".join(deposits)
            if (batch, key) in seen:
                continue
            seen.add((batch, key))
            rows.append((f"a{a}", batch, key, deposits, len(deposits), rng.choice([50, 60, 60, 70]), rng.choice([None, None, None, "AMOUNT_MISMATCH"])))
    df = spark.createDataFrame(rows, "account_id string, batch_id string, key string, deposit_ids array<string>, n_deposits int, score int, gate string")
    want, taken = set(), set()
    for account, batch, key, deposits, n, score, gate in sorted(rows, key=lambda r: (-r[5], r[1], r[4], r[2])):
        claims = {(account, batch)} | {(account, d) for d in deposits}
        if gate is None and not claims & taken:
            taken |= claims
            want.add((batch, key))
    got = {(r.batch_id, r.key) for r in assignment.winners(df, group=group).collect()}
    assert got == want


def serial_passes(groups, entries, ahead):
    """All five passes as one serial walk over lists."""
    free, pending, hits = {e[0]: e for e in sorted(entries, key=lambda e: (e[1], e[0]))}, {}, {}
    for g in sorted(groups, key=lambda g: (g[1], g[0])):
        same = [e for e in free.values() if e[3] == g[0].upper()]
        if same:
            hits[g[0]] = (same[0][0], 1)
            del free[same[0][0]]
        else:
            pending[g[0]] = g

    def take(key, entry, n):
        hits[key] = (entry, n)
        pending.pop(key, None)
        free.pop(entry, None)

    for day in sorted({g[1] for g in pending.values()}):
        here = lambda: [g for g in pending.values() if g[1] == day]
        there = lambda: [e for e in free.values() if e[1] == day and e[2] is not None]
        for g in here():
            equal = [e for e in there() if e[2] == g[2]]
            if equal:
                take(g[0], equal[0][0], 2)
        left = here()
        if len(left) >= 2:
            whole = [e for e in there() if e[2] == sum(g[2] for g in left)]
            if whole:
                for g in left:
                    take(g[0], whole[0][0], 3)
        pairs = [(abs(e[2] - g[2]), g[0], n, e[0]) for g in here() for n, e in enumerate(there()) if abs(e[2] - g[2]) < abs(g[2])]
        for _, key, _, entry in sorted(pairs):
            if key in pending and entry in free:
                take(key, entry, 4)
    for key, g in list(pending.items()):
        late = [e for d in ahead[g[1]] for e in free.values() if e[1] == d and e[2] == g[2]]
        if late:
            take(key, late[0][0], 5)
    return hits


@pytest.mark.parametrize("group", [folds.GROUP, 3])
def test_journal_passes_equal_the_serial_walk(spark, monkeypatch, group, hot=2):
    monkeypatch.setattr(journals.by_nearest, "__defaults__", (group,))
    monkeypatch.setattr(ranking.ranked, "__defaults__", ("rank", None, hot, None))
    rng = random.Random(5)
    days = ["2026-01-05", "2026-01-06", "2026-01-07", "2026-01-09"]
    following = {"2026-01-05": days[1:3], "2026-01-06": ["2026-01-07", "2026-01-08"], "2026-01-07": ["2026-01-08", "2026-01-09"], "2026-01-09": ["2026-01-12"]}
    following["2026-01-09"] = ["2026-01-13", "2026-01-14"]
    grouped, listed, want = [], [], {}
    for j in range(20):
        few = rng.choice([[100, 103, 106], [5, -5, 9, 14], [10, 10, 20, 30, 31]])
        groups = [(f"g{i}", rng.choice(days), rng.choice(few)) for i in range(rng.randrange(1, 12))]
        entries = [
            (f"e{i:02}", rng.choice(days), rng.choice([*few, few[0] + few[1], None, few[0] + 3]), rng.choice([None, None, None, f"G{i}", "G1"]))
            for i in range(rng.randrange(1, 12))
        ]
        grouped += [(f"j{j}", *g) for g in groups]
        listed += [(f"j{j}", *e) for e in entries]
        for key, (entry, n) in serial_passes(groups, entries, following).items():
            want[(f"j{j}", key)] = (entry, n)
    g = spark.createDataFrame(grouped, "journal_key string, group_key string, d string, ledger_cents bigint").withColumn("date", F.to_date("d"))
    e = spark.createDataFrame(listed, "journal_key string, entry_id string, d string, entry_cents bigint, reference string").withColumn("date", F.to_date("d"))
    calendar = cal.calendar_table(spark, ["2026-01-12"], 5)
    got = journals.match(g, e, calendar).collect()
    assert {(r.journal_key, r.group_key): (r.entry_id, r["pass"]) for r in got} == want
    assert len(got) == len(want)


def chain(n):
    """One day on which every entry lies a little nearer to the next group than to its own: n pairs, found from the end."""
    at, gap, groups, entries = 1_000_000_000, 3 * n, [], []
    for i in range(n):
        groups.append((f"g{i:05}", "2026-01-05", at))
        entries.append((f"e{i:05}", "2026-01-05", at + gap, None))
        at += 2 * gap - 1
        gap -= 2
    return groups, entries


def test_a_chain_of_a_thousand_pairs_is_one_fold(spark):
    groups, entries = chain(1000)
    g = spark.createDataFrame([("j", *x) for x in groups], "journal_key string, group_key string, d string, ledger_cents bigint").withColumn("date", F.to_date("d"))
    e = spark.createDataFrame([("j", *x) for x in entries], "journal_key string, entry_id string, d string, entry_cents bigint, reference string").withColumn("date", F.to_date("d"))
    got = {r.group_key: r.entry_id for r in journals.by_nearest(g, e).collect()}
    free, want = {x[0]: x[2] for x in entries}, {}
    for _, key, entry in sorted((abs(c - a), k, n) for k, _, a in groups for n, c in free.items() if abs(c - a) < a):
        if key not in want and entry in free:
            want[key] = entry
            del free[entry]
    assert got == want and len(got) == 1000
    few, some = chain(12)
    short = {x[0] for x in few}
    g, e = g.filter(F.col("group_key").isin(*short)), e.filter(F.col("entry_id").isin(*[x[0] for x in some]))
    folded = {(r.group_key, r.entry_id) for r in journals.by_nearest(g, e).collect()}
    assert folded == {(r.group_key, r.entry_id) for r in journals.by_nearest(g, e, 5).collect()} and len(folded) == 12


def test_alternating_days_are_one_fold():
    """Eight days of groups and entries, each group able to take the entry that the next one needs."""
    edges = [{"when": d, "entry_date": d + n, "g_size": 1, "e_size": 1} for d in range(8) for n in (1, 2, 3)]
    assert [(r[0], r[1]) for r in folds.earliest_days(edges)] == [(d, d + 1) for d in range(8)]
    uneven = [{"when": 0, "entry_date": 1, "g_size": 3, "e_size": 1}, {"when": 0, "entry_date": 2, "g_size": 3, "e_size": 5}, {"when": 1, "entry_date": 2, "g_size": 9, "e_size": 5}]
    assert list(folds.earliest_days(uneven)) == [(0, 1, 0, 0, 1), (0, 2, 1, 0, 2), (1, 2, 0, 2, 3)]
