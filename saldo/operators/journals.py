"""Ledger against journal entries: groups, matching passes, and what each line turns out to be.

Everything is keyed by ``journal_key``, so all journals are compared at once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saldo.config import DEDUCTIONS, Chart, RuleSet
from saldo.functions import parties
from saldo.operators import folds
from saldo.operators.ranking import ranked
from saldo.session import materialise


def groups(movements: DataFrame, journals: DataFrame) -> DataFrame:
    """Movements sharing an external id (or a lone movement) are one thing to look for.

    ``journals`` maps account_id to journal_key. Only aggregates are kept per group; the members
    stay rows, see :func:`group_members`.
    """
    keyed = group_members(movements, journals)
    first = F.struct("value_date", "id")
    return keyed.groupBy("journal_key", "group_key").agg(
        F.min("value_date").alias("date"),
        F.sum("amount_cents").alias("ledger_cents"),
        F.array_sort(F.collect_set("type")).alias("concepts"),  # a closed set of ten types
        F.count(F.lit(1)).alias("n_movements"),
        F.min(first).alias("first"),
        F.min_by("description", first).alias("descriptor"),
        F.min_by("counterparty", first).alias("counterparty"),
        # the first counterparty named at all decides whose money it is
        F.min(F.when(F.coalesce("counterparty", F.lit("")) != "", F.struct("value_date", "id", "counterparty"))).alias("named"),
        F.min(F.when(F.col("type") == "CHARGE", F.struct("value_date", "id"))).alias("charge"),
        F.bool_and(F.col("type").isin("TRANSFER_IN", "TRANSFER_OUT")).alias("transfer_only"),
    ).select(
        "journal_key", "group_key", "date", F.col("ledger_cents").cast("bigint").alias("ledger_cents"), "concepts",
        "n_movements", F.col("first.id").alias("first_id"), F.col("first.value_date").alias("first_date"), "descriptor",
        "counterparty", F.col("named.counterparty").alias("party"), F.col("charge.id").alias("charge_id"), "transfer_only",
    )


def group_members(movements: DataFrame, journals: DataFrame) -> DataFrame:
    key = F.coalesce(F.nullif(F.col("external_id"), F.lit("")), F.col("id"))
    return movements.join(journals.select("account_id", "journal_key"), "account_id").withColumn("group_key", key)


def reference(ref: Column, name: Column) -> Column:
    """The reference an entry carries: its own, else the one in brackets at the end of its name."""
    own = F.upper(F.trim(ref))
    named = F.upper(F.trim(F.regexp_extract(name, r"\(([^)]+)\)\s*$", 1)))
    return F.coalesce(F.nullif(own, F.lit("")), F.nullif(named, F.lit("")))


def entries(heads: DataFrame, lines: DataFrame, journals: DataFrame, add_back: list[str]) -> DataFrame:
    """One row per entry: its reference, the amount it states, whether it balances, accounts used.

    The amount is the net on the journal's main account, plus the ``add_back`` accounts; an entry
    that never touches the main account states none. ``journals`` gives the main account per
    journal_key.
    """
    coded = lines.join(
        heads.select("entry_id", "journal_key").join(journals.select("journal_key", "main_account"), "journal_key"),
        "entry_id",
    )
    main = F.col("account_code") == F.col("main_account")
    extra = F.col("account_code").isin(*add_back) if add_back else F.lit(False)
    sums = coded.groupBy("entry_id").agg(
        F.sum(F.when(main, F.col("amount_cents"))).alias("main_cents"),
        F.sum(F.when(extra, F.col("amount_cents"))).alias("extra_cents"),
        F.sum("amount_cents").alias("signed_cents"),
        F.collect_set("account_code").alias("account_codes"),  # bounded by the chart of accounts
    )
    amount = F.col("main_cents") + F.coalesce("extra_cents", F.lit(0))
    return heads.join(sums, "entry_id", "left").select(
        "entry_id", "journal_key", "name", "ref", "date", "state",
        reference(F.col("ref"), F.col("name")).alias("reference"),
        amount.cast("bigint").alias("entry_cents"),
        (F.coalesce("signed_cents", F.lit(0)) == 0).alias("balanced"),
        F.coalesce(F.array_sort("account_codes"), F.array().cast("array<string>")).alias("account_codes"),
    )


def duplicates(grouped: DataFrame, listed: DataFrame) -> DataFrame:
    """Groups whose key is the reference of two entries or more."""
    repeated = listed.filter("reference is not null").groupBy("journal_key", "reference").agg(
        F.count(F.lit(1)).alias("entries")
    ).filter("entries >= 2")
    return grouped.withColumn("reference", F.upper("group_key")).join(repeated, ["journal_key", "reference"]).drop(
        "reference"
    )


MATCH_COLUMNS = ("journal_key", "group_key", "entry_id", "level", "pass")


def match(grouped: DataFrame, listed: DataFrame, calendar: DataFrame, shift_days: int = 2) -> DataFrame:
    """The five passes, each seeing only what the ones before left.

    Returns ``journal_key, group_key, entry_id, level, pass``.
    """
    pending = materialise(grouped.select("journal_key", "group_key", "date", "ledger_cents"), "groups")
    free = materialise(
        listed.select("journal_key", "entry_id", "date", "reference", "entry_cents"), "entries"
    )
    found = []
    for number, find in enumerate((by_reference, by_amount, by_day_total, by_nearest, by_shift), 1):
        if number > 1 and (pending.isEmpty() or free.isEmpty()):
            break  # nothing left to pair
        if number == 5:
            hits = find(pending, free, calendar, shift_days)
        else:
            hits = find(pending, free)
        hits = materialise(hits.withColumn("pass", F.lit(number)).select(*MATCH_COLUMNS), f"pass{number}")
        found.append(hits)
        if number == 5:
            break
        pending = pending.join(hits, ["journal_key", "group_key"], "left_anti")
        free = free.join(hits, ["journal_key", "entry_id"], "left_anti")
        pending, free = materialise(pending, "groups"), materialise(free, "entries")
    result = found[0]
    for hits in found[1:]:
        result = result.unionByName(hits)
    return result


def _zip(
    left: DataFrame, right: DataFrame, keys: list[str], left_order: tuple[str, str], right_order: tuple[str, str]
) -> DataFrame:
    """Pair the n-th of one side with the n-th of the other inside each key.

    Sides are ordered by their (day, name) columns; the pairs have ``group_key`` and ``entry_id``.
    """
    # a key found on one side only pairs nothing and needs no rank
    g = left.join(right, keys, "left_semi")
    e = right.join(left, keys, "left_semi")
    nth = _numbered(
        g.select(*keys, F.lit("g").alias("side"), F.col(left_order[0]).alias("day"), F.col(left_order[1]).alias("name")),
        e.select(*keys, F.lit("e").alias("side"), F.col(right_order[0]).alias("day"), F.col(right_order[1]).alias("name")),
        keys,
    )
    return _side(nth, "g", "group_key").join(_side(nth, "e", "entry_id"), [*keys, "nth"])


def _numbered(g: DataFrame, e: DataFrame, keys: list[str]) -> DataFrame:
    both = materialise(g.unionByName(e), "sides")
    return ranked(both, [*keys, "side"], [F.col("day"), F.col("name")], "nth")


def _side(numbered: DataFrame, side: str, name: str) -> DataFrame:
    return numbered.filter(F.col("side") == side).withColumnRenamed("name", name).drop("side", "day")


def _no_pairs(pending: DataFrame, free: DataFrame) -> DataFrame:
    kind = free.schema["entry_id"].dataType
    return pending.filter(F.lit(False)).select(
        "journal_key", "group_key", F.lit(None).cast(kind).alias("entry_id"), F.lit("NONE").alias("level")
    )


def by_reference(pending: DataFrame, free: DataFrame) -> DataFrame:
    """Pass 1: the first free entry carrying the group's key as its reference."""
    left = pending.withColumn("reference", F.upper("group_key"))
    right = free.filter("reference is not null")
    pairs = _zip(left, right, ["journal_key", "reference"], ("date", "group_key"), ("date", "entry_id"))
    return pairs.withColumn("level", F.lit("REF"))


def by_amount(pending: DataFrame, free: DataFrame) -> DataFrame:
    """Pass 2: same day, same amount, one to one."""
    left = pending.withColumn("cents", F.col("ledger_cents")).withColumn("day", F.col("date"))
    right = free.filter("entry_cents is not null").withColumn("cents", F.col("entry_cents")).withColumn("day", F.col("date"))
    pairs = _zip(left, right, ["journal_key", "date", "cents"], ("day", "group_key"), ("day", "entry_id"))
    return pairs.withColumn("level", F.lit("EXACT"))


def by_day_total(pending: DataFrame, free: DataFrame) -> DataFrame:
    """Pass 3: everything left on a day, two groups at least, adds up to one free entry."""
    days = pending.groupBy("journal_key", "date").agg(
        F.sum("ledger_cents").cast("bigint").alias("entry_cents"), F.count(F.lit(1)).alias("n")
    ).filter("n >= 2")
    entry = days.join(free, ["journal_key", "date", "entry_cents"]).groupBy("journal_key", "date").agg(
        F.min("entry_id").alias("entry_id")
    )
    return pending.join(entry, ["journal_key", "date"]).withColumn("level", F.lit("AGGREGATED"))


def by_nearest(pending: DataFrame, free: DataFrame, group: int = folds.GROUP) -> DataFrame:
    """Pass 4: on one day, the closest remaining entry, by gap, then group key, then entry.

    A day with up to ``group`` groups and entries of a journal is walked once along its amounts, larger
    days are swept in rounds.
    """
    day = ["journal_key", "date"]
    g = pending.filter("ledger_cents <> 0").select(*day, F.col("ledger_cents").alias("cents"), "group_key")
    e = free.filter("entry_cents is not null").select(*day, F.col("entry_cents").alias("cents"), "entry_id")
    g, e = g.join(e, day, "left_semi"), e.join(g, day, "left_semi")
    kinds = [pending.schema["group_key"], free.schema["entry_id"]]
    both = g.withColumn("entry_id", F.lit(None).cast(kinds[1].dataType)).unionByName(
        e.withColumn("group_key", F.lit(None).cast(kinds[0].dataType))
    )
    both = materialise(both.select(*day, "cents", "group_key", "entry_id"), "near")
    small, large = folds.by_size(both, day, group)
    pairs = folds.folded(small, day, folds.nearest_pairs, kinds).withColumn("level", F.lit("APPROXIMATE"))
    if large is None:
        return pairs
    days = large.select(*day).distinct()
    swept = _swept_nearest(pending.join(days, day, "left_semi"), free.join(days, day, "left_semi"))
    return pairs.select("journal_key", "group_key", "entry_id", "level").unionByName(swept.select("journal_key", "group_key", "entry_id", "level"))


def _swept_nearest(pending: DataFrame, free: DataFrame) -> DataFrame:
    """Pass 4 for days of any size.

    Equal amounts on a side are one class, worked off in order; a class only ever competes with
    its neighbours on the amount line, so no list of all pairs is made. In each round every class
    looks left and right for its best partner. Two classes that prefer each other are paired off as
    far as both reach; where one of them has a tie, only their first pair is taken, since the other
    class of the tie may come next. Classes that ran out leave, and the rest looks again, until
    nobody finds a partner.
    """
    day = ["journal_key", "date"]
    g = pending.filter("ledger_cents <> 0").withColumn("cents", F.col("ledger_cents")).withColumnRenamed("group_key", "name")
    e = free.filter("entry_cents is not null").withColumn("cents", F.col("entry_cents")).withColumnRenamed("entry_id", "name")
    g, e = g.join(e, day, "left_semi"), e.join(g, day, "left_semi")
    key = [*day, "cents"]
    columns = [*key, F.lit(0).alias("day"), "name"]
    members = _numbered(
        g.select(*columns, F.lit("g").alias("side")), e.select(*columns, F.lit("e").alias("side")), key
    ).drop("day")
    members = materialise(members, "near-members")
    classes = members.groupBy(*key, "side").agg(
        F.count(F.lit(1)).alias("size"), F.lit(0).cast("bigint").alias("used"), F.min("name").alias("head")
    )
    classes = materialise(classes, "near-classes")
    taken: list[DataFrame] = []
    while True:
        chosen = materialise(_preferring_each_other(classes, day), "near-chosen")
        if chosen.isEmpty():
            break
        taken.append(chosen)
        used = chosen.select(
            *day, "units",
            F.explode(F.array(
                F.struct(F.lit("g").alias("side"), F.col("g.cents").alias("cents")),
                F.struct(F.lit("e").alias("side"), F.col("e.cents").alias("cents")),
            )).alias("c"),
        ).select(*day, "c.cents", "c.side", "units")
        moved = classes.join(used, [*key, "side"], "left").withColumn("units", F.coalesce("units", F.lit(0)))
        moved = moved.withColumn("used", F.col("used") + F.col("units")).filter("used < size")
        # the next in line of a class that moved on
        heads = members.select(*key, "side", (F.col("nth") - 1).alias("used"), F.col("name").alias("next"))
        classes = moved.join(heads, [*key, "side", "used"], "left").select(
            *key, "side", "size", "used",
            F.when(F.col("units") > 0, F.col("next")).otherwise(F.col("head")).alias("head"),
        )
        classes = materialise(classes, "near-classes")
    if not taken:
        return _no_pairs(pending, free)
    pairs = taken[0]
    for more in taken[1:]:
        pairs = pairs.unionByName(more)
    named = _name_units(
        pairs.select(
            *day, "units", F.col("g.cents").alias("g_cents"), F.col("g.used").alias("g_used"),
            F.col("e.cents").alias("e_cents"), F.col("e.used").alias("e_used"),
        ),
        _side(members.withColumn("day", F.lit(0)), "g", "group_key").withColumnRenamed("cents", "g_cents"), [*day, "g_cents"],
        _side(members.withColumn("day", F.lit(0)), "e", "entry_id").withColumnRenamed("cents", "e_cents"), [*day, "e_cents"],
    )
    return named.withColumn("level", F.lit("APPROXIMATE"))


def _name_units(pairs: DataFrame, g: DataFrame, g_keys: list[str], e: DataFrame, e_keys: list[str]) -> DataFrame:
    """From class pairs with counts back to single groups and entries, in their order.

    A class is used up in consecutive stretches, so a group finds the stretch its place lies in, and
    with it the place of its entry. Nothing is spelled out per unit.
    """
    placed = (
        g.join(pairs, g_keys)
        .filter((F.col("nth") > F.col("g_used")) & (F.col("nth") <= F.col("g_used") + F.col("units")))
        .withColumn("e_nth", F.col("e_used") + F.col("nth") - F.col("g_used"))
        .drop("nth")
    )
    return placed.join(e.withColumnRenamed("nth", "e_nth"), [*e_keys, "e_nth"])


def _line_bucket(cents: Column) -> Column:
    """An order-preserving bucket of the amount line, so one day can be swept by many tasks."""
    size = F.floor(F.log(F.abs(cents).cast("double") + 1) * 32).cast("int")
    return F.when(cents < 0, -size).otherwise(size)


def _preferring_each_other(classes: DataFrame, day: list[str]) -> DataFrame:
    """Class pairs (g, e) each of which is the other's best partner, and how many units to pair."""
    points = classes.withColumn("me", F.struct("cents", "size", "used", "head")).withColumn(
        "bucket", _line_bucket(F.col("cents"))
    )
    for side in ("g", "e"):
        points = points.withColumn(f"as_{side}", F.when(F.col("side") == side, F.col("me")))
    inside = Window.partitionBy(*day, "bucket").orderBy("cents")
    below = inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)
    # swept downwards: a frame that ends at the current row grows, one that starts there is read anew for each row
    above = Window.partitionBy(*day, "bucket").orderBy(F.desc("cents")).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    swept = points
    for side in ("g", "e"):
        swept = swept.withColumn(f"low_{side}", F.last(f"as_{side}", ignorenulls=True).over(below)).withColumn(
            f"high_{side}", F.last(f"as_{side}", ignorenulls=True).over(above)
        )
    # a bucket without an opposite class looks at the nearest bucket that has one
    ends = points.groupBy(*day, "bucket").agg(
        F.max("as_g").alias("max_g"), F.min("as_g").alias("min_g"), F.max("as_e").alias("max_e"), F.min("as_e").alias("min_e")
    )
    order = Window.partitionBy(*day).orderBy("bucket")  # at most a few thousand buckets per day
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = Window.partitionBy(*day).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    for side in ("g", "e"):
        ends = ends.withColumn(f"prev_{side}", F.last(f"max_{side}", ignorenulls=True).over(before)).withColumn(
            f"next_{side}", F.last(f"min_{side}", ignorenulls=True).over(after)
        )
    known = swept.join(ends.select(*day, "bucket", "prev_g", "next_g", "prev_e", "next_e"), [*day, "bucket"])
    is_g = F.col("side") == "g"

    def edge(near: str, far: str) -> Column:
        other = F.when(is_g, F.coalesce(f"{near}_e", f"{far}_e")).otherwise(F.coalesce(f"{near}_g", f"{far}_g"))
        g, e = F.when(is_g, F.col("me")).otherwise(other), F.when(is_g, other).otherwise(F.col("me"))
        gap = F.abs(g["cents"] - e["cents"])
        body = F.struct(gap.alias("gap"), g["head"].alias("g_head"), e["head"].alias("e_head"), g.alias("g"), e.alias("e"))
        return F.when(gap < F.abs(g["cents"]), body)  # null without a partner in reach

    sides = known.select(*day, edge("low", "prev").alias("a"), edge("high", "next").alias("b"))
    best = F.least("a", "b")  # least skips nulls
    tie = F.coalesce((F.col("a.gap") == F.col("b.gap")) & (F.col("a") != F.col("b")), F.lit(False))
    wishes = sides.select(*day, best.alias("best"), tie.alias("tie")).filter("best is not null")
    return (
        wishes.groupBy(*day, F.col("best.g").alias("g"), F.col("best.e").alias("e"))
        .agg(F.count(F.lit(1)).alias("wishes"), F.bool_or("tie").alias("tie"))
        .filter("wishes = 2")
        .withColumn("reach", F.least(F.col("g.size") - F.col("g.used"), F.col("e.size") - F.col("e.used")))
        .withColumn("units", F.when(F.col("tie"), F.lit(1).cast("bigint")).otherwise(F.col("reach")))
        .select(*day, "g", "e", "units")
    )


def by_shift(pending: DataFrame, free: DataFrame, calendar: DataFrame, shift_days: int = 2) -> DataFrame:
    """Pass 5: the same amount on one of the next business days, earliest day first.

    Groups are served by (date, key), each taking the earliest free entry it can reach. Groups of a
    day and entries of a day with one amount are classes, and one fold over the days of an amount says
    how many of which class pair off.
    """
    if shift_days < 1:
        return _no_pairs(pending, free)
    same = ["journal_key", "cents"]
    # the n-th business day after a day is the one whose number is n higher, however far the calendar lists days ahead
    steps = calendar.select(F.col("d").alias("date"), F.explode(F.sequence(F.col("ord") + 1, F.col("ord") + shift_days)).alias("ord"))
    ahead = steps.join(calendar.filter("is_business").select("ord", F.col("d").alias("entry_date")), "ord").drop("ord")
    g = pending.select("journal_key", F.col("ledger_cents").alias("cents"), F.col("date").alias("when"), F.col("group_key").alias("name"))
    e = free.filter("entry_cents is not null").select(
        "journal_key", F.col("entry_cents").alias("cents"), F.col("date").alias("when"), F.col("entry_id").alias("name")
    )
    ahead = ahead.withColumnRenamed("date", "when")
    later = e.select(*same, F.col("when").alias("entry_date")).distinct()
    reachable = materialise(
        g.select(*same, "when").distinct().join(ahead, "when").join(later, [*same, "entry_date"]), "shift-reach"
    )
    if reachable.isEmpty():
        return _no_pairs(pending, free)
    g = g.join(reachable, [*same, "when"], "left_semi").withColumn("side", F.lit("g")).withColumn("day", F.col("when"))
    theirs = reachable.select(*same, F.col("entry_date").alias("when"))
    e = e.join(theirs, [*same, "when"], "left_semi").withColumn("side", F.lit("e")).withColumn("day", F.col("when"))
    members = materialise(_numbered(g, e, [*same, "when"]), "shift-members")
    sizes = members.groupBy(*same, "when", "side").agg(F.count(F.lit(1)).alias("size"))
    gc = sizes.filter("side = 'g'").select(*same, "when", F.col("size").alias("g_size"))
    ec = sizes.filter("side = 'e'").select(*same, F.col("when").alias("entry_date"), F.col("size").alias("e_size"))
    edges = reachable.join(gc, [*same, "when"]).join(ec, [*same, "entry_date"])
    # one row for each two days of an amount, so a group is no larger than the calendar
    edges = edges.select(*same, "when", "entry_date", "g_size", "e_size")
    fields = [edges.schema["when"], edges.schema["entry_date"], *[T.StructField(c, T.LongType()) for c in ("g_used", "e_used", "units")]]
    pairs = materialise(folds.folded(edges, same, folds.earliest_days, fields), "shift-chosen")
    named = _name_units(
        pairs, _side(members, "g", "group_key"), [*same, "when"],
        _side(members, "e", "entry_id").withColumnRenamed("when", "entry_date"), [*same, "entry_date"],
    )
    return named.withColumn("level", F.lit("APPROXIMATE"))


def implied_concepts(has_share: Column) -> Column:
    return F.when(has_share, F.array(*[F.lit(d) for d in DEDUCTIONS])).otherwise(F.array().cast("array<string>"))


def missing_concepts(expected: Column, present: Column, chart: Chart) -> Column:
    """Expected concepts whose account is in the chart but not on the entry."""
    mapped = [F.when(F.array_contains(expected, c) & ~F.array_contains(present, F.lit(code)), F.lit(c))
              for c, (code, _) in chart.accounts.items()]
    return F.array_compact(F.array(*mapped))


def unmapped_concepts(concepts: Column, chart: Chart) -> Column:
    return F.array_except(concepts, F.array(*[F.lit(c) for c in chart.accounts]))


def in_scope(rules: RuleSet | None) -> Column:
    """Channel money: the journal is a channel's, or the counterparty is."""
    if rules is None:
        return F.lit(True)
    theirs = parties.owner(F.col("party"), rules).isNotNull()
    return F.col("journal_key").isin(*rules.channel_keys) | theirs if rules.channel_keys else theirs


def counterpart(rules: RuleSet | None, chart: Chart) -> Column:
    """For a transfer: the journal of the channel that sent it, unless it is this one."""
    if rules is None or not rules.channel_keys:
        return F.lit(None).cast("string")
    channel = parties.owner(F.col("party"), rules)
    known = channel.isin(*[j.key for j in chart.journals])
    return F.when(known & (channel != F.col("journal_key")), channel)


def lines(
    grouped: DataFrame,
    listed: DataFrame,
    matched: DataFrame,
    shares: DataFrame | None,
    chart: Chart,
    rules: RuleSet | None = None,
) -> DataFrame:
    """The report: duplicates, one line per group, and the entries nobody claimed.

    ``shares`` are the deductions of each charge (see lineage.deduction_shares), or None when no
    settlement results are at hand.
    """
    known = grouped
    if shares is not None:
        known = known.join(
            shares.select(F.col("movement_id").alias("charge_id"), "fee_cents", "tax_cents", "withholding_cents"),
            "charge_id", "left",
        )
    else:
        for column in ("fee_cents", "tax_cents", "withholding_cents"):
            known = known.withColumn(column, F.lit(None).cast("bigint"))
    has_share = F.col("fee_cents").isNotNull()

    entry = listed.select(
        "journal_key", "entry_id", F.col("name").alias("entry_name"), F.col("state").alias("entry_state"), "entry_cents", "account_codes"
    )
    hit = known.join(matched, ["journal_key", "group_key"]).join(entry, ["journal_key", "entry_id"])
    delta = F.when(F.col("level") != "AGGREGATED", F.col("entry_cents") - F.col("ledger_cents"))
    expected = F.array_union("concepts", implied_concepts(has_share))
    hit = (
        hit.withColumn("delta_cents", delta)
        .withColumn("missing", missing_concepts(expected, F.col("account_codes"), chart))
    )
    off = F.coalesce(F.col("delta_cents") != 0, F.lit(False))
    status = (
        F.when(F.size("missing") > 0, "INCOMPLETE_ENTRY")
        .when(off, "AMOUNT_MISMATCH")
        .when(F.col("level") == "APPROXIMATE", "DATE_SHIFT")
        .otherwise("MATCHED")
    )
    found_code = (
        F.when(F.col("level") == "REF", "MATCHED_BY_REF").when(F.col("level") == "AGGREGATED", "MATCHED_AGGREGATED")
        .when(F.col("pass") == 5, "DATE_SHIFT").otherwise("MATCHED_EXACT")
    )
    hit = hit.withColumn("status", status).withColumn(
        "codes",
        F.array_compact(
            F.array(
                found_code,
                F.when(F.size("missing") > 0, "INCOMPLETE_ENTRY"),
                F.when(off, "AMOUNT_MISMATCH_ERP"),
                F.when(has_share, "DEDUCTIONS_DERIVED"),
            )
        ),
    )
    columns = [
        "journal_key", "group_key", "status", "level", "entry_id", "entry_name", "entry_state", "date", "descriptor",
        "counterparty", "party", "ledger_cents", "entry_cents", "delta_cents", "concepts", "missing", "codes", "n_movements",
        "first_id", "first_date", "charge_id", "transfer_only", "fee_cents", "tax_cents", "withholding_cents",
    ]
    hit = hit.select(*columns)

    def blank(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(hit.schema[c].dataType).alias(c) for c in columns])

    no_concepts = F.array().cast("array<string>")
    lone = known.join(matched.select("journal_key", "group_key"), ["journal_key", "group_key"], "left_anti")
    lone = lone.withColumn("status", F.lit("MISSING_IN_ERP")).withColumn("level", F.lit("NONE")).withColumn("missing", no_concepts)
    lone = lone.withColumn(
        "codes",
        F.array_compact(
            F.array(
                F.lit("MISSING_IN_ERP"),
                F.when(F.size(unmapped_concepts(F.col("concepts"), chart)) > 0, "NO_ACCOUNT_MAPPING"),
                F.when(F.col("transfer_only") & counterpart(rules, chart).isNull(), "NO_CONTRA_ACCOUNT"),
                F.when(has_share, "DEDUCTIONS_DERIVED"),
            )
        ),
    )
    twice = duplicates(known, listed).withColumn("status", F.lit("DUPLICATE_IN_ERP")).withColumn("level", F.lit("REF"))
    twice = twice.withColumn("missing", no_concepts).withColumn("codes", F.array(F.lit("DUPLICATE_IN_ERP")))
    orphan = orphans(listed, matched).select(
        "journal_key", F.lit("MISSING_IN_LEDGER").alias("status"), F.lit("NONE").alias("level"), "entry_id",
        F.col("name").alias("entry_name"), F.col("state").alias("entry_state"), "date", "entry_cents",
        no_concepts.alias("missing"), F.array(F.lit("MISSING_IN_LEDGER")).alias("codes"),
    )
    return hit.unionByName(blank(lone)).unionByName(blank(twice)).unionByName(blank(orphan))


def orphans(listed: DataFrame, matched: DataFrame) -> DataFrame:
    """Entries no group claimed."""
    return listed.join(matched.select("journal_key", "entry_id"), ["journal_key", "entry_id"], "left_anti")


ERP_STATUSES = (
    "MATCHED", "INCOMPLETE_ENTRY", "AMOUNT_MISMATCH", "DATE_SHIFT", "MISSING_IN_ERP", "MISSING_IN_LEDGER", "DUPLICATE_IN_ERP",
)


def totals(report: DataFrame, grouped: DataFrame, listed: DataFrame) -> DataFrame:
    """Counts and sums per journal: the published figures, and ones that count nothing twice."""
    sums = report.groupBy("journal_key").agg(
        *[F.count(F.when(F.col("status") == s, 1)).alias(s.lower()) for s in ERP_STATUSES],
        F.coalesce(F.sum("ledger_cents"), F.lit(0)).alias("ledger_cents"),
        F.coalesce(F.sum("entry_cents"), F.lit(0)).alias("erp_cents"),
    )
    once_g = grouped.groupBy("journal_key").agg(
        F.count(F.lit(1)).alias("ledger_groups"), F.sum("ledger_cents").alias("ledger_once_cents")
    )
    once_e = listed.groupBy("journal_key").agg(
        F.count(F.lit(1)).alias("erp_entries"), F.coalesce(F.sum("entry_cents"), F.lit(0)).alias("erp_once_cents")
    )
    return (
        sums.join(once_g, "journal_key", "left").join(once_e, "journal_key", "left")
        .na.fill(0, ["ledger_groups", "ledger_once_cents", "erp_entries", "erp_once_cents"])
        .withColumn("unexplained_cents", F.col("erp_cents") - F.col("ledger_cents"))
    )


def view(
    report: DataFrame, show: str = "all", counterparty: str | None = None, start: str | None = None, end: str | None = None
) -> DataFrame:
    """Report lines: matched, problems or one status, of one counterparty, in a range of dates."""
    rows = report
    if show == "matched":
        rows = rows.filter("status = 'MATCHED'")
    elif show == "problems":
        rows = rows.filter("status <> 'MATCHED'")
    elif show != "all":
        rows = rows.filter(F.col("status") == show.upper())
    if counterparty:
        rows = rows.filter(F.col("counterparty") == counterparty)
    if start:
        rows = rows.filter(F.col("date") >= F.to_date(F.lit(start)))
    if end:
        rows = rows.filter(F.col("date") <= F.to_date(F.lit(end)))
    return rows


def counterparties(report: DataFrame) -> DataFrame:
    return report.filter("counterparty is not null").select("counterparty").distinct()
