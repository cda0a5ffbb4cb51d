"""Mixing sources to target weights by hash thresholds.

Every text has a 60-bit hash. A source takes all its texts some whole times and those below a hash threshold once
more. The threshold comes from nested histograms: sizes are summed by source and bucket of the hash's top bits, the
budget's boundary bucket is found from the sums, and only that bucket is split by the next bits, until it holds one
hash value. Texts are never sorted, and taking is a filter.

Defined cases: a null text has size 0. Null is a source of its own, last in order. The hash covers id and text, so
repeated rows (same id, same text) are taken together; a null id is hashed as such. The boundary hash is taken if that
brings the source nearer to its target. Empty sources, and an empty table, take nothing. Columns named like an output
are replaced; all others are kept.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saldo.llm.common import stored, table, words
from saldo.operators.ranking import ranked

#: Weights of the sources in code-point order, repeating: fixed values.
WEIGHTS = (1, 2, 3)
#: A source is taken at most so many times: fixed value.
MOST_TIMES = 3
HASH_BITS = 60
LEVEL_BITS = 12


def hash60(seed: str, doc: Column, text: Column) -> Column:
    """The first fifteen hex digits of an MD5 over seed, id and text."""
    key = F.concat(F.lit(f"{seed}|"), F.coalesce(doc.cast("string"), F.lit("null")), F.lit("|"), F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, HASH_BITS // 4), 16, 10).cast("bigint")


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size) with rank-given weights and the target each source gets of the total.

    What a source cannot take is shared again by weight. A round needs three sums; rounds end when no further source
    is full, after a few rounds for any number of sources.
    """
    known = sizes.withColumn("__null", F.col("source").isNull())
    order = ranked(known.withColumn("__all", F.lit(0)), ["__all"], [F.col("__null"), F.col("source")], out="__place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("__place") - 1).cast("int") % len(weights) + 1)
    sources = stored(order.select("source", "source_size", weight.cast("bigint").alias("weight")), "sources")
    cap = F.col("source_size") * MOST_TIMES
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    share, full = 0.0, -1
    while True:
        is_full = F.lit(False) if full < 0 else cap <= share * F.col("weight")
        capped, weighing, count = sources.agg(
            F.coalesce(F.sum(F.when(is_full, cap)), F.lit(0)),
            F.coalesce(F.sum(F.when(~is_full, F.col("weight"))), F.lit(0)),
            F.count(F.when(is_full, 1)),
        ).first()
        if count == full or not weighing:
            break
        share, full = float(total - capped) / float(weighing), count
    aim = F.least(cap.cast("double"), F.lit(share) * F.col("weight"))
    return sources.withColumn("target", aim)


def thresholds(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, source_size, target, times, below): take all rows ``times`` times and those with a hash under ``below`` once more."""
    times = F.when(
        F.col("target") >= MOST_TIMES * F.col("source_size"), F.when(F.col("source_size") > 0, MOST_TIMES).otherwise(0)
    ).otherwise(F.floor(F.col("target") / F.col("source_size")))
    plan = sources.withColumn("times", times.cast("bigint"))
    plan = plan.withColumn("rest", F.greatest(F.lit(0.0), F.col("target") - F.col("times") * F.col("source_size")))
    plan = stored(plan, "mix-plan")
    # open: sources whose boundary bucket still has to be split, with what lies below the bucket and the budget left in it
    opened = plan.filter("rest > 0").select(F.col("source").alias("of"), F.lit(0).cast("bigint").alias("prefix"), F.col("rest").alias("left"))
    closed = None
    for level in range(math.ceil(HASH_BITS / LEVEL_BITS)):
        bits = HASH_BITS - LEVEL_BITS * (level + 1)
        bucket = F.shiftright("hash", bits)
        inside = rows if level == 0 else rows.withColumn("__upper", F.shiftright("hash", bits + LEVEL_BITS))
        on = F.col("source").eqNullSafe(F.col("of"))
        inside = inside.join(opened, on if level == 0 else on & (F.col("__upper") == F.col("prefix")))
        histogram = inside.groupBy("of", "left", bucket.alias("bucket")).agg(
            F.sum("size").alias("words"), F.min("hash").alias("lowest"), F.max("hash").alias("highest")
        )
        group = Window.partitionBy("of").orderBy("bucket")  # at most 2 ** LEVEL_BITS rows
        histogram = histogram.withColumn("up_to", F.sum("words").over(group.rowsBetween(Window.unboundedPreceding, 0)))
        # a source whose rest covers all that is left has no boundary; its own rest is under its size, so level 0 has one
        boundary = histogram.filter((F.col("up_to") > F.col("left")) & (F.col("up_to") - F.col("words") <= F.col("left")))
        boundary = boundary.withColumn("left", F.col("left") - (F.col("up_to") - F.col("words")))
        boundary = stored(boundary.select("of", "bucket", "left", "words", "lowest", "highest"), "mix-boundary")
        single = F.col("lowest") == F.col("highest")
        nearer = F.col("words") - F.col("left") < F.col("left")
        found = boundary.filter(single).select("of", F.when(nearer, F.col("lowest") + 1).otherwise(F.col("lowest")).alias("below"))
        closed = found if closed is None else closed.unionByName(found)
        opened = boundary.filter(~single).select("of", F.col("bucket").alias("prefix"), "left")
        if opened.isEmpty():
            break
    joined = plan.join(closed, F.col("source").eqNullSafe(F.col("of")), "left")
    return joined.select("source", "source_size", "target", "times", F.coalesce("below", F.lit(0)).cast("bigint").alias("below"))


def mixed(
    docs: DataFrame, text: str = "text", source: str = "source", doc: str = "doc_id", seed: str = "mix", keep: list[str] | None = None
) -> DataFrame:
    """``docs``' columns ``keep`` (all by default) with size, source_size, target and ``taken`` words.

    Sizes and hashes are written for the sums and histograms, and taken anew for the rows themselves, whose texts are
    not written again. The sources' table is joined by
    source: broadcast if its measured size allows, else a shuffle whose hot sources AQE splits.
    """
    keep = docs.columns if keep is None else keep
    size = F.size(words(F.col(text))).cast("bigint")
    own = {"source": F.col(source), "size": size, "hash": hash60(seed, F.col(doc), F.col(text))}
    rows = stored(docs.select(*[c.alias(k) for k, c in own.items()]), "mix-sizes")
    named = docs.select(*[F.col(c) for c in keep], *[c.alias(f"__{k}") for k, c in own.items()])
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")))
    plan = stored(thresholds(rows, sources), "mix-thresholds")
    plan = plan.select(*[F.col(c).alias(f"__p_{c}") for c in plan.columns])
    joined = named.join(plan, F.col("__source").eqNullSafe(F.col("__p_source")))
    times = F.col("__p_times") + F.when(F.col("__hash") < F.col("__p_below"), 1).otherwise(0)
    outputs = {
        "size": F.col("__size"),
        "source_size": F.col("__p_source_size"),
        "target": F.col("__p_target"),
        "taken": (F.col("__size") * times).cast("bigint"),
        "__times": times.cast("int"),
    }
    return joined.select(*[F.col(c) for c in keep if c not in outputs], *[c.alias(k) for k, c in outputs.items()])


def op10_source_mix(spark: SparkSession, directory: str) -> DataFrame:
    """What the mix takes of every document."""
    result = mixed(table(spark, directory, "documents"), keep=["doc_id"])
    return result.drop("__times")


def mix_stage(spark: SparkSession, docs: DataFrame, directory: str) -> DataFrame:
    """The mixed corpus: each document as often as it is taken."""
    rows = mixed(docs.select(F.struct("*").alias("__doc"), "text", "source", "doc_id"), keep=["__doc"])
    rows = rows.filter("__times > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times"))))
    return rows.select("__doc.*")


SQL = f"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as size,
    cast('0x' || substr(md5('mix|' || coalesce(cast(doc_id as varchar), 'null') || '|' || coalesce(text, '')), 1, 15) as bigint) as hash
  from documents),
weighed as (
  select *, 1 + (row_number() over (order by source is null, source) - 1) % 3 as weight, {MOST_TIMES} * source_size as cap
  from (select source, sum(size) as source_size from sized group by source)),
filled as (
  select *, (sum(source_size) over () - coalesce(sum(cap) over before, 0))::double / (sum(weight) over () - coalesce(sum(weight) over before, 0)) as share
  from weighed window before as (order by cap / weight, source rows between unbounded preceding and 1 preceding)),
aimed as (
  select source, source_size, least(cap::double, weight * (select share from filled where share * weight <= cap order by cap / weight, source limit 1)) as target
  from filled),
planned as (
  select *, case when target >= {MOST_TIMES} * source_size then {MOST_TIMES} else floor(target / source_size) end as times,
  from aimed where source_size > 0),
summed as (
  select s.*, p.source_size, p.target, coalesce(p.times, 0) as times, greatest(0, p.target - p.times * p.source_size) as rest,
    sum(size) over (partition by s.source order by hash) as up_to, sum(size) over (partition by s.source, hash) as alike
  from sized s left join planned p on s.source is not distinct from p.source)
select doc_id, size, cast(coalesce(source_size, 0) as bigint) as source_size, coalesce(target, 0) as target,
  cast(size * (times + case when rest > 0 and (up_to <= rest or (up_to - alike <= rest and up_to - rest < rest - (up_to - alike))) then 1 else 0 end)
    as bigint) as taken
from summed"""
