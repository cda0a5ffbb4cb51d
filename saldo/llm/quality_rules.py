"""Quality rules with thresholds that adapt to each language and source.

Every text is measured once. The measures' distributions per language and source are kept as mergeable quantile
sketches: histograms of log-linear buckets whose relative error is at most 1/64, so that sketches of groups add up to
the sketch of a language or of the corpus. A group's fences lie ``REACH`` quartile distances beyond its quartiles; a
text outside a fence is rejected. A group with fewer than ``MIN_GROUP`` texts uses its language's fences, or else the
corpus's. Sketches hold the texts that pass the base rule, since others never reach the fences.

Defined cases: a null or blank text has no words, zero measures, and fails the base rule. Null language and null source
are groups of their own. Repeated rows count and are judged as often as they occur. An empty table stays empty. Columns
named like a measure are replaced; all others are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saldo.llm.common import stored, table, words

#: Base rule: fixed values.
LEAST_WORDS = 50
MOST_REPEATED_PERCENT = 50

#: Fences lie this many quartile distances beyond the quartiles.
REACH = 3
MIN_GROUP = 30
#: Significant bits of a sketch bucket.
SKETCH_BITS = 7

#: measure (an integer in thousandths), least quartile distance taken, whether it has a lower fence.
MEASURES = (
    ("word_length", 500, True),
    ("symbol_share", 30, False),
    ("dup_line_share", 150, False),
    ("repeat_share", 100, False),
)

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the base measures and the number of lines that have a word. Linear in the text but for one sort."""
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.split(body, "\n"), lambda line: line.rlike("[^\\x20\\x09-\\x0D]"))
    first = docs.withColumns({"__words": words(F.col(text)), "__lines": lines})
    windows = F.when(
        F.size("__words") >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size("__words") - 3),
            lambda i: F.xxhash64(F.get("__words", i), F.get("__words", i + 1), F.get("__words", i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))
    second = first.withColumns(
        {
            "n_words": F.size("__words").cast("bigint"),
            "word_chars": F.length(F.array_join("__words", "")).cast("bigint"),
            "n_symbols": (F.length(body) - F.length(F.regexp_replace(body, "[#*$%&|<>]+", ""))).cast("bigint"),
            "n_lines": F.size("__lines").cast("bigint"),
            "n_dup_lines": (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("bigint"),
            "__windows": windows,
        }
    ).drop("__words", "__lines")
    # only texts that repeat a window sort them, to bring equal ones together
    placed = F.transform("__windows", lambda h, i: F.struct(h.alias("h"), i.alias("at")))
    third = second.withColumn(
        "__sorted", F.when(F.size(F.array_distinct("__windows")) < F.size("__windows"), F.sort_array(placed))
    ).drop("__windows")
    twice = F.filter(
        "__sorted",
        lambda w, i: F.coalesce(F.get("__sorted", i - 1)["h"] == w["h"], F.lit(False))
        | F.coalesce(F.get("__sorted", i + 1)["h"] == w["h"], F.lit(False)),
    )
    fourth = third.withColumn("__at", F.sort_array(F.transform(twice, lambda w: w["at"]))).drop("__sorted")
    # each window covers three words, less where the next one starts sooner
    covered = F.transform(
        "__at", lambda at, i: F.least(F.lit(3), F.coalesce(F.get("__at", i + 1) - at, F.lit(3))).cast("bigint")
    )
    total = F.aggregate(covered, F.lit(0).cast("bigint"), lambda a, x: a + x)
    fifth = fourth.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("bigint"))).drop("__at")
    # filters on the measures stay above the generator; below it they would repeat the expressions they are made of
    made = [*BASE, "n_lines"]
    return fifth.select(*[c for c in fifth.columns if c not in made], F.inline(F.array(F.struct(*made))))


def base_failed() -> Column:
    return (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED_PERCENT * F.col("n_words")
    )


def _shares() -> dict[str, Column]:
    def per(part: str, whole: str) -> Column:
        return F.when(F.col(whole) > 0, F.expr(f"1000 * {part} div {whole}")).otherwise(F.lit(0).cast("bigint"))

    return {
        "word_length": per("word_chars", "n_words"),
        "symbol_share": per("n_symbols", "n_words"),
        "dup_line_share": per("n_dup_lines", "n_lines"),
        "repeat_share": per("n_repeat_words", "n_words"),
    }


def sketches(rows: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """Bucket counts by language, source and measure. Counts are summed before the shuffle, and sketches add up."""
    values = F.array(
        *[F.struct(F.lit(m).alias("measure"), F.col(f"__{m}").alias("value")) for m, _, _ in MEASURES]
    )
    spread = rows.filter(~F.col("base_failed")).select(
        F.col(lang).alias("lang"), F.col(source).alias("source"), F.inline(values)
    )
    cut = F.expr(f"greatest(0, length(bin(value)) - {SKETCH_BITS})")
    bucket = F.expr("shiftleft(shiftright(value, cut), cut)")
    return (
        spread.withColumn("cut", cut)
        .groupBy("lang", "source", "measure", bucket.alias("bucket"))
        .agg(F.count(F.lit(1)).alias("n"))
    )


def fences(sketch: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Lower and upper fence of each measure by ``keys``, one row for each group."""
    merged = sketch.groupBy(*keys, "measure", "bucket").agg(F.sum("n").alias("n"))
    group = Window.partitionBy(*keys, "measure")  # as many rows as a sketch has buckets
    up_to = F.sum("n").over(group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    ranked = merged.withColumns({"up_to": up_to, "total": F.sum("n").over(group)})
    sums = []
    for measure, _, _ in MEASURES:
        mine = F.col("measure") == measure
        for k in (1, 3):
            sums.append(F.min(F.when(mine & (4 * F.col("up_to") >= k * F.col("total")), F.col("bucket"))).alias(f"{measure}_{k}"))
    wide = ranked.groupBy(*keys).agg(F.max("total").alias("texts"), *sums)
    columns = [*keys, "texts"]
    for measure, least, lower in MEASURES:
        reach = REACH * F.greatest(F.col(f"{measure}_3") - F.col(f"{measure}_1"), F.lit(least).cast("bigint"))
        columns.append((F.col(f"{measure}_3") + reach).alias(f"{measure}_high"))
        low = F.col(f"{measure}_1") - reach if lower else F.lit(-1).cast("bigint")
        columns.append(low.alias(f"{measure}_low"))
    return wide.select(*columns)


def judged(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", keep: list[str] | None = None, write: bool = True) -> DataFrame:
    """``docs``' columns ``keep`` (all by default) with the base measures, ``base_failed`` and ``kept``.

    Measures serve twice, for the sketches and for the verdicts: they are written in between, or with ``write=False``
    taken anew, which costs time but no disk where ``keep`` holds whole texts. Fences are joined by group: their
    tables have a row for each group, and whether they are broadcast is decided from the measured size.
    """
    keep = docs.columns if keep is None else keep
    frame = docs.select(*dict.fromkeys([*keep, text, lang, source]))
    keep = [c for c in keep if c not in (*BASE, "base_failed", "kept")]
    rows = measured(frame, text).withColumn("base_failed", base_failed())
    rows = rows.withColumns({f"__{m}": c for m, c in _shares().items()})
    rows = rows.drop(*[c for c in (text,) if c not in keep])
    rows = stored(rows, "measured") if write else rows
    sketch = stored(sketches(rows, lang, source), "sketch")
    joined = rows
    for n, keys in enumerate((("lang", "source"), ("lang",))):
        found = fences(sketch, keys)
        found = found.select(*[F.col(c).alias(f"__{n}_{c}") for c in found.columns])
        same = [F.col({"lang": lang, "source": source}[k]).eqNullSafe(F.col(f"__{n}_{k}")) for k in keys]
        on = same[0]
        for more in same[1:]:
            on = on & more
        joined = joined.join(found, on, "left")
    overall = fences(sketch, ()).first().asDict()  # one row of twelve numbers
    outside = F.lit(False)
    for measure, _, _ in MEASURES:
        for side, beyond in (("high", lambda a, b: a > b), ("low", lambda a, b: a < b)):
            fence = F.coalesce(
                *[F.when(F.col(f"__{n}_texts") >= MIN_GROUP, F.col(f"__{n}_{measure}_{side}")) for n in (0, 1)],
                F.lit(overall[f"{measure}_{side}"]).cast("bigint"),
            )
            outside = outside | F.coalesce(beyond(F.col(f"__{measure}"), fence), F.lit(False))
    out = joined.withColumn("kept", ~F.col("base_failed") & ~outside)
    return out.select(*keep, *BASE, "base_failed", "kept")


def op7_quality_rules(spark: SparkSession, directory: str) -> DataFrame:
    """Measures and verdict of every document."""
    return judged(table(spark, directory, "documents"), keep=["doc_id"])


def quality_stage(spark: SparkSession, docs: DataFrame, directory: str) -> DataFrame:
    """The documents that the rules keep."""
    whole = docs.select(F.struct("*").alias("__doc"), "text", "lang", "source")
    return judged(whole, keep=["__doc"], write=False).filter("kept").select("__doc.*")


def _sql() -> str:
    shares = {
        "word_length": "1000 * word_chars // n_words",
        "symbol_share": "1000 * n_symbols // n_words",
        "dup_line_share": "1000 * n_dup_lines // n_lines",
        "repeat_share": "1000 * n_repeat_words // n_words",
    }
    spread = " union all ".join(f"select doc_id, lang, source, '{m}' as measure, {c} as value from passed" for m, c in shares.items())
    levels = []
    for n, keys in enumerate((("lang", "source"), ("lang",), ())):
        by = "".join(f"{k}, " for k in keys)
        levels.append(f"""level{n} as (
  select {by}measure, max(total) as texts, min(bucket) filter (4 * up_to >= total) as q1, min(bucket) filter (4 * up_to >= 3 * total) as q3
  from (select *, sum(n) over (partition by {by}measure order by bucket) as up_to, sum(n) over (partition by {by}measure) as total
        from (select {by}measure, bucket, count(*) as n from bucketed group by {by}measure, bucket))
  group by {by}measure)""")
    least = " ".join(f"when '{m}' then {v}" for m, v, _ in MEASURES)
    return f"""
with split as (
  select doc_id, lang, source, coalesce(text, '') as text,
    regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') as words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\\x20\\x09-\\x0D]')) as lines
  from documents),
grams as (
  select doc_id, unnest(range(1, len(words) - 1)) as pos, unnest(list_transform(range(1, len(words) - 1), lambda i: words[i:i+2])) as gram
  from split where len(words) >= 3),
found as (select doc_id, pos from (select doc_id, pos, count(*) over (partition by doc_id, gram) as n from grams) where n > 1),
cover as (select doc_id, count(distinct pos + k) as n_repeat_words from found, (select unnest([0, 1, 2]) as k) group by doc_id),
measured as (
  select s.doc_id, lang, source, len(words) as n_words, len(lines) as n_lines,
    coalesce(length(array_to_string(words, '')), 0) as word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
    len(lines) - len(list_distinct(lines)) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words
  from split s left join cover c on s.doc_id = c.doc_id),
based as (select *, n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED_PERCENT} * n_words as base_failed from measured),
passed as (select * from based where not base_failed),
spread as ({spread}),
bucketed as (select *, (value >> greatest(0, length(bin(value)) - {SKETCH_BITS})) << greatest(0, length(bin(value)) - {SKETCH_BITS}) as bucket from spread),
{", ".join(levels)},
outside as (
  select distinct doc_id from (
    select s.doc_id, s.measure, value, case when a.texts >= {MIN_GROUP} then a.q1 when b.texts >= {MIN_GROUP} then b.q1 else c.q1 end as q1,
      case when a.texts >= {MIN_GROUP} then a.q3 when b.texts >= {MIN_GROUP} then b.q3 else c.q3 end as q3,
      case s.measure {least} end as least
    from spread s join level0 a on s.lang is not distinct from a.lang and s.source is not distinct from a.source and s.measure = a.measure
      join level1 b on s.lang is not distinct from b.lang and s.measure = b.measure join level2 c on s.measure = c.measure)
  where value > q3 + {REACH} * greatest(q3 - q1, least)
     or measure = 'word_length' and value < q1 - {REACH} * greatest(q3 - q1, least))
select b.doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols,
  cast(n_dup_lines as bigint) as n_dup_lines, cast(n_repeat_words as bigint) as n_repeat_words, base_failed,
  not base_failed and o.doc_id is null as kept
from based b left join outside o on b.doc_id = o.doc_id"""


SQL = _sql()
