"""Spelling variants by permuterm rotations.

Every word is marked with a terminator and turned to each of its rotations. A rotation that ends in an edited character has
all the others as its prefix, so words that differ by one replaced character share such a prefix, and a word that lacks
that character has the prefix itself as a rotation. Rotations are dealt and sorted by prefix; the scan of a group, at most
one word for each character of the alphabet and one without it, gives each member the number of its neighbours there
and the most frequent one, without writing pairs. A character that repeats the one before it is not counted as deleted
again, so a pair meets once. Prefixes of over ``LONG`` characters are held as MD5 digests.

A word's form is its neighbour of largest count if that is at least ``ratio`` times its own; counts grow along forms by
that ratio, so the way to the last, the root, is short and is followed by pointer doubling.

Counts of words leave each task as sums, so a frequent word is one row for each task.

Defined cases: null and empty texts have no words; a text may be of any length, its words are taken in pieces. Rows are
counted as they stand, repeated ones again; a null id reads ``null``. Equally frequent neighbours are taken in code-point
order. Words without neighbours have count 0, no form, and are their own root. An empty table gives no words. Columns other
than the named ones are left out.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saldo.llm.common import stored, table

#: Letters of words after A-Z are lower-cased: a fixed value.
LETTERS = "a-zÀ-ÿ"
LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5
#: One run of a document in so many loses a character, for the query: a fixed value.
DROP_EVERY = 199
TERMINATOR = "$"
LONG = 200
#: Distinct words a task holds before it hands on their counts, and words taken from a long text at a time.
HELD = 300_000
PIECE = 1 << 18


def without_one(run: str, base: int, drop_every: int) -> str:
    """``run``, less one code point if ``drop_every`` divides the CRC-32 that continues ``base``."""
    h = zlib.crc32(run.encode(), base)
    if h % drop_every:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1 :]


def word_counts(
    docs: DataFrame,
    doc: str = "doc_id",
    text: str = "text",
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    drop_every: int | None = None,
) -> DataFrame:
    """(word, n): the maximal runs of letters with at least so many code points and occurrences.

    With ``drop_every`` one run of a document in so many is misspelt first, by a hash of id and run.
    """
    if least_length < 1:
        raise ValueError("least_length must be positive")
    frame = docs.select(F.coalesce(F.col(doc).cast("string"), F.lit("null")).alias("doc"), F.col(text).alias("text"))
    letters = f"[{LETTERS}]{{{least_length},}}"  # shorter runs can't get longer

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pattern, held = re.compile(letters), Counter()

        def handed_on() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], ["word", "k"])
            held.clear()
            return made

        for batch in batches:
            for name, body in zip(batch.column("doc").to_pylist(), batch.column("text"), strict=True):
                body = body.as_py()
                if not body:
                    continue
                lower = body.encode().lower().decode()  # of bytes, so A-Z alone
                if len(lower) < PIECE:
                    pieces = [pattern.findall(lower)]
                else:
                    found = (m.group() for m in pattern.finditer(lower))
                    pieces = iter(lambda found=found: list(islice(found, PIECE // 8)), [])
                base = zlib.crc32(f"{name}:".encode())
                for piece in pieces:
                    if drop_every is None:
                        held.update(piece)
                    else:
                        for run, k in Counter(piece).items():
                            held[without_one(run, base, drop_every)] += k
                    if len(held) > HELD:
                        yield handed_on()
        if held:
            yield handed_on()

    counted = frame.mapInArrow(count, "word string, k bigint").groupBy("word").agg(F.sum("k").alias("n"))
    return counted.filter((F.col("n") >= least_count) & (F.length("word") >= least_length))


def rotations(words: DataFrame) -> DataFrame:
    """(prefix, word, n, whole, fresh): for each place of a word, the rotation that starts behind it without the character
    there, and the whole rotation that starts at it.

    ``fresh`` marks a character unlike the one before it: the one place where a run of equal characters is shortened.
    """
    word, at = F.col("word"), F.col("at")
    ends = F.concat(F.lit(TERMINATOR), F.substr(word, F.lit(1), at))
    letter = F.substr(word, at + 1, F.lit(1))
    fresh = (at == 0) | (letter != F.substr(word, at, F.lit(1)))

    def row(prefix: Column, whole: bool, fresh: Column) -> Column:
        held = F.when(F.length(prefix) > LONG, F.md5(prefix)).otherwise(prefix)
        return F.struct(held.alias("prefix"), F.lit(whole).alias("whole"), fresh.alias("fresh"))

    cut = row(F.concat(F.substr(word, at + 2), ends), False, fresh)
    uncut = row(F.concat(F.substr(word, at + 1), ends), True, F.lit(False))
    placed = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word"))).alias("at"))
    both = F.when(at < F.length(word), F.array(cut, uncut)).otherwise(F.array(uncut))
    return placed.select("word", "n", F.explode(both).alias("r")).select("r.*", "word", "n")


def near_words(words: DataFrame) -> DataFrame:
    """(word, n_near, near_n, near): of each word that has neighbours, their number and the most frequent one."""
    group = Window.partitionBy("prefix").orderBy(F.desc("n"), "word").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    me = F.struct((-F.col("n")).alias("n"), F.col("word").alias("word"))
    is_cut = ~F.col("whole")
    seen = rotations(words).select(
        "word",
        "whole",
        "fresh",
        me.alias("me"),
        F.count(F.when(is_cut, 1)).over(group).alias("cuts"),
        F.first(F.when(is_cut, me), ignorenulls=True).over(group).alias("first"),
        F.nth_value(F.when(is_cut, me), 2, ignoreNulls=True).over(group).alias("second"),
        F.count(F.when(F.col("fresh"), 1)).over(group).alias("longer"),
        F.first(F.when(F.col("fresh"), me), ignorenulls=True).over(group).alias("longest"),
        F.first(F.when(F.col("whole"), me), ignorenulls=True).over(group).alias("shorter"),
    )
    shorter = F.when(F.col("fresh"), F.col("shorter"))
    other = F.when(F.col("first") == F.col("me"), F.col("second")).otherwise(F.col("first"))
    found = seen.select(
        "word",
        F.when(F.col("whole"), F.col("longer")).otherwise(F.col("cuts") - 1 + F.when(shorter.isNotNull(), 1).otherwise(0)).alias("near"),
        F.when(F.col("whole"), F.col("longest")).otherwise(F.least(other, shorter)).alias("best"),
    )
    found = found.filter("near > 0").groupBy("word").agg(F.sum("near").alias("n_near"), F.min("best").alias("best"))
    return found.select("word", "n_near", (-F.col("best.n")).alias("near_n"), F.col("best.word").alias("near"))


def followed(links: DataFrame) -> DataFrame:
    """(word, root) for the rows of ``links`` (word, form): where following forms ends. No circles."""
    now = stored(links.select("word", F.col("form").alias("root")), "forms")
    while True:
        ahead = now.select(F.col("word").alias("__word"), F.col("root").alias("__root"))
        step = now.join(ahead, F.col("root") == F.col("__word"), "left")
        step = stored(step.select("word", F.coalesce("__root", "root").alias("root"), F.col("__root").isNotNull().alias("moved")), "forms")
        now = step.drop("moved")
        if step.filter("moved").isEmpty():
            return now


def variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for every row of ``words`` (word, n; words are distinct)."""
    words = stored(words.select("word", "n"), "words")
    near = near_words(words).withColumnRenamed("word", "__word")
    joined = words.join(near, F.col("word") == F.col("__word"), "left")
    better = F.col("near_n") >= ratio * F.col("n")
    joined = stored(
        joined.select(
            "word",
            F.when(better, F.col("near")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"),
            F.when(better, F.col("near_n")).alias("form_n"),
        ),
        "variants",
    )
    roots = followed(joined.filter("form is not null")).withColumnRenamed("word", "__word")
    result = joined.join(roots, F.col("word") == F.col("__word"), "left")
    return result.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark: SparkSession, directory: str) -> DataFrame:
    """The words of all documents, some misspelt, each with its neighbours, its form and its root."""
    return variants(word_counts(table(spark, directory, "documents"), drop_every=DROP_EVERY))
