"""Substring dedup by content-defined chunking with a gear rolling hash.

Chunks are cut at word starts where the gear hash of the sixteen bytes before is the least among the neighbouring
``NEAR`` word starts on either side. Cuts depend on near-by bytes alone, so an insertion moves only the cuts beside it
and a passage is cut alike wherever it stands, but for its ends. Chunks are compared by 128-bit digest. A chunk stays in
the document with the smallest id that has it; elsewhere it is a copy. Neighbouring copies make a run where the two stand
side by side in an earlier document too, and a run of at least ``LEAST_WORDS`` words is removed: a passage of over fifty
words keeps such a run between its ends, and chunks of unrelated documents make none.

Only digests with their smallest and largest id are aggregated, partially before the shuffle, so a passage that many
documents share is a few rows per task; the join back may be split by AQE.

Defined cases: null and blank texts have no chunks. Texts of fewer than ``LEAST_WORDS`` words hold no run and stay as they
are. Repeats inside one document stay. Rows that share id and text are one document and get the same result; rows without
an id are one document, that comes last. Words of over 256 bytes are cut inside by the same hash; a stretch without a cut
is cut every ``MOST_WORDS`` words. Columns of other names are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saldo.llm.common import stored, table

NEAR = 3
LEAST_WORDS = 20
MOST_WORDS = 64
LONG_WORD = 256
SLICE = 1 << 20
LOOK_BACK = 16
#: Spreads the gear hash over all bits before it is compared.
MIX = np.uint32(0x9E3779B1)
PAIR_MIX = np.uint64(0x9E3779B97F4A7C15)

CHUNKS = "doc bigint, copy bigint, start int, stop int, words int, hi bigint, lo bigint, pair bigint"
#: In place of a digest's first half, for the hash of a chunk and the one before it.
PAIRED = -1


def gear_table() -> np.ndarray:
    """256 random-looking 32-bit numbers, one for each byte, from BLAKE2."""
    return np.array([int.from_bytes(blake2b(bytes([n]), digest_size=4, person=b"gear").digest(), "little") for n in range(256)], np.uint32)


def word_starts(body: bytes, gear: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Offsets of the word starts and the mixed gear hash of the bytes before each."""
    offsets, values = [], []
    for at in range(0, len(body), SLICE):
        begin = max(0, at - LOOK_BACK)
        part = np.frombuffer(body, np.uint8, min(len(body), at + SLICE) - begin, begin)
        rolled = gear[part]
        for step in (1, 2, 4, 8):
            older = rolled[:-step] << np.uint32(step)
            rolled[step:] += older
        blank = (part == 32) | ((part >= 9) & (part <= 13))
        before = np.concatenate([[begin == 0], blank[:-1]])
        found = np.flatnonzero(~blank & before)
        found = found[found >= at - begin]
        if not len(found) or len(part) > len(found) * LONG_WORD // 4 or np.diff(found, append=len(part)).max() > LONG_WORD:
            chosen = rolled * MIX < np.uint32(1 << 27)  # one byte in 32
            inside = ~blank & ((part & 0xC0) != 0x80) & np.concatenate([[False], chosen[:-1]])
            run = np.arange(len(part)) - np.maximum.accumulate(np.where(blank, np.arange(len(part)), -1))
            found = np.union1d(found, np.flatnonzero(inside & (run > LONG_WORD)))
            found = found[found >= at - begin]
        hashed = np.where(found > 0, rolled[found - 1], np.uint32(0)) * MIX
        offsets.append(found + begin)
        values.append(hashed)
    if not offsets:
        return np.zeros(0, np.int64), np.zeros(0, np.uint32)
    return np.concatenate(offsets), np.concatenate(values)


def cuts(values: np.ndarray) -> np.ndarray:
    """Which word starts begin a chunk: the first, and those whose value is least among NEAR on either side."""
    n = len(values)
    least = np.ones(n, bool)
    for step in range(1, NEAR + 1):
        least[step:] &= values[step:] < values[:-step]
        least[:-step] &= values[:-step] <= values[step:]
    least[0] = True
    chosen = np.flatnonzero(least)
    gaps = np.diff(chosen, append=n)
    if gaps.max() > MOST_WORDS:
        more = [np.arange(a + MOST_WORDS, a + g, MOST_WORDS) for a, g in zip(chosen, gaps, strict=True) if g > MOST_WORDS]
        chosen = np.sort(np.concatenate([chosen, *more]))
    return chosen


def chunked(text: str | None, gear: np.ndarray, least_words: int = LEAST_WORDS):
    """Arrays (start, stop, words, digests) of a text's chunks, offsets in characters; none for a short text."""
    if not text:
        return None
    body = text.encode("utf-8", "surrogatepass")
    starts, values = word_starts(body, gear)
    if len(starts) < least_words:
        return None
    chosen = cuts(values)
    begin = starts[chosen]
    stop = np.append(begin[1:], len(body))
    words = np.diff(chosen, append=len(starts))
    if len(body) == len(text):
        first, last = begin, stop
    else:
        lead = np.cumsum((np.frombuffer(body, np.uint8) & 0xC0) != 0x80, dtype=np.int32)
        first = lead[begin] - 1
        last = np.append(first[1:], len(text))
    digests = b"".join(
        [blake2b(body[a:b].rstrip(), digest_size=16).digest() for a, b in zip(begin.tolist(), stop.tolist(), strict=True)]
    )
    return first, last, words, np.frombuffer(digests, "<i8").reshape(-1, 2)


def pairs(digests: np.ndarray, owners: np.ndarray) -> np.ndarray:
    """A hash of each chunk with the one before it in its text; the first chunk of a text has its own."""
    parts = digests.astype("<i8").view("<u8")
    mixed = parts[:, 1].copy()
    goes_on = owners[1:] == owners[:-1]
    mixed[1:] ^= np.where(goes_on, (parts[:-1, 0] + parts[:-1, 1]) * PAIR_MIX, np.uint64(0))
    mixed *= PAIR_MIX
    return (mixed ^ (mixed >> np.uint64(32))).view("<i8")


def chunks(docs: DataFrame, doc: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """One row for each chunk of a document's text."""
    frame = docs.select(F.col(doc).cast("bigint").alias("doc"), text_key(F.col(text)).alias("copy"), F.col(text).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gear = gear_table()
        names = [field.split()[0] for field in CHUNKS.split(", ")]
        for batch in batches:
            found, owner = [], []
            for n, body in enumerate(batch.column("text")):
                made = chunked(body.as_py(), gear, least_words)
                if made is not None:
                    found.append(made)
                    owner.append((n, len(made[0])))
            if not found:
                continue
            owners = np.repeat([n for n, _ in owner], [k for _, k in owner])
            rows = pa.array(owners)
            ends = [np.concatenate([f[i] for f in found]).astype(np.int32) for i in range(3)]
            digests = np.concatenate([f[3] for f in found])
            columns = [batch.column("doc").take(rows), batch.column("copy").take(rows)]
            columns += [pa.array(e) for e in ends] + [pa.array(np.ascontiguousarray(digests[:, i])) for i in (0, 1)]
            columns.append(pa.array(pairs(digests, owners), pa.int64()))
            made = pa.RecordBatch.from_arrays(columns, names=names)
            for at in range(0, made.num_rows, 65536):
                yield made.slice(at, 65536)

    return frame.mapInArrow(cut, CHUNKS)


def text_key(text: Column) -> Column:
    """Tells rows of equal id but different text apart."""
    return F.xxhash64(text)


def duplicate_runs(docs: DataFrame, doc: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc, copy, start, stop, words, first_docs): the runs of each document whose chunks stand in earlier documents."""
    rows = chunks(docs, doc, text, least_words)  # cut twice rather than written: once to count, once to compare
    counted = rows.select("doc", F.inline(F.array(F.struct("hi", "lo"), F.struct(F.lit(PAIRED).cast("bigint").alias("hi"), F.col("pair").alias("lo")))))
    ids = counted.groupBy("hi", "lo").agg(F.min("doc").alias("least"), F.max("doc").alias("most"), F.max(F.col("doc").isNull()).alias("unknown"))
    shared = ids.filter((F.col("least") < F.col("most")) | (F.col("unknown") & F.col("least").isNotNull()))
    shared = stored(shared.select(F.col("hi").alias("s_hi"), F.col("lo").alias("s_lo"), F.col("least").alias("first")), "shared-chunks")
    on = (F.col("hi") == F.col("s_hi")) & (F.col("lo") == F.col("s_lo")) & ~F.col("doc").eqNullSafe(F.col("first"))
    copies = rows.join(shared, on).select("doc", "copy", "start", "stop", "words", "first", "pair")
    beside = shared.filter(F.col("s_hi") == PAIRED).select(F.col("s_lo").alias("pair"), F.col("first").alias("pair_first"))
    copies = copies.join(beside, "pair", "left").withColumn("goes_on", F.coalesce(~F.col("doc").eqNullSafe(F.col("pair_first")) & F.col("pair_first").isNotNull(), F.lit(False)))
    copies = copies.select("doc", "copy", "start", "stop", "words", "first", "goes_on").distinct()  # rows that repeat id and text
    # the copies of one document, at most its own chunks; a run goes on where the chunk before stops, if an earlier document has both
    order = Window.partitionBy("doc", "copy").orderBy("start")
    runs = copies.withColumn("opens", ~(F.lag("stop").over(order).eqNullSafe(F.col("start")) & F.col("goes_on")))
    runs = runs.withColumn("run", F.count(F.when(F.col("opens"), 1)).over(order))
    runs = runs.groupBy("doc", "copy", "run").agg(
        F.min("start").alias("start"),
        F.max("stop").alias("stop"),
        F.sum("words").alias("words"),
        F.sort_array(F.collect_set("first")).alias("first_docs"),
    )
    return runs.filter(F.col("words") >= least_words).drop("run")


def deduplicated(docs: DataFrame, doc: str = "doc_id", text: str = "text", least_words: int = LEAST_WORDS) -> DataFrame:
    """``docs`` with the duplicate runs cut out of ``text``."""
    runs = duplicate_runs(docs, doc, text, least_words)
    spans = runs.groupBy("doc", "copy").agg(F.sort_array(F.collect_list(F.struct("start", "stop"))).alias("__spans"))
    spans = spans.select(F.col("doc").alias("__doc"), F.col("copy").alias("__copy"), "__spans")
    on = F.col(doc).cast("bigint").eqNullSafe(F.col("__doc")) & (text_key(F.col(text)) == F.col("__copy"))
    joined = docs.join(spans, on, "left")
    size = F.size("__spans")
    pieces = F.transform(
        F.sequence(F.lit(0), size),
        lambda i: F.substring(
            F.col(text),
            F.coalesce(F.get("__spans", i - 1)["stop"], F.lit(0)) + 1,
            F.coalesce(F.get("__spans", i)["start"], F.length(F.col(text))) - F.coalesce(F.get("__spans", i - 1)["stop"], F.lit(0)),
        ),
    )
    left = F.when(F.col("__spans").isNull(), F.col(text)).otherwise(F.array_join(pieces, ""))
    return joined.withColumn(text, left).drop("__doc", "__copy", "__spans")


def op8_chunk_dedup(spark: SparkSession, directory: str) -> DataFrame:
    """Every passage that an earlier document has: where it stands and the documents that keep it."""
    runs = duplicate_runs(table(spark, directory, "documents"))
    return runs.select(
        F.col("doc").alias("doc_id"),
        F.element_at("first_docs", 1).alias("first_doc_id"),
        F.col("first_docs").alias("first_doc_ids"),
        F.col("start").cast("bigint").alias("start_char"),
        F.col("stop").cast("bigint").alias("stop_char"),
        F.col("words").cast("bigint").alias("n_words"),
    )


def chunk_dedup_stage(spark: SparkSession, docs: DataFrame, directory: str) -> DataFrame:
    """The documents without passages that earlier documents have."""
    return deduplicated(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)
