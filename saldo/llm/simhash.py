"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into three segments, so that of two fingerprints with at most four differing bits one
segment differs in at most one bit. Each segment is indexed once for each of its bits, with that bit left out: 64
signatures. Segments that differ in one bit at most share a signature, so equal signatures find every linked pair, and
a comparison of the whole fingerprints keeps the true ones. Only distinct fingerprints are joined, so copies of any
number cost one row; a pair is kept at its first common signature alone. Beyond ``WIDE_FROM`` distinct fingerprints
a signature also names one of five equal pieces of the other two segments (four differing bits leave one piece equal),
which keeps buckets small; the pairs found are the same.

Defined cases: a null or blank text has fingerprint zero and is linked like any other. A text under four words is one
shingle. Repeated rows share their fingerprint. A null id never names a component unless all its ids are null. An empty
table has no rows. Columns named like an output are replaced; others are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saldo.llm.common import stored, table
from saldo.llm.components import components

SHINGLE = 4
SEED = 42
LINKED_BITS = 4
#: (offset, width) of the segments.
SEGMENTS = ((0, 22), (22, 21), (43, 21))
PIECES = 5
WIDE_FROM = 20_000_000
#: A text is worked through in slices of about so many bytes.
SLICE = 1 << 20


def _slices(body: bytes) -> Iterator[list[bytes]]:
    """The words of a text slice by slice; each slice starts with the last three words of the one before."""
    kept: list[bytes] = []
    at = 0
    while at < len(body):
        end = at + SLICE
        while end < len(body) and body[end] not in b" \t\n\x0b\x0c\r":
            end += 1
        found = kept + body[at:end].split()
        at = end
        if len(found) < SHINGLE and at < len(body):
            kept = found
            continue
        yield found
        kept = found[-(SHINGLE - 1) :]


def fingerprint(text: str | None) -> int:
    """The fingerprint as a signed 64-bit integer."""
    patterns = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)
    ones, total = np.zeros((8, 8), np.int64), 0
    for words in _slices((text or "").encode("utf-8", "surrogatepass").lower()):
        if not words:
            continue
        if len(words) < SHINGLE and total:
            continue  # what is left after the last full shingle
        width = min(SHINGLE, len(words))
        line = b" ".join(words)
        ends = np.cumsum([len(w) + 1 for w in words])
        starts = np.concatenate([[0], ends[: len(words) - width]]).tolist()
        stops = (ends[width - 1 :] - 1).tolist()
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(line[a:b], SEED) for a, b in zip(starts, stops, strict=True)], np.uint64)
        octets = hashes.view(np.uint8).reshape(-1, 8)
        for n in range(8):
            ones[n] += np.bincount(octets[:, n], minlength=256) @ patterns
        total += len(hashes)
    bits = (2 * ones > total).astype(np.uint8).reshape(-1)
    return int(np.packbits(bits, bitorder="little").view(np.int64)[0])


def fingerprinted(docs: DataFrame, text: str = "text", out: str = "__fp") -> DataFrame:
    """``docs`` with the fingerprint of each text as a bigint."""
    kept = [c for c in docs.columns if c != out]
    schema = T.StructType([*docs.select(*kept).schema.fields, T.StructField(out, T.LongType())])

    def add(batches):
        for batch in batches:
            prints = [fingerprint(t.as_py()) for t in batch.column(text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(prints, pa.int64())], names=[*batch.schema.names, out])

    return docs.select(*kept).mapInArrow(add, schema)


def _part(value: Column, offset: int, width: int) -> Column:
    return F.shiftrightunsigned(value, offset).bitwiseAND(F.lit((1 << width) - 1).cast("bigint"))


def _rest(value: Column, offset: int, width: int) -> Column:
    """The bits outside a segment, closed up."""
    low = value.bitwiseAND(F.lit((1 << offset) - 1).cast("bigint"))
    high = F.shiftrightunsigned(value, offset + width) if offset + width < 64 else F.lit(0).cast("bigint")
    return low.bitwiseOR(F.shiftleft(high, offset))


def _cuts(width: int) -> list[tuple[int, int]]:
    """PIECES nearly equal pieces of the bits outside a segment."""
    bounds = [(64 - width) * n // PIECES for n in range(PIECES + 1)]
    return [(a, b - a) for a, b in zip(bounds, bounds[1:], strict=False)]


def signatures(value: Column, wide: bool) -> Column:
    """All signatures of a fingerprint. From the top: left-out bit (and piece), segment value (and piece value)."""
    found = []
    for offset, width in SEGMENTS:
        for bit in range(width):
            segment = _part(value, offset, width).bitwiseAND(F.lit(((1 << width) - 1) & ~(1 << bit)).cast("bigint"))
            if not wide:
                found.append(segment.bitwiseOR(F.lit((offset + bit) << 22)).cast("int"))
                continue
            for n, (at, size) in enumerate(_cuts(width)):
                code = ((offset + bit) * PIECES + n) << 32
                piece = _part(_rest(value, offset, width), at, size)
                found.append(F.shiftleft(segment, 9).bitwiseOR(piece).bitwiseOR(F.lit(code).cast("bigint")))
    return F.array(*found)


def _first_common(key: Column, differ: Column, wide: bool) -> Column:
    """Whether ``key`` is the first signature that a pair shares, so that each pair is kept once."""
    bit = F.floor(F.shiftright(key, 32) / PIECES).cast("int") if wide else F.shiftright(key, 22)
    first = F.lit(False)
    near = F.lit(True)  # no earlier segment was near
    for offset, width in SEGMENTS:
        inside = (bit >= offset) & (bit < offset + width)
        at_bit = (bit == offset) | (F.expr("shiftrightunsigned(a ^ b, bit)").bitwiseAND(F.lit(1).cast("bigint")) == 1)
        here = inside & near & at_bit
        if wide:
            piece = F.shiftright(key, 32) % PIECES
            unlike = F.lit(True)
            chosen = F.lit(False)
            for n, (at, size) in enumerate(_cuts(width)):
                chosen = chosen | ((piece == n) & unlike)
                unlike = unlike & (_part(_rest(differ, offset, width), at, size) != 0)
            here = here & chosen
        first = first | here
        near = near & (F.bit_count(_part(differ, offset, width)) > 1)
    return first


def linked_pairs(prints: DataFrame, wide: bool | None = None) -> DataFrame:
    """(u, v): all pairs of distinct fingerprints (column ``__fp``) with at most four differing bits, each once."""
    wide = prints.count() > WIDE_FROM if wide is None else wide
    index = prints.select(F.col("__fp").alias("a"), F.explode(signatures(F.col("__fp"), wide)).alias("key"))
    other = prints.select(F.col("__fp").alias("b"), F.explode(signatures(F.col("__fp"), wide)).alias("other"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    bit = "cast(floor(shiftright(key, 32) / 5) as int)" if wide else "shiftright(key, 22)"
    first = _first_common(F.col("key"), differ, wide)
    close = F.bit_count(differ) <= LINKED_BITS
    # Spark sizes a table after an explode as before it, 64 rows as one: the join must not be chosen by that size
    pairs = index.join(other.hint("merge"), (F.col("key") == F.col("other")) & (F.col("a") < F.col("b")) & close)
    pairs = pairs.withColumn("bit", F.expr(bit))
    return pairs.filter(first).select(F.col("a").alias("u"), F.col("b").alias("v"))


def grouped(prints: DataFrame, wide: bool | None = None) -> DataFrame:
    """(node, root) of every fingerprint (column ``__fp``, distinct) that is linked to another."""
    return components(linked_pairs(prints, wide))


def op1_simhash(spark: SparkSession, directory: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = table(spark, directory, "documents").select("doc_id", "text")
    rows = stored(fingerprinted(docs).select("doc_id", "__fp"), "prints")
    return with_components(rows).select("doc_id", F.lpad(F.lower(F.hex("__fp")), 16, "0").alias("fingerprint"), "component_id")


def with_components(rows: DataFrame, doc: str = "doc_id", wide: bool | None = None) -> DataFrame:
    """``rows`` (with ``__fp``) and their component's smallest id."""
    prints = stored(rows.groupBy("__fp").agg(F.min(doc).alias("__least")), "distinct-prints")
    roots = stored(grouped(prints, wide), "roots")
    placed = prints.join(roots, F.col("__fp") == F.col("node"), "left")
    placed = placed.select("__fp", "__least", F.coalesce("root", "__fp").alias("__root"))
    ids = placed.groupBy("__root").agg(F.min("__least").alias("component_id"))
    named = placed.join(ids, "__root").select(F.col("__fp").alias("__named"), "component_id")
    return rows.drop("component_id").join(named, F.col("__fp") == F.col("__named")).drop("__named")


def simhash_stage(spark: SparkSession, docs: DataFrame, directory: str) -> DataFrame:
    """One document of each component: that with the smallest id, whole copies of its row once."""
    flags = [F.col(c).isNull() for c in docs.columns]
    keys = [F.xxhash64(F.lit(seed), *docs.columns, *flags).alias(f"__key{seed}") for seed in (1, 2)]
    rows = fingerprinted(docs.select("doc_id", "text", *keys)).drop("text")
    rows = stored(rows, "prints")  # ids and hashes; the texts are not written again
    placed = with_components(rows)
    # a component without ids is known by its null; its fingerprints' roots keep it apart
    first = placed.withColumn("__group", F.coalesce(F.col("component_id").cast("string"), F.concat(F.lit("fp"), F.hex("__fp"))))
    order = F.struct(F.col("doc_id").isNull(), "doc_id", "__key1", "__key2")
    chosen = first.groupBy("__group").agg(F.min(order).alias("one")).select("one.__key1", "one.__key2")
    # rows alike in every column have one key
    kept = docs.select("*", *keys).join(chosen, ["__key1", "__key2"], "left_semi").dropDuplicates(["__key1", "__key2"])
    return kept.select(*docs.columns)
