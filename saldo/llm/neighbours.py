"""Approximate nearest neighbours by multiprobe p-stable hashing.

Vectors are scaled to length one and hashed in ``TABLES`` tables by ``HASHES`` Gaussian projections cut into cells. A query
visits, in each table, its own bucket and perturbed ones in the order of their estimated success: the squared distances to
the cell borders crossed. How many it visits is fitted on a bounded sample, as the fewest that find ``TARGET`` of the
sample's true neighbours. Every row is indexed. Candidates of all tables are merged and ranked by their exact cosine.

Buckets are packed into parts of about ``BLOCK`` rows, and a larger bucket is dealt to several parts, so that no task holds
more than its part; queries meet a part in blocks of ``QUERY_BLOCK`` and leave with their nearest in it. A query that finds
too few is compared with all rows, in the same blocks.

Defined cases: vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part. Rows that share an id are one candidate, by the nearest of them, in every bucket, part and merge: equal rows are
indexed once, and other rows of an id take no second place. A row is never its own neighbour. Null ids take no
part. Ties go to the smaller id. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

import heapq
import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saldo.llm.common import stored, table

TABLES = 4
HASHES = 6
CELL = 1.5
TARGET = 0.96
SAMPLE = 4096
SAMPLE_QUERIES = 200
PROBES = (8, 16, 32, 64, 96, 128, 192, 256, 384, 512, 729)
BLOCK = 16384
QUERY_BLOCK = 16384
#: Bits of a bucket code for one cell number.
CELL_BITS = 9


class Hashing:
    """The tables' projections, and the probing order."""

    def __init__(self, dimension: int, seed: int = 7):
        draw = np.random.default_rng(seed)
        self.lines = draw.standard_normal((TABLES, dimension, HASHES))
        self.offsets = draw.random((TABLES, HASHES)) * CELL
        self.moves = np.array(list(itertools.product((0, -1, 1), repeat=HASHES)), np.int64)

    def cells(self, unit: np.ndarray, n: int) -> np.ndarray:
        return (unit @ self.lines[n] + self.offsets[n]) / CELL

    def codes(self, cells: np.ndarray, n: int) -> np.ndarray:
        """Whole cell numbers and the table packed into one integer."""
        code = np.full(cells.shape[:-1], n, np.int64)
        for i in range(HASHES):
            code = (code << CELL_BITS) | (cells[..., i].astype(np.int64) + (1 << (CELL_BITS - 1)))
        return code

    def own(self, unit: np.ndarray) -> np.ndarray:
        """The bucket code of every vector in each table."""
        return np.stack([self.codes(np.floor(self.cells(unit, n)), n) for n in range(TABLES)], axis=1)

    def probes(self, unit: np.ndarray, count: int) -> np.ndarray:
        """The ``count`` most promising codes of every vector in each table."""
        found = []
        for n in range(TABLES):
            cells = self.cells(unit, n)
            base = np.floor(cells)
            inside = cells - base
            costs = np.zeros((len(unit), len(self.moves)))
            for i in range(HASHES):
                step = np.stack([np.zeros(len(unit)), (1 - inside[:, i]) ** 2, inside[:, i] ** 2], axis=1)
                costs += step[:, self.moves[:, i]]  # 1 crosses the upper border, -1 the lower
            order = np.argsort(costs, axis=1, kind="stable")[:, :count]
            found.append(self.codes(base[:, None, :] + self.moves[order], n))
        return np.concatenate(found, axis=1)


def unit_rows(rows: np.ndarray) -> np.ndarray:
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def matrix(column: pa.ChunkedArray | pa.Array, dimension: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision and always in the same order of additions."""
    scaled = np.sqrt((a * a).sum(axis=1)) * np.sqrt((b * b).sum(axis=1))
    return (a * b).sum(axis=1) / scaled


def valid(vectors: DataFrame, ident: str, vector: str) -> tuple[DataFrame, int]:
    """(id, embedding) of the vectors that take part, and their dimension."""
    rows = vectors.select(F.col(ident).cast("bigint").alias("id"), F.col(vector).cast("array<double>").alias("embedding"))
    sound = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists("embedding", lambda x: x != 0)
    rows = rows.filter(F.col("id").isNotNull() & F.col("embedding").isNotNull()).filter(sound & some)
    common = rows.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    dimension = common["n"] if common else 1
    return rows.filter(F.size("embedding") == dimension).distinct(), dimension


def fitted_probes(rows: DataFrame, hashing: Hashing, dimension: int, neighbours: int) -> int:
    """The fewest probes that find TARGET of the nearest rows of a sample."""
    drawn = rows.orderBy(F.xxhash64(F.lit("sample"), "id"), "id", "embedding").limit(SAMPLE).collect()  # at most SAMPLE vectors
    if len(drawn) <= neighbours:
        return PROBES[0]
    unit = unit_rows(np.array([r["embedding"] for r in drawn], np.float64).reshape(-1, dimension))
    asked = unit[:SAMPLE_QUERIES]
    near = asked @ unit.T
    ids = np.array([r["id"] for r in drawn], np.int64)
    near[ids[: len(asked), None] == ids[None, :]] = -2
    true = np.argpartition(-near, neighbours - 1, axis=1)[:, :neighbours]
    own = hashing.own(unit)
    probes = hashing.probes(asked, PROBES[-1]).reshape(len(asked), TABLES, -1)
    for count in PROBES:
        found = [
            any(own[v, n] in seen[n] for n in range(TABLES))
            for q in range(len(asked))
            for seen in [[set(probes[q, n, :count].tolist()) for n in range(TABLES)]]
            for v in true[q]
        ]
        if np.mean(found) >= TARGET:
            return count
    return PROBES[-1]


def _blocks(count: Column, size: int) -> Column:
    return F.ceil(count / F.lit(size)).cast("int")


def search(
    vectors: DataFrame, asked: Column, neighbours: int = 5, ident: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """(query_id, rank, vec_id, score): the nearest found of every row of ``vectors`` for which ``asked`` holds."""
    rows, dimension = valid(vectors.withColumn("__asked", asked), ident, vector)
    flags = vectors.filter(asked).select(F.col(ident).cast("bigint").alias("query_id")).distinct()
    hashing = Hashing(dimension)

    def bucketed(batches):
        for batch in batches:
            codes = hashing.own(unit_rows(matrix(batch.column("embedding"), dimension)))
            offsets = pa.array(np.arange(0, codes.size + 1, TABLES, dtype=np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(codes.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=["id", "embedding", "codes"])

    base = stored(rows.mapInArrow(bucketed, "id bigint, embedding array<double>, codes array<bigint>"), "vectors")
    total = base.count()
    spark = vectors.sparkSession
    if not total:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    count = fitted_probes(base, hashing, dimension, neighbours)
    parts = max(1, math.ceil(total * TABLES / BLOCK))
    sizes = base.select(F.explode("codes").alias("bucket")).groupBy("bucket").count()
    sizes = stored(sizes.select("bucket", _blocks(F.col("count"), BLOCK).alias("pieces")), "bucket-sizes")

    index = base.select("id", "embedding", F.explode("codes").alias("code")).join(sizes, F.col("code") == F.col("bucket"))
    piece = F.pmod(F.xxhash64("id"), F.col("pieces"))
    index = index.select("id", "embedding", "code", F.pmod(F.xxhash64("code", piece), F.lit(parts)).alias("part"))
    queries = base.join(flags, F.col("id") == F.col("query_id")).select("query_id", "embedding")
    queries = stored(queries, "queries")
    blocks = max(1, math.ceil(queries.count() / QUERY_BLOCK))

    def probing(batches):
        for batch in batches:
            codes = hashing.probes(unit_rows(matrix(batch.column("embedding"), dimension)), count)
            offsets = pa.array(np.arange(0, codes.size + 1, codes.shape[1], dtype=np.int32))
            lists = pa.ListArray.from_arrays(offsets, pa.array(codes.reshape(-1)))
            yield pa.RecordBatch.from_arrays([batch.column("query_id"), lists], names=["query_id", "codes"])

    visits = queries.mapInArrow(probing, "query_id bigint, codes array<bigint>")
    visits = visits.select("query_id", F.explode("codes").alias("code")).distinct()
    found = _nearest(queries, visits, index, sizes, parts, blocks, dimension, neighbours)
    found = stored(found, "found")

    # queries that found fewer than there are: all buckets of the first table hold all rows
    others = min(neighbours, base.select("id").distinct().count() - 1)
    enough = found.groupBy("query_id").count().filter(F.col("count") >= others).select("query_id")
    short = stored(queries.join(enough, "query_id", "left_anti"), "short")
    if others > 0 and not short.isEmpty():
        first = F.shiftright("bucket", CELL_BITS * HASHES) == 0
        homes = index.filter(F.shiftright("code", CELL_BITS * HASHES) == 0)
        every = sizes.filter(first).select(F.col("bucket").alias("code"))
        # each part asks for all its buckets: pair the short queries with parts, not with rows
        fill = _nearest(short, None, homes, every, parts, blocks, dimension, neighbours)
        found = found.join(short.select("query_id"), "query_id", "left_anti").unionByName(fill)
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("vec_id"), "score")


def _nearest(queries, visits, index, sizes, parts, blocks, dimension, neighbours) -> DataFrame:
    """The nearest rows of the visited buckets. Without ``visits``, each query visits every part whole."""
    block = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    whole = visits is None
    if whole:
        meets = queries.select("query_id", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"))
        meets = meets.withColumn("part", F.col("part").cast("bigint")).withColumn("codes", F.array().cast("array<bigint>"))
    else:
        meets = visits.join(sizes, F.col("code") == F.col("bucket"))
        meets = meets.select("query_id", "code", F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
        part = F.pmod(F.xxhash64("code", F.col("piece").cast("bigint")), F.lit(parts))
        # at most the query's probes in one list
        meets = meets.groupBy("query_id", part.alias("part")).agg(F.collect_set("code").alias("codes"))
    meets = meets.join(queries, "query_id").select("part", block.alias("block"), "query_id", "codes", "embedding")
    sides = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("block", F.col("block").cast("bigint"))

    def nearest(kept: dict[int, float]) -> list[tuple[int, float]]:
        return heapq.nsmallest(neighbours, kept.items(), key=lambda x: (-x[1], x[0]))

    def compare(rows: pa.Table, asked: pa.Table) -> pa.Table:
        names = ["query_id", "id", "score"]
        if not rows.num_rows or not asked.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        order = np.lexsort((rows.column("id").to_numpy(), rows.column("code").to_numpy()))
        ids = rows.column("id").to_numpy()[order]
        codes = rows.column("code").to_numpy()[order]
        body = matrix(rows.column("embedding"), dimension)[order]
        unit = unit_rows(body)
        query_ids = asked.column("query_id").to_numpy()
        query_body = matrix(asked.column("embedding"), dimension)
        query_unit = unit_rows(query_body)
        if whole:
            pairs = [(0, len(ids), np.arange(len(query_ids)))]
        else:
            wanted = asked.column("codes").combine_chunks()
            owner = np.repeat(np.arange(len(query_ids)), np.diff(wanted.offsets.to_numpy()))
            flat = wanted.flatten().to_numpy()
            by_code = np.argsort(flat, kind="stable")
            flat, owner = flat[by_code], owner[by_code]
            values, starts = np.unique(codes, return_index=True)
            ends = np.append(starts[1:], len(codes))
            left, right = np.searchsorted(flat, values, "left"), np.searchsorted(flat, values, "right")
            pairs = [(a, b, owner[x:y]) for a, b, x, y in zip(starts, ends, left, right, strict=True) if y > x]
        best: dict[int, dict[int, float]] = {}
        for start, end, who in pairs:
            for at in range(0, len(who), 256):
                some = who[at : at + 256]
                near = query_unit[some] @ unit[start:end].T
                near[query_ids[some][:, None] == ids[start:end][None, :]] = -3
                # rows of a bucket are in the order of their ids: the best of each id, then the nearest ids
                firsts = np.flatnonzero(np.diff(ids[start:end], prepend=ids[start] - 1))
                each = near if len(firsts) == end - start else np.maximum.reduceat(near, firsts, axis=1)
                if len(firsts) > neighbours:
                    least = np.partition(each, len(firsts) - neighbours, axis=1)[:, -neighbours][:, None] - 1e-12
                else:
                    least = np.full((len(some), 1), -2.0)
                hits, spots = np.nonzero((near >= least) & (near > -2.5))
                exact = cosines(query_body[some[hits]], body[start + spots])
                named = ids[start + spots]
                ranked = np.lexsort((-exact, named, hits))
                hits, named, exact = hits[ranked], named[ranked], exact[ranked]
                single = np.ones(len(hits), bool)
                single[1:] = (hits[1:] != hits[:-1]) | (named[1:] != named[:-1])
                hits, named, exact = hits[single], named[single], exact[single]
                ranked = np.lexsort((named, -exact, hits))
                hits, named, exact = hits[ranked], named[ranked], exact[ranked]
                first = np.arange(len(hits)) - np.searchsorted(hits, hits, "left") < neighbours
                for q, v, s in zip(some[hits[first]].tolist(), named[first].tolist(), exact[first].tolist(), strict=True):
                    kept = best.setdefault(q, {})
                    if s > kept.get(v, -2.0):
                        kept[v] = s
                    if len(kept) > neighbours * TABLES:
                        best[q] = dict(nearest(kept))
        out = [(int(query_ids[q]), v, s) for q, kept in best.items() for v, s in nearest(kept)]
        columns = list(zip(*out, strict=True)) if out else [(), (), ()]
        return pa.table([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.float64())], names=names)

    local = (
        sides.groupBy("part", "block")
        .cogroup(meets.groupBy("part", "block"))
        .applyInArrow(compare, "query_id bigint, id bigint, score double")
    )
    merged = local.groupBy("query_id", "id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")  # a few rows from each part
    return merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= neighbours)


def op4_neighbours(spark: SparkSession, directory: str) -> DataFrame:
    """The five nearest of every fiftieth vector."""
    return search(table(spark, directory, "embeddings"), F.col("vec_id") % 50 == 0)
