"""Toxicity by compression distance.

Two zstandard dictionaries are trained, on ordinary and on toxic text. The toxic one goes on with the ordinary one's
content, so that a window's two compressed lengths differ only by what toxic text saves. A text is cut into windows of
``WINDOW`` words; the savings of its windows, counted at several thresholds, give a score by weights that are fitted on
labelled texts the dictionaries have not seen.

Toxic text is found inside labelled toxic texts as the words whose beginnings stand in many more different contexts
(neighbouring words) there than in ordinary texts; copies add no contexts. Dictionaries are fitted on at most
``TOXIC_SAMPLE`` and ``ORDINARY_SAMPLE`` labelled texts, weights on at most ``CALIBRATION_SAMPLE``, picked by a hash of the id
among those not held out and not over ``SAMPLE_CHARS`` characters. Of the ordinary texts' windows at most ``PLAIN_WINDOWS``, in
a drawn order, train their dictionary, and a word stands at most ``MOST_REPEATS`` times in what trains the toxic one. These
bounds hold for training alone. Every text is scored whole.

Defined cases: null and empty texts save nothing and score as such. Null labels teach nothing. Without toxic or without
ordinary examples every score is the smoothed share of toxic labels. Rows that repeat an id are scored each by its own
text; a null id is not held out. Columns named like an output are replaced; all others are kept.
"""

from __future__ import annotations

import random
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saldo.llm.common import table

WINDOW = 12
ORDINARY_BYTES = 32768
TOXIC_BYTES = 16384
TOXIC_SAMPLE = 1500
ORDINARY_SAMPLE = 3000
CALIBRATION_SAMPLE = 5000
SAMPLE_CHARS = 50_000
#: A word's beginning is toxic if it has so many contexts in toxic texts, and so many times the ordinary share.
LEAST_CONTEXTS = 6
TIMES = 8
#: Windows that train the ordinary dictionary, and times a word may stand in what trains the toxic one.
PLAIN_WINDOWS = 60_000
MOST_REPEATS = 50
CUT = 0.3
SAVINGS = (1, 2, 3, 4, 5, 6, 8)
SLICE = 1 << 20


def held_out(doc: Column) -> Column:
    """The rows that teach nothing: CRC-32 of the id's text, modulo 4, is 2."""
    return F.coalesce(F.crc32(doc.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def windows(text: str | None) -> Iterator[bytes]:
    """The text's words in lower case, twelve to a window, slice by slice."""
    body, at = text or "", 0
    while at < len(body):
        end = at + SLICE
        while end < len(body) and not body[end].isspace():
            end += 1
        words = body[at:end].lower().split()
        at = end
        for n in range(0, len(words), WINDOW):
            yield f" {' '.join(words[n : n + WINDOW])} ".encode("utf-8", "surrogatepass")


def beginnings(word: str) -> set[str]:
    return {f" {word} "[:n] for n in (4, 5, 6)}


def toxic_words(toxic: list[str], ordinary: list[str]) -> list[tuple[int, str]]:
    """(contexts, word) of the words that mark toxic texts, most frequent first."""
    vocabulary: dict[str, int] = {}

    def contexts(texts: list[str]) -> tuple[np.ndarray, int]:
        found = [np.zeros((0, 3), np.int64)]
        for text in texts:
            ids = [vocabulary.setdefault(w, len(vocabulary)) for w in text.lower().split()]
            if ids:
                padded = np.array([-1, *ids, -1])
                found.append(np.stack([padded[:-2], padded[1:-1], padded[2:]], axis=1))
        distinct = np.unique(np.concatenate(found), axis=0)
        return np.bincount(distinct[:, 1], minlength=len(vocabulary)), max(1, len(distinct))

    in_toxic, all_toxic = contexts(toxic)
    in_ordinary, all_ordinary = contexts(ordinary)
    in_toxic = np.pad(in_toxic, (0, len(in_ordinary) - len(in_toxic)))
    names = list(vocabulary)
    here, there = Counter(), Counter()
    for n in np.flatnonzero(in_toxic).tolist():
        for part in beginnings(names[n]):
            here[part] += int(in_toxic[n])
    for n in np.flatnonzero(in_ordinary).tolist():
        for part in beginnings(names[n]):
            if part in here:
                there[part] += int(in_ordinary[n])
    marks = {p for p, k in here.items() if k >= LEAST_CONTEXTS and k * all_ordinary >= TIMES * (there[p] + 1) * all_toxic}
    found = []
    for n in np.flatnonzero(in_toxic).tolist():
        if beginnings(names[n]) & marks and in_toxic[n] * all_ordinary >= TIMES // 2 * in_ordinary[n] * all_toxic:
            found.append((int(in_toxic[n]), names[n]))
    return sorted(found, key=lambda f: (-f[0], f[1]))


def trained(samples: list[bytes], size: int) -> bytes:
    """A dictionary's bytes; the samples themselves where they are too few to train one."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


@dataclass(frozen=True)
class Model:
    ordinary: bytes
    toxic: bytes
    mean: tuple[float, ...]
    spread: tuple[float, ...]
    weights: tuple[float, ...]

    def compressors(self):
        """One for each dictionary, without frame headers that would add to the lengths."""
        settings = zstandard.ZstdCompressionParameters.from_level(
            6,
            write_content_size=0,
            write_checksum=0,
            write_dict_id=0,
            format=zstandard.FORMAT_ZSTD1_MAGICLESS,
            strategy=zstandard.STRATEGY_LAZY2,
            min_match=5,
            search_log=5,
            window_log=18,
            hash_log=16,
            chain_log=16,
        )
        made = []
        for content in (self.ordinary, self.toxic + self.ordinary):
            data = zstandard.ZstdCompressionDict(content or b" " * 8, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            data.precompute_compress(compression_params=settings)
            made.append(zstandard.ZstdCompressor(dict_data=data, compression_params=settings).compress)
        return made

    def score(self, rows: np.ndarray) -> np.ndarray:
        """Between 0 and 1 for each row of features."""
        if not self.mean:
            return np.full(len(rows), self.weights[0])
        scaled = (rows - np.array(self.mean)) / np.array(self.spread)
        # summed row by row, so that a score does not depend on the rows beside it
        return 1 / (1 + np.exp(-np.clip(self.weights[0] + (scaled * np.array(self.weights[1:])).sum(axis=1), -30, 30)))


def features(text: str | None, plain, toxic) -> list[float]:
    """The largest saving of a window, their sum, and how many and what share reach each threshold."""
    saved = np.array([len(plain(w)) - len(toxic(w)) for w in windows(text)] or [0], float)
    counts = np.array([(saved >= k).sum() for k in SAVINGS], float)
    total = np.clip(saved, 0, None).sum() / np.sqrt(len(saved))
    return [saved.max(), total, np.log(len(saved)), *np.log1p(counts), *(counts[1:] / len(saved))]


def toxic_content(toxic: list[str], ordinary: list[str], order: random.Random) -> bytes:
    """What a dictionary of toxic text adds to one of ordinary text."""
    words = toxic_words(toxic, ordinary)
    often = [w for n, w in words for _ in range(min(n, MOST_REPEATS))]
    order.shuffle(often)
    lines = [f" {' '.join(often[n : n + 8])} ".encode() for n in range(0, len(often), 8)]
    # the trainer may leave rare words out; they go before what it picks
    listed = b"".join([f" {w} ".encode() for _, w in reversed(words)])[-TOXIC_BYTES:]
    return listed + (trained(lines, TOXIC_BYTES) if lines else b"")


def fitted(toxic: list[str], ordinary: list[str], calibration: list[tuple[str, int]]) -> Model:
    """Train the dictionaries, then weigh the savings by regularised logistic regression."""
    known = [label for _, label in calibration] + [1] * len(toxic) + [0] * len(ordinary)
    constant = Model(b"", b"", (), (), ((sum(known) + 1) / (len(known) + 2),))
    if not toxic or not ordinary or len({label for _, label in calibration}) < 2:
        return constant
    order = random.Random(1)
    plain = [w for text in ordinary for w in windows(text)]
    order.shuffle(plain)
    model = Model(trained(plain[:PLAIN_WINDOWS], ORDINARY_BYTES), toxic_content(toxic, ordinary, order), (), (), ())
    compress = model.compressors()
    rows = np.array([features(text, *compress) for text, _ in calibration])
    labels = np.array([label for _, label in calibration], float)
    mean, spread = rows.mean(axis=0), rows.std(axis=0) + 1e-9
    design = np.concatenate([np.ones((len(rows), 1)), (rows - mean) / spread], axis=1)
    weights = np.zeros(design.shape[1])
    ridge = np.eye(len(weights)) * 1e-3 * len(rows) + np.eye(len(weights))
    ridge[0, 0] = 1e-6
    for _ in range(30):
        chance = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        curve = (design.T * (chance * (1 - chance))) @ design + ridge
        weights = weights + np.linalg.solve(curve, design.T @ (labels - chance) - ridge @ weights)
    return Model(model.ordinary, model.toxic, tuple(mean.tolist()), tuple(spread.tolist()), tuple(weights.tolist()))


def learned(docs: DataFrame, labels: DataFrame, text: str = "text", doc: str = "doc_id", label: str = "toxic") -> Model:
    """Fit a model on a bounded sample of labelled texts. Only the sample's ids are broadcast and only its texts collected."""
    known = labels.select(F.col(doc).alias("id"), F.col(label).cast("int").alias("label"))
    known = known.filter("id is not null and label in (0, 1)").filter(~held_out(F.col("id"))).distinct()
    known = known.withColumn("draw", F.xxhash64(F.lit("sample"), "id")).withColumn("part", F.pmod("draw", F.lit(3)))
    order = (F.col("draw"), F.col("id"), F.col("label"))
    drawn = known.filter("part = 0").orderBy(*order).limit(CALIBRATION_SAMPLE)
    for value, size in ((1, TOXIC_SAMPLE), (0, ORDINARY_SAMPLE)):
        drawn = drawn.unionAll(known.filter(f"part <> 0 and label = {value}").orderBy(*order).limit(size))
    bodies = docs.select(F.col(doc).alias("doc"), F.col(text).alias("body")).filter(f"body is not null and length(body) <= {SAMPLE_CHARS}")
    rows = bodies.join(F.broadcast(drawn), F.col("doc") == F.col("id")).select("draw", "id", "label", "part", "body").distinct()
    rows = sorted(rows.collect(), key=lambda r: (r["draw"], r["id"], r["label"], r["body"]))  # at most the three samples
    return fitted(
        [r["body"] for r in rows if r["part"] and r["label"]],
        [r["body"] for r in rows if r["part"] and not r["label"]],
        [(r["body"], r["label"]) for r in rows if not r["part"]],
    )


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, with score and predicted. The model, some 64 KB, travels with the job."""
    kept = [c for c in docs.columns if c not in (text, "score", "predicted")]
    fields = [*docs.select(*kept).schema.fields, T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    schema = T.StructType(fields)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = model.compressors() if model.mean else None
        for batch in batches:
            if compress:
                rows = np.array([features(t.as_py(), *compress) for t in batch.column("__body")]).reshape(batch.num_rows, -1)
            else:
                rows = np.zeros((batch.num_rows, 0))
            scores = model.score(rows)
            columns = [c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "__body"]
            columns += [pa.array(scores), pa.array((scores >= CUT).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return docs.select(*kept, F.col(text).alias("__body")).mapInArrow(work, schema)


def op3_toxicity(spark: SparkSession, directory: str) -> DataFrame:
    """Score every document."""
    docs = table(spark, directory, "documents").select("doc_id", "text")
    model = learned(docs, table(spark, directory, "labels"))
    rows = scored(docs, model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
