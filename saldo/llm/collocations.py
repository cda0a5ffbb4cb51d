"""Phrase collocations, counted by a HAT-trie in every task.

A task gives its words ids and keeps phrases of up to three words, packed as ids, in a shallow trie: a hash container holds
the phrases of a range of first words with their counts, and bursts into one for each first word, then second word, when it
grows beyond ``BURST``. When a task holds more than ``HELD`` phrases, the largest subtrees leave it whole as sorted runs, cut by prefix
partition, the hash of language and first two words, and into blocks. Spark deals the blocks to their partition and sorts
them by first phrase; a sweep over them merges the runs, and lets go of every phrase before the next block's first. So
neither a task nor a partition holds more than its share, however common a word or a pair is.

Only phrases with enough occurrences leave the merge, and all else is joins of theirs: a part of a frequent phrase is
frequent. Scores are whole numbers in decimals of 38 digits; beyond these Spark raises an error.

Defined cases: a null text has no words, a null language is ``und``. Repeated rows count again. Phrases do not cross ends of
pieces or of texts; the words of a text of any length are taken in pieces. Equal scores are ranked by count, then by the phrase's
UTF-8 bytes. An empty table gives no phrases. Only the two columns named are read, so other names can't clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saldo.llm.common import stored, table

#: Ends of pieces: fixed values.
STOPS = b".,;:!?\x0a\x0b\x0c\x0d"
UNKNOWN = "und"
MOST_WORDS = 3
LEAST_COUNT = 10
#: A phrase goes if a longer one has this percentage of its occurrences.
PERCENT = 50
TOP = 2000

BITS = 21
MASK = (1 << BITS) - 1
BURST = 1 << 14
#: Phrases and words of a task's trie, about 140 bytes each, and phrases of a merge: three tasks share what an executor leaves beside its heap.
HELD = 750_000
VOCABULARY = 1 << 19
TOKENS = 1 << 18
SLICE = 1 << 20
BLOCK = 1 << 14
MERGED = 1 << 19
SALTS = 64

RUNS = "part int, lang string, first binary, entries int, run binary"
COUNTS = "lang string, phrase string, words int, f bigint"

#: Never a byte of UTF-8, so no word.
GAP = b"\xff"
_PLAIN = bytes(10 if b in STOPS else b + 32 if 65 <= b <= 90 else b for b in range(256))


class WordIds(dict):
    """Ids of words in order of arrival, from 1; the gap between pieces has 0."""

    def __init__(self) -> None:
        super().__init__({GAP: 0})
        self.words = [b""]

    def __missing__(self, word: bytes) -> int:
        self[word] = found = len(self.words)
        self.words.append(word)
        return found


class Burst(dict):
    """A container that has burst: its children by the next longer prefix."""


def entries(held: dict) -> int:
    return sum(map(entries, held.values())) if type(held) is Burst else len(held)


def containers(held: dict) -> Iterator[dict]:
    if type(held) is Burst:
        for child in held.values():
            yield from containers(child)
    else:
        yield held


class HatTrie:
    """Counts of phrases, packed as three ids, in hash containers under a shallow trie for each language.

    A container starts with the phrases of a range of first words; one that grows too large bursts into one for each first
    word, and that into one for each second word.
    """

    LEVELS = (2 * BITS + 8, 2 * BITS, BITS)

    def __init__(self, burst: int = BURST) -> None:
        self.burst = burst
        self.roots: dict[str, Burst] = {}
        self.size = 0

    def add(self, lang: str, codes: np.ndarray, counts: np.ndarray) -> None:
        """Add counts of distinct phrases in order."""
        if len(codes):
            root = self.roots.setdefault(lang, Burst())
            self.size += self._into(root, 0, codes, codes.tolist(), counts.tolist(), 0, len(codes))

    def _into(self, node: Burst, level: int, codes: np.ndarray, keys: list[int], values: list[int], a: int, b: int) -> int:
        """Add the phrases from place ``a`` to ``b``; how many of them are new."""
        shift, added = self.LEVELS[level], 0
        begins = (np.flatnonzero(np.diff(codes[a:b] >> shift, prepend=-1)) + a).tolist()
        for x, y in zip(begins, [*begins[1:], b], strict=True):
            head = keys[x] >> shift
            held = node.get(head)
            if type(held) is Burst:
                added += self._into(held, level + 1, codes, keys, values, x, y)
                continue
            if held is None:
                held = node[head] = {}
            before = len(held)
            fresh = dict(zip(keys[x:y], values[x:y], strict=True))
            for code in held.keys() & fresh.keys():
                fresh[code] += held[code]
            held.update(fresh)
            added += len(held) - before
            if len(held) > self.burst and level + 1 < len(self.LEVELS):
                node[head] = apart = Burst()
                for code, count in held.items():
                    apart.setdefault(code >> self.LEVELS[level + 1], {})[code] = count
        return added

    def taken(self, left: int) -> Iterator[tuple[str, np.ndarray, np.ndarray]]:
        """Take out whole subtrees, the largest first, until ``left`` phrases are held: (language, codes, counts)."""
        sizes = {(lang, head): entries(held) for lang, root in self.roots.items() for head, held in root.items()}
        chosen: dict[str, list[dict]] = {}
        for lang, head in sorted(sizes, key=sizes.get, reverse=True):
            if self.size <= left:
                break
            self.size -= sizes[lang, head]
            chosen.setdefault(lang, []).extend(containers(self.roots[lang].pop(head)))
        for lang, found in chosen.items():
            codes = np.fromiter(chain.from_iterable(found), np.int64)
            counts = np.fromiter(chain.from_iterable(c.values() for c in found), np.int64)
            yield lang, codes, counts


def packed(ids: np.ndarray, carried: int, most_words: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct phrases of a sequence of ids that end behind its first ``carried``, in order, with their counts."""
    found, inside, code = [], np.ones(len(ids), bool), np.zeros(len(ids), np.int64)
    for m in range(1, min(most_words, len(ids)) + 1):
        inside = inside[: len(ids) - m + 1] & (ids[m - 1 :] > 0)
        code = code[: len(ids) - m + 1] | (ids[m - 1 :] << (BITS * (MOST_WORDS - m)))
        first = max(0, carried - m + 1)
        found.append(code[first:][inside[first:]])
    return np.unique(np.concatenate(found) if found else code, return_counts=True)


def sorted_runs(lang: str, codes: np.ndarray, counts: np.ndarray, words: list[bytes], parts: int, block: int) -> Iterator[pa.RecordBatch]:
    """Blocks of one spill, each sorted by phrase and of one partition. A phrase is written as its words, a blank after each."""
    ids = np.unique(np.concatenate([codes >> (2 * BITS), (codes >> BITS) & MASK, codes & MASK, [0]]))
    own = [words[i] for i in ids.tolist()]
    spaced = pa.array([w + b" " if w else b"" for w in own], pa.large_binary())
    rank = np.empty(len(own), np.int64)
    rank[pc.array_sort_indices(spaced).to_numpy()] = np.arange(len(own))
    place = np.zeros(int(ids[-1]) + 1, np.int64)
    place[ids] = np.arange(len(ids))
    one, two, three = place[codes >> (2 * BITS)], place[(codes >> BITS) & MASK], place[codes & MASK]
    order = np.argsort(rank[one] << (2 * BITS) | rank[two] << BITS | rank[three])
    one, two, three, counts = one[order], two[order], three[order], counts[order]
    hashed = np.array([crc32(w) for w in own], np.uint64)
    mixed = hashed[one] * np.uint64(0x9E3779B97F4A7C15) + hashed[two] * np.uint64(0xC2B2AE3D27D4EB4F) + np.uint64(crc32(lang.encode()))
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    part = ((mixed >> np.uint64(32)) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
    order = np.argsort(part, kind="stable")
    one, two, three, part, counts = one[order], two[order], three[order], part[order].astype(np.int64), counts[order]
    edges = np.flatnonzero(np.diff(part, prepend=-1, append=-1))
    cuts = np.unique(np.concatenate([np.arange(a, b, block) for a, b in zip(edges[:-1], edges[1:], strict=True)]))
    ends = np.append(cuts[1:], len(part))
    zip_ = zstandard.ZstdCompressor(level=1)
    for at in range(0, len(cuts), 256):
        a, b = cuts[at], ends[min(at + 256, len(cuts)) - 1]
        keys = pc.binary_join_element_wise(spaced.take(one[a:b]), spaced.take(two[a:b]), spaced.take(three[a:b]), pa.scalar(b"\n", pa.large_binary()), pa.scalar(b"", pa.large_binary()))
        offsets = np.frombuffer(keys.buffers()[1], np.int64, len(keys) + 1, keys.offset * 8)
        body = memoryview(keys.buffers()[2])
        rows = []
        for x, y in zip(cuts[at : at + 256].tolist(), ends[at : at + 256].tolist(), strict=True):
            i, j = offsets[x - a], offsets[y - a]
            run = zip_.compress(counts[x:y].astype("<i8").tobytes() + bytes(body[i:j]))
            rows.append((int(part[x]), lang, bytes(body[i : offsets[x - a + 1] - 1]), y - x, run))
        names = [field.split()[0] for field in RUNS.split(", ")]
        types = [pa.int32(), pa.string(), pa.binary(), pa.int32(), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names=names)


def spilled_runs(docs: DataFrame, text: str, lang: str, most_words: int, parts: int, held: int, burst: int, block: int) -> DataFrame:
    """The sorted runs of every task's trie."""
    frame = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit(UNKNOWN)).alias("lang"), F.col(text).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, trie, gap = WordIds(), HatTrie(burst), np.zeros(1, np.int64)

        def spill(left: int) -> Iterator[pa.RecordBatch]:
            for name, codes, counts in trie.taken(left):
                yield from sorted_runs(name, codes, counts, ids.words, parts, block)

        for batch in batches:
            rows: dict[str, list[int]] = {}
            for n, name in enumerate(batch.column("lang").to_pylist()):
                rows.setdefault(name, []).append(n)
            texts = batch.column("text")
            for name, places in rows.items():
                sequence, length, carried = [], 0, 0
                for place in places:
                    body = texts[place].as_py()
                    if not body:
                        continue
                    body = body.encode().translate(_PLAIN)
                    at = 0
                    while at < len(body):  # cut at a blank, which no word has
                        to = body.find(b" ", at + SLICE) if len(body) - at > SLICE else -1
                        piece = body[at : to if to >= 0 else len(body)]
                        at = at + len(piece)
                        tokens = piece.replace(b"\n", b" " + GAP + b" ").split()
                        sequence.append(np.fromiter(map(ids.__getitem__, tokens), np.int64, len(tokens)))
                        length += len(tokens)
                        if length > TOKENS or len(ids.words) > VOCABULARY:
                            whole = np.concatenate(sequence)
                            trie.add(name, *packed(whole, carried, most_words))
                            last = whole[1 - MOST_WORDS :]
                            if len(ids.words) > VOCABULARY:
                                again = [ids.words[i] or GAP for i in last.tolist()]
                                yield from spill(0)
                                ids = WordIds()
                                last = np.array([ids[w] for w in again], np.int64)
                            elif trie.size > held:
                                yield from spill(held // 2)
                            sequence, length, carried = [last], 0, len(last)
                    sequence.append(gap)
                trie.add(name, *packed(np.concatenate([*sequence, gap]), carried, most_words))
                if trie.size > held:
                    yield from spill(held // 2)
        yield from spill(0)

    return frame.mapInArrow(count, RUNS)


def merged_runs(least_count: int, merged: int):
    """The sweep over one partition's blocks, which come by language and first phrase."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unzip = zstandard.ZstdDecompressor()
        open_: list[pa.Table] = []
        held, limit, now = 0, merged, None

        def opened(entries: int, run: bytes) -> pa.Table:
            raw = unzip.decompress(run)
            body = np.frombuffer(raw, np.uint8, offset=8 * entries)
            offsets = np.concatenate([[0], np.flatnonzero(body == 10) + 1]).astype(np.int64)
            keys = pa.LargeBinaryArray.from_buffers(pa.large_binary(), entries, [None, pa.py_buffer(offsets), pa.py_buffer(raw[8 * entries :])])
            return pa.table({"key": keys, "f": np.frombuffer(raw, "<i8", entries)})

        def closed(before: bytes | None) -> Iterator[pa.RecordBatch]:
            """Sums of the phrases before a key, or of all; the others stay open."""
            nonlocal held, limit
            sums = pa.concat_tables(open_).group_by("key").aggregate([("f", "sum")])
            open_.clear()
            held = 0
            if before is not None:
                late = pc.greater_equal(sums["key"], pa.scalar(before, pa.large_binary()))
                rest = sums.filter(late).rename_columns(["key", "f"])
                open_.append(rest)
                held = len(rest)
                sums = sums.filter(pc.invert(late))
            limit = max(merged, 2 * held)
            words = pc.count_substring(sums["key"].cast(pa.large_string()), " ")
            total = pc.sum(sums.filter(pc.equal(words, 1))["f_sum"]).as_py() or 0
            many = pc.greater_equal(sums["f_sum"], least_count)
            found, words = sums.filter(many), words.filter(many).to_pylist()
            phrases = [k[:-2].decode() for k in found["key"].to_pylist()]
            columns = [[now] * (len(phrases) + 1), [None, *phrases], [0, *words], [total, *found["f_sum"].to_pylist()]]
            types = [pa.string(), pa.string(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["lang", "phrase", "words", "f"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["lang"] != now:
                    if open_:
                        yield from closed(None)
                    now = row["lang"]
                elif held > limit:
                    yield from closed(row["first"])
                open_.append(opened(row["entries"], row["run"]))
                held += row["entries"]
        if open_:
            yield from closed(None)

    return merge


def phrase_counts(
    docs: DataFrame,
    text: str = "text",
    lang: str = "lang",
    most_words: int = MOST_WORDS,
    least_count: int = LEAST_COUNT,
    parts: int | None = None,
    held: int = HELD,
    burst: int = BURST,
    block: int = BLOCK,
    merged: int = MERGED,
) -> DataFrame:
    """(lang, phrase, words, f) of the phrases of up to ``most_words`` words (3 at most) with enough occurrences.

    Rows without a phrase add up to the number of all words of their language.
    """
    if not 1 <= most_words <= MOST_WORDS:
        raise ValueError(f"phrases have 1 to {MOST_WORDS} words")
    parts = parts or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    runs = spilled_runs(docs, text, lang, most_words, parts, held, burst, block)
    dealt = runs.repartitionById(parts, F.col("part")).sortWithinPartitions("lang", "first")
    return dealt.mapInArrow(merged_runs(least_count, merged), COUNTS)


def _part(first: Column | int, length: Column) -> Column:
    return F.array_join(F.slice("parts", first if isinstance(first, Column) else F.lit(first), length), " ")


def collocations(counts: DataFrame, least_words: int = 2, percent: int = PERCENT, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each language by their weakest cut, from ``counts`` as ``phrase_counts`` gives them.

    The best of each of ``SALTS`` shares of a language are ranked again together, so no task sorts a language.
    """
    counts = stored(counts, "phrases")
    known = counts.filter("phrase is not null").select("lang", "phrase", "words", "f")
    totals = counts.filter("phrase is null").groupBy("lang").agg(F.sum("f").alias("n"))
    candidates = known.filter(F.col("words") >= least_words).withColumn("parts", F.split("phrase", " "))
    cuts = candidates.select("lang", "phrase", "words", F.col("f").alias("a"), "parts", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "words", "a", "k", _part(1, F.col("k")).alias("left"), _part(F.col("k") + 1, F.col("words") - F.col("k")).alias("right"))
    for side, count in (("left", "l"), ("right", "r")):
        found = known.select(F.col("lang").alias("__lang"), F.col("phrase").alias("__phrase"), F.col("f").alias(count))
        cuts = cuts.join(found, (F.col("lang") == F.col("__lang")) & (F.col(side) == F.col("__phrase"))).drop("__lang", "__phrase")
    exact = {c: F.col(c).cast("decimal(38,0)") for c in "alr"}
    cuts = cuts.withColumns({f"__{c}": v for c, v in exact.items()})
    cuts = cuts.withColumn("score", F.expr("(1000000BD * __a * __a) div (__l * __r)"))
    scored = cuts.groupBy("lang", "phrase", "words", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    inner = candidates.select("lang", "words", "f", "parts", F.explode(F.sequence(F.lit(least_words), F.col("words"))).alias("m"))
    inner = inner.filter("m < words").select("lang", "f", "m", "parts", F.explode(F.sequence(F.lit(1), F.col("words") - F.col("m") + 1)).alias("at"))
    longer = inner.select("lang", _part(F.col("at"), F.col("m")).alias("phrase"), "f").groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    longer = longer.select(F.col("lang").alias("__lang"), F.col("phrase").alias("__phrase"), "longer")
    kept = scored.join(longer, (F.col("lang") == F.col("__lang")) & (F.col("phrase") == F.col("__phrase")), "left")
    covered = F.col("longer").cast("decimal(38,0)") * 100 >= F.col("a").cast("decimal(38,0)") * percent
    kept = kept.filter(~F.coalesce(covered, F.lit(False)))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = (F.desc("score"), F.desc("a"), "phrase")
    shared = kept.withColumn("salt", F.pmod(F.hash("phrase"), F.lit(SALTS)))
    best = shared.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).filter(F.col("rank") <= top)
    best = best.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint")).filter(F.col("rank") <= top)
    totals = totals.withColumnRenamed("lang", "__lang")
    return best.join(totals, F.col("lang") == F.col("__lang")).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, directory: str) -> DataFrame:
    """The strongest phrases of two and three words of each language."""
    return collocations(phrase_counts(table(spark, directory, "documents")))


SQL = f"""
with pieces as (
  select coalesce(lang, '{UNKNOWN}') as lang, regexp_extract_all(unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')), '[^\\x20\\x09]+') as w
  from documents),
known as (
  select lang, array_to_string(w[i:i + m - 1], ' ') as phrase, m as words, count(*) as f
  from pieces, unnest([1, 2, 3]) as sizes(m), unnest(range(1, len(w) - m + 2)) as places(i) group by all),
candidates as (select *, string_split(phrase, ' ') as w from known where words > 1 and f >= {LEAST_COUNT}),
scored as (
  select c.lang, c.phrase, c.f as a, l.f as l, r.f as r, 1000000::hugeint * c.f * c.f // (l.f::hugeint * r.f) as score, k
  from candidates c, unnest(range(1, c.words)) as cuts(k)
  join known l on l.lang = c.lang and l.phrase = array_to_string(c.w[1:k], ' ')
  join known r on r.lang = c.lang and r.phrase = array_to_string(c.w[k + 1:], ' ')),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
covered as (
  select distinct c.lang, c.phrase from candidates c join candidates b
    on b.lang = c.lang and b.words > c.words and 100 * b.f >= {PERCENT} * c.f and contains(' ' || b.phrase || ' ', ' ' || c.phrase || ' '))
select lang, row_number() over (partition by lang order by score desc, a desc, phrase) as rank, phrase, a, l, r,
  cast(n as bigint) as n, cast(score as bigint) as score
from lowest anti join covered using (lang, phrase)
join (select lang, sum(f) as n from known where words = 1 group by lang) using (lang)
qualify rank <= {TOP}"""
