"""SentencePiece encoding with seeded merge-dropout, and lossless decoding.

A model of the BPE kind is read, never trained. A text is cut into units between which no piece can merge; a unit starts
as characters and its agenda holds the candidate merges, best score first, leftmost on ties. A candidate is skipped for
good if a keyed hash of (seed, document, copy, number of the unit in the text, position, piece) falls below ``dropout``, so
every occurrence of a word is cut by its own draw, and every retry or rerun makes the same pieces. Without dropout the
pieces are those of the library.

Occurrences of units of one length are worked through together, one agenda step of each at a time; long units have an agenda
of their own. What an agenda comes to depends only on which of its best candidates are skipped, so for units met often its
course is kept as a tree: a node is the candidate in turn, its two branches are the candidate merged and skipped, a leaf holds
the pieces. Occurrences walk their trees together, each by its own hashes; branches that few come to are not kept. The trees
hold no draws, so they change no pieces, and are dropped when they grow beyond ``KEPT_NODES``.

Defined cases: a null or empty text has no pieces and decodes to the empty text. Characters outside the vocabulary, and a
literal U+2581, become byte pieces, so decoding gives back every text. Repeated rows get the same pieces unless a column
numbers the copies; a null id draws like any other. Columns named like an output are replaced; all others are kept.
"""

from __future__ import annotations

import heapq
import itertools
import re
from collections import Counter
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from saldo.llm.common import table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 1
#: Numbers that documents draw by.
VARIANTS = 1 << 64
SPACE = "▁"
#: Units up to the last length are stepped together, in groups of these lengths.
LENGTHS = (4, 6, 8, 10, 12, 16, 20, 26, 32)
LONGEST = LENGTHS[-1]
#: Occurrences in a sub-batch from which a unit gets a tree, and from which a branch of it is worked out.
OFTEN = 16
BRANCH_OFTEN = 4
TOGETHER = 20_000
SUB_BATCH = 2_000_000
NONE = np.int32(1 << 30)
KEPT_NODES = 2_000_000
STEP = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1


def mixed_hash(key: np.ndarray) -> np.ndarray:
    """SplitMix64's finisher over unsigned integers."""
    key = (key ^ (key >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    key = (key ^ (key >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return key ^ (key >> np.uint64(31))


def mixed(key: int) -> int:
    """The same of one integer."""
    key = (key ^ (key >> 30)) * 0xBF58476D1CE4E5B9 & MASK
    key = (key ^ (key >> 27)) * 0x94D049BB133111EB & MASK
    return key ^ (key >> 31)


class Trees:
    """The agendas met so far. A branch holds a node, UNKNOWN, or a leaf as ``LEAF - number``."""

    UNKNOWN, LEAF = -1, -2

    def __init__(self):
        self.roots: dict[str, int] = {}
        self.leaves: list[bytes] = []
        self.size = 0
        self.hashes = np.zeros(1024, np.uint64)
        self.branches = np.full(2048, self.UNKNOWN, np.int32)

    def node(self, place: int = 0) -> int:
        if self.size == len(self.hashes):
            self.hashes = np.concatenate([self.hashes, np.zeros(self.size, np.uint64)])
            self.branches = np.concatenate([self.branches, np.full(2 * self.size, self.UNKNOWN, np.int32)])
        self.hashes[self.size] = place
        self.size += 1
        return self.size - 1

    def leaf(self, pieces: bytes) -> int:
        self.leaves.append(pieces)
        return self.LEAF - (len(self.leaves) - 1)

    def root(self, unit: str) -> int:
        """The branch at which the agendas of a unit begin."""
        found = self.roots.get(unit)
        if found is None:
            found = self.roots[unit] = 2 * self.node()
        return found


class Codec:
    """Pieces and merges of one model, for one seed and dropout."""

    def __init__(self, proto: bytes, dropout: float, seed: int):
        model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        size = model.get_piece_size()
        plain = [n for n in range(size) if not (model.is_control(n) or model.is_unknown(n) or model.is_byte(n))]
        names = {model.id_to_piece(n): n for n in plain}
        self.bytes_of = [b""] * size
        self.byte_ids = [0] * 256
        for n in range(size):
            if model.is_byte(n):
                value = int(model.id_to_piece(n)[3:5], 16)
                self.byte_ids[value] = n
                self.bytes_of[n] = bytes([value])
        for name, n in names.items():
            self.bytes_of[n] = name.replace(SPACE, " ").encode()
        self.single = {name: n for name, n in names.items() if len(name) == 1}
        #: order[n]: place of piece n among all by score, best first; equal scores share a place
        scores = np.array([model.get_score(n) for n in range(size)])
        self.order = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        self.places = self.order.tolist()
        merges = []
        joined = set()
        for name, n in names.items():
            for cut in range(1, len(name)):
                left, right = names.get(name[:cut]), names.get(name[cut:])
                if left is not None and right is not None:
                    merges.append((left << 20 | right, n))
                    joined.update(name)
        merges.sort()
        self.pair_keys = np.array([k for k, _ in merges], np.int64)
        self.pair_made = np.array([n for _, n in merges], np.int32)
        self.pairs = dict(merges)
        joined.discard(SPACE)
        inside = "".join(re.escape(c) for c in sorted(joined)) or "\x00"
        self.unit = re.compile(f" *[{inside}]+| +|[^ {inside}]")
        self.below = np.uint64(min((1 << 64) - 1, int(dropout * (1 << 64))))
        self.most = int(self.below)
        self.seed = np.uint64(mixed(seed % VARIANTS))
        self.trees = Trees()

    def _skipped(self, unit: np.ndarray, at: np.ndarray, made: np.ndarray) -> np.ndarray:
        if not self.below:
            return np.zeros(len(made), bool)
        place = (at.astype(np.uint64) << np.uint64(32)) | made.astype(np.uint64)
        return mixed_hash(unit ^ mixed_hash(place + np.uint64(STEP))) < self.below

    def keys(self, variants: np.ndarray, at: np.ndarray) -> np.ndarray:
        """The keys of the units number ``at`` of the documents that draw by ``variants``."""
        return mixed_hash((variants ^ self.seed) + (at.astype(np.uint64) + np.uint64(1)) * np.uint64(STEP))

    def _key(self, unit: str, variant: int, at: int = 0) -> int:
        return int(self.keys(np.array([variant], np.uint64), np.array([at]))[0])

    def _made(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair makes, or -1."""
        key = (left.astype(np.int64) << 20) | right
        found = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where((left >= 0) & (right >= 0) & (self.pair_keys[found] == key), self.pair_made[found], np.int32(-1))

    def together(self, units: list[str], keys: np.ndarray, width: int) -> list[bytes]:
        """The pieces, as int32 bytes, of units of at most ``width`` known characters.

        Symbols stay where they are and are linked to their neighbours; the last column stands for no neighbour.
        """
        count = len(units)
        body = np.frombuffer("".join([u.ljust(width, "\0") for u in units]).encode("utf-32-le"), np.uint32).reshape(count, width)
        letters, where = np.unique(body, return_inverse=True)
        ids = np.array([self.single.get(SPACE if c == 32 else chr(c), -1) if c else -1 for c in letters.tolist()], np.int32)
        symbols = np.full((count, width + 1), -1, np.int32)
        symbols[:, :width] = ids[where].reshape(count, width)
        after = np.broadcast_to(np.arange(1, width + 2, dtype=np.int32), symbols.shape).copy()
        before = np.broadcast_to(np.arange(-1, width, dtype=np.int32), symbols.shape).copy()
        makes = np.full(symbols.shape, -1, np.int32)
        agenda = np.full(symbols.shape, NONE, np.int32)

        def offer(row: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
            """Put the merge of two neighbours on the agenda, or take it off."""
            made = self._made(symbols[row, left], symbols[row, right])
            place = np.full(len(made), NONE, np.int32)
            some = np.flatnonzero(made >= 0)
            kept = some[~self._skipped(keys[row[some]], left[some], made[some])]
            place[kept] = self.order[made[kept]]
            agenda[row, left] = place
            makes[row, left] = made

        row, left = np.nonzero(symbols[:, 1:width] >= 0)
        offer(row, left, left + 1)
        done = np.zeros(symbols.shape, np.int32)
        live = np.arange(count)
        while len(live):
            best = agenda.argmin(axis=1)
            each = np.flatnonzero(agenda[np.arange(len(live)), best] < NONE)
            if 2 * len(each) < len(live):  # half have ended
                ended = np.ones(len(live), bool)
                ended[each] = False
                done[live[ended]] = symbols[ended]
                live, best = live[each], best[each]
                symbols, after, before, agenda, makes, keys = (x[each] for x in (symbols, after, before, agenda, makes, keys))
                each = np.arange(len(live))
            if not len(each):
                done[live] = symbols
                break
            left = best[each]
            right = after[each, left]
            symbols[each, left] = makes[each, left]
            symbols[each, right] = -1
            agenda[each, right] = NONE
            beyond = after[each, right]
            after[each, left] = beyond
            before[each, beyond] = left
            offer(each, left, beyond)
            offer(each, before[each, left], left)
            agenda[each, width] = NONE
            before[each, 0] = -1
        whole = done >= 0
        data = done[whole].tobytes()
        ends = (4 * np.cumsum(whole.sum(axis=1))).tolist()
        return [data[a:b] for a, b in zip([0, *ends], ends, strict=False)]

    def _agenda(self, unit: str, key: int, trees: Trees | None = None) -> bytes:
        """The pieces, as int32 bytes, of one unit of known characters; its agenda is added to ``trees``."""
        symbols = [self.single[SPACE if c == " " else c] for c in unit]
        size = len(symbols)
        after, before = list(range(1, size + 1)), list(range(-1, size - 1))
        agenda: list[tuple[int, int, int, int, int]] = []
        pairs, places = self.pairs, self.places
        branch = trees.root(unit) if trees else 0

        def offer(left: int) -> None:
            right = after[left]
            if right < size:
                made = pairs.get(symbols[left] << 20 | symbols[right])
                if made is not None:
                    heapq.heappush(agenda, (places[made], left, made, symbols[left], symbols[right]))

        for n in range(size - 1):
            offer(n)
        while agenda:
            _, left, made, was, other = heapq.heappop(agenda)
            right = after[left]
            if symbols[left] != was or right >= size or symbols[right] != other:
                continue
            place = mixed(((left << 32 | made) + STEP) & MASK)
            skipped = mixed(key ^ place) < self.most
            if trees:
                node = int(trees.branches[branch])
                if node == trees.UNKNOWN:
                    node = trees.node(place)
                    trees.branches[branch] = node
                branch = 2 * node + skipped
            if skipped:
                continue
            symbols[left], symbols[right] = made, -1
            after[left] = after[right]
            if after[left] < size:
                before[after[left]] = left
            offer(left)
            if before[left] >= 0:
                offer(before[left])
        pieces = np.array([s for s in symbols if s >= 0], np.int32).tobytes()
        if trees and trees.branches[branch] == trees.UNKNOWN:
            trees.branches[branch] = trees.leaf(pieces)
        return pieces

    def alone(self, unit: str, variant: int) -> bytes:
        """The pieces of one unit by an agenda of its own."""
        return self._agenda(unit, self._key(unit, variant))

    def _character(self, unit: str) -> bytes:
        piece = self.single.get(SPACE if unit == " " else unit) if unit != SPACE else None
        ids = [piece] if piece is not None else [self.byte_ids[b] for b in unit.encode("utf-8", "surrogatepass")]
        return np.array(ids, np.int32).tobytes()

    def cut(self, units: list[str], keys: np.ndarray) -> list[bytes]:
        """The pieces, as int32 bytes, of every unit under its key."""
        if self.trees.size + len(self.trees.leaves) > KEPT_NODES:
            self.trees = Trees()
        trees = self.trees
        for unit, times in Counter(units).items():
            if len(unit) == 1 and unit not in trees.roots:
                root = trees.root(unit)  # may grow the branches
                trees.branches[root] = trees.leaf(self._character(unit))
            elif times >= OFTEN and len(unit) <= LONGEST:
                trees.root(unit)
        branch = np.array([trees.roots.get(u, -1) for u in units], np.int64)
        ends = np.full(len(units), -1, np.int64)
        live = np.flatnonzero(branch >= 0)
        while len(live):
            found = trees.branches[branch[live]]
            fresh = live[found == trees.UNKNOWN]
            if len(fresh):
                _, first, times = np.unique(branch[fresh], return_index=True, return_counts=True)
                for n in fresh[first[times >= BRANCH_OFTEN]].tolist():
                    self._agenda(units[n], int(keys[n]), trees)
                found = trees.branches[branch[live]]
            ended = found <= trees.LEAF
            ends[live[ended]] = trees.LEAF - found[ended]
            onwards = found >= 0
            live, node = live[onwards], found[onwards].astype(np.int64)
            branch[live] = 2 * node + (mixed_hash(keys[live] ^ trees.hashes[node]) < self.below)
        pieces = [trees.leaves[n] if n >= 0 else b"" for n in ends.tolist()]
        rest = np.flatnonzero(ends < 0)
        sizes = np.array([len(units[n]) for n in rest.tolist()], np.int64)
        group = np.searchsorted(LENGTHS, sizes)
        for g, width in enumerate(LENGTHS):
            members = rest[group == g]
            for start in range(0, len(members), TOGETHER):
                some = members[start : start + TOGETHER]
                for n, made in zip(some.tolist(), self.together([units[n] for n in some.tolist()], keys[some], width), strict=True):
                    pieces[n] = made
        for n in rest[sizes > LONGEST].tolist():
            pieces[n] = self._agenda(units[n], int(keys[n]))
        return pieces

    def units_of(self, text: str | None) -> list[str]:
        """The units of a text, after the space that the model puts before it."""
        return self.unit.findall(" " + text) if text else []

    def fill(self, known: dict[str, bytes], units: set[str], variant: int) -> None:
        """Add the pieces of ``units`` to ``known``, each as the first of a document."""
        members = sorted(units)
        known.update(zip(members, self.cut(members, self.keys(np.full(len(members), variant, np.uint64), np.zeros(len(members)))), strict=True))

    def encode(self, text: str | None, variant: int = 0) -> list[int]:
        units = self.units_of(text)
        pieces = self.cut(units, self.keys(np.full(len(units), variant, np.uint64), np.arange(len(units))))
        return np.frombuffer(b"".join(pieces), np.int32).tolist()

    def decode(self, ids) -> str:
        """The text of some pieces: their bytes, without the space put before the text."""
        return b"".join([self.bytes_of[n] for n in ids])[1:].decode("utf-8", "surrogatepass")


def variant_of(doc: Column, seed: int, *copy: Column) -> Column:
    """The number that a document, or a copy of it, draws by: 64 bits as a bigint."""
    return F.xxhash64(F.lit(seed), doc, *copy)


def _sub_batches(batch: pa.RecordBatch, text: str) -> Iterator[pa.RecordBatch]:
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(batch.column(text)), 0), np.int64)
    part = np.cumsum(sizes) // SUB_BATCH
    edges = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def encoded(
    docs: DataFrame,
    text: str = "text",
    doc: str = "doc_id",
    model: str = MODEL,
    dropout: float = DROPOUT,
    seed: int = SEED,
    copy: str | None = None,
) -> DataFrame:
    """``docs`` with ``ids`` (the pieces), ``n_tokens`` and ``lossless``: whether decoding gave the text back.

    ``copy`` names the column, if any, that numbers the copies of a document, which are cut each by its own draws.
    """
    proto = Path(model).read_bytes()  # half a megabyte, sent with the job
    kept = [c for c in docs.columns if c not in ("ids", "n_tokens", "lossless")]
    fields = docs.select(*kept).schema.fields
    schema = T.StructType(
        [
            *fields,
            T.StructField("ids", T.ArrayType(T.IntegerType(), False)),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("lossless", T.BooleanType()),
        ]
    )

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec(proto, dropout, seed)
        for whole in batches:
            for batch in _sub_batches(whole, text):
                texts = batch.column(text).to_pylist()
                units = [codec.units_of(t) for t in texts]
                counts = np.array([len(u) for u in units], np.int64)
                lasts = np.cumsum(counts)
                variants = batch.column("__variant").to_numpy().view(np.uint64)
                at = np.arange(counts.sum()) - np.repeat(lasts - counts, counts)
                cuts = codec.cut(list(itertools.chain.from_iterable(units)), codec.keys(np.repeat(variants, counts), at))
                ids, same = [], []
                for body, count, last in zip(texts, counts.tolist(), lasts.tolist(), strict=True):
                    found = np.frombuffer(b"".join(cuts[last - count : last]), np.int32)
                    ids.append(found)
                    same.append(codec.decode(found.tolist()) == (body or ""))
                offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
                values = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                columns = [c for c, n in zip(batch.columns, batch.schema.names, strict=True) if n != "__variant"]
                columns += [
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                    pa.array(np.diff(offsets).astype(np.int64)),
                    pa.array(same, pa.bool_()),
                ]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    variant = variant_of(F.col(doc), seed, *([F.col(copy)] if copy else []))
    return docs.select(*kept, variant.alias("__variant")).mapInArrow(work, schema)


def op6_pieces(spark: SparkSession, directory: str) -> DataFrame:
    """Pieces of every document, their digest, and whether they decode to the text."""
    rows = encoded(table(spark, directory, "documents").select("doc_id", "text"))
    digest = F.sha2(F.array_join("ids", " ").cast("binary"), 256)
    return rows.select("doc_id", "n_tokens", digest.alias("ids_digest"), "lossless")


def pieces_stage(spark: SparkSession, docs: DataFrame, directory: str) -> DataFrame:
    """The corpus as pieces. The mix does not number the copies of a document, so they are cut alike."""
    return encoded(docs).select("doc_id", "lang", "source", "ids", "n_tokens", "lossless")
