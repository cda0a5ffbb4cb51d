"""SimHash, toxicity, neighbours, pieces, chunk dedup, HTML extraction and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import random
import time
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from saldo.llm import chunk_dedup, html_text, neighbours, pieces, quality_rules, simhash, source_mix, toxicity
from saldo.llm.components import components

RNG = random.Random(11)
PARTS = ["ra", "no", "ti", "elle", "the", "un", "ge", "ß", "é", "sto", "mi", "ka"]


def prose(count):
    return " ".join("".join(RNG.choice(PARTS) for _ in range(RNG.randint(1, 4))) for _ in range(count))


def spoiled(text, changes):
    words = text.split(" ")
    for _ in range(changes):
        words[RNG.randrange(len(words))] = prose(1)
    return " ".join(words)


# --- SimHash


def slow_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    grams = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def signed(value):
    return value - (1 << 64) if value >> 63 else value


TEXTS = [None, "", " \n\x0b", "one", "One TWO three", "one two three four", "É ß\x1cx\x85y z w", "a " * 300]


def test_fingerprints(spark):
    long = prose(40_000)
    assert len(long.encode()) > simhash.SLICE / 8
    for text in [*TEXTS, prose(500), long, "a\n" + "b" * 3_000_000 + " c d", prose(3) + " " * 2_500_000 + prose(9)]:
        assert simhash.fingerprint(text) == signed(slow_fingerprint(text))
    rows = spark.createDataFrame([("aB c d e",)], "text string").select(F.xxhash64(F.lower("text")).alias("h")).first()
    assert xxhash.xxh64_intdigest(b"ab c d e", 42) == rows["h"] % (1 << 64)


@pytest.mark.parametrize("wide", [False, True])
def test_pairs_are_all_pairs(spark, wide):
    values = {0, (1 << 64) - 1, 0b1111, 0b11111}
    for _ in range(150):
        value = RNG.getrandbits(64)
        values.add(value)
        for _ in range(4):
            other = value
            for bit in RNG.sample(range(64), RNG.randint(1, 7)):
                other ^= 1 << bit
            values.add(other)
    want = {(a, b) for a in map(signed, values) for b in map(signed, values) if a < b and ((a ^ b) % (1 << 64)).bit_count() <= 4}
    prints = spark.createDataFrame([(signed(v),) for v in values], "__fp long")
    got = [(r["u"], r["v"]) for r in simhash.linked_pairs(prints, wide).collect()]
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 150


def test_pairs_are_joined_without_broadcast(spark, tmp_path):
    """The signatures are 64 times the fingerprints that Spark goes by: a small table of these must not send them to the driver."""
    path = str(tmp_path / "prints")
    spark.range(2000).select(F.xxhash64("id").alias("__fp")).write.parquet(path)
    pairs = simhash.linked_pairs(spark.read.parquet(path), False)
    pairs.write.format("noop").mode("overwrite").save()
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_components_of_chains_and_stars(spark):
    edges = [(n, n + 1) for n in range(40)] + [(100, n) for n in range(101, 160)] + [(7, 7), (300, 200), (200, 300)]
    frame = spark.createDataFrame(edges, "u long, v long")
    got = {(r["node"], r["root"]) for r in components(frame).collect()}
    want = {(n, 0) for n in range(41)} | {(n, 100) for n in range(100, 160)} | {(200, 200), (300, 200)}
    assert got == want
    assert components(frame.filter("u < 0")).count() == 0


def groups(rows):
    """The set of row numbers of each component."""
    prints = [slow_fingerprint(t) for _, t in rows]
    left, found = set(range(len(rows))), []
    while left:
        group, fresh = set(), {left.pop()}
        while fresh:
            group |= fresh
            fresh = {j for j in left if any((prints[i] ^ prints[j]).bit_count() <= 4 for i in fresh)}
            left -= fresh
        found.append(group)
    return found


def near_rows():
    rows = [(n, t) for n, t in enumerate(TEXTS)] + [(None, ""), (None, "no id at all"), (None, "no id at all")]
    for n in range(25):
        base = prose(120)
        rows += [(100 + 10 * n + k, spoiled(base, RNG.randint(0, 2))) for k in range(RNG.randint(1, 5))]
    return rows + [rows[-1], (500, rows[20][1]), (500, prose(70))]


def test_simhash_components_and_stage(spark):
    rows = near_rows()
    docs = spark.createDataFrame([(i, t, "x", n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, component_id string, node long")
    got = simhash.with_components(simhash.fingerprinted(docs)).collect()
    want = {}
    for group in groups(rows):
        ids = [rows[n][0] for n in group if rows[n][0] is not None]
        want |= {n: min(ids) if ids else None for n in group}
    assert {r["node"]: r["component_id"] for r in got} == want and len(got) == len(rows)
    staged = simhash.simhash_stage(spark, docs, "")
    kept = {r["node"] for r in staged.collect()}
    assert staged.columns == docs.columns
    for group in groups(rows):
        chosen = kept & group
        assert len(chosen) == 1
        assert rows[chosen.pop()][0] == want[min(group)]
    assert simhash.simhash_stage(spark, docs.limit(0), "").count() == 0


# --- toxicity


def toxic_corpus():
    bad = ["snorf", "blarg", "zwick"]
    docs, labels = [], []
    for n in range(700):
        words = prose(RNG.randint(5, 150)).split()
        toxic = n % 5 == 0
        for _ in range(3 * toxic):
            words.insert(RNG.randrange(len(words)), RNG.choice(bad) + RNG.choice(["", "ra", "mi"]))
        docs.append((n, " ".join(words)))
        labels.append((n, int(toxic)))
    return docs, labels


def test_toxicity_on_held_out_texts(spark):
    rows, marks = toxic_corpus()
    rows = rows + [(None, "a snorf"), (9000, None), (9001, ""), (9002, prose(50_000)), (9003, "x" * 200_000), (3, rows[3][1])]
    docs = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, score string")
    labels = spark.createDataFrame([*marks, (None, 1), (5, None)], "doc_id long, toxic int")
    model = toxicity.learned(docs, labels)
    got = toxicity.scored(docs, model).collect()
    assert len(got) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)
    truth = dict(marks)
    import zlib

    out = [r for r in got if r["doc_id"] in truth and zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2]
    flags = docs.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).filter("h").collect()
    assert {r["doc_id"] for r in flags} >= {r["doc_id"] for r in out}
    assert len(out) > 100
    hits = [r["predicted"] for r in out if truth[r["doc_id"]]]
    false = [r["predicted"] for r in out if not truth[r["doc_id"]]]
    assert np.mean(hits) > 0.9 and np.mean(false) < 0.05
    again = toxicity.scored(docs.repartition(5), toxicity.learned(docs.repartition(3), labels)).collect()
    assert Counter(map(repr, got)) == Counter(map(repr, again))
    # labels of held-out texts change nothing
    turned = labels.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert toxicity.learned(docs, turned) == model


def slow_score(model, text):
    """One text's score, word by word from the model's bytes."""
    import math

    import zstandard

    plain, toxic = model.compressors()
    words = (text or "").lower().split()
    cut = [f" {' '.join(words[n : n + toxicity.WINDOW])} ".encode() for n in range(0, len(words), toxicity.WINDOW)]
    saved = [len(plain(w)) - len(toxic(w)) for w in cut] or [0]
    for w in cut[:3]:  # lengths are those of frames that give the window back
        data = zstandard.ZstdCompressionDict(model.toxic + model.ordinary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        reader = zstandard.ZstdDecompressor(dict_data=data, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        assert reader.decompress(toxic(w), max_output_size=1 << 20) == w
    found = [max(saved), sum(s for s in saved if s > 0) / math.sqrt(len(saved)), math.log(len(saved))]
    found += [math.log1p(sum(s >= k for s in saved)) for k in toxicity.SAVINGS]
    found += [sum(s >= k for s in saved) / len(saved) for k in toxicity.SAVINGS[1:]]
    z = model.weights[0] + sum(w * (f - m) / d for w, f, m, d in zip(model.weights[1:], found, model.mean, model.spread, strict=True))
    return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def test_toxicity_scores_are_those_of_the_models_bytes(spark):
    rows, marks = toxic_corpus()
    rows = rows + [(None, "a snorf"), (9000, None), (9001, ""), (9002, prose(5000))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.learned(docs, spark.createDataFrame(marks, "doc_id long, toxic int"))
    got = toxicity.scored(docs.withColumn("body", F.col("text")), model).collect()
    assert len(got) == len(rows)
    for r in got:
        assert abs(r["score"] - slow_score(model, r["body"])) < 1e-9 and r["predicted"] == int(r["score"] >= 0.3)


def test_toxicity_without_examples(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    rows = toxicity.scored(docs, toxicity.learned(docs, labels)).collect()
    assert [r["score"] for r in rows] == [0.5, 0.5]
    assert toxicity.scored(docs.limit(0), toxicity.learned(docs.limit(0), labels)).count() == 0


def test_windows_cover_every_word():
    for text in (None, "", "  ", prose(100), prose(400_000), "y" * 3_000_000):
        words = b" ".join(toxicity.windows(text)).decode().split()
        assert words == (text or "").lower().split()


# --- neighbours


def exact_neighbours(vectors, asked, k):
    good = {}
    for ident, v in vectors:
        if ident is not None and v is not None and len(v) == 8 and all(x is not None and np.isfinite(x) for x in v) and any(v):
            good.setdefault(ident, []).append(np.array(v, float))
    result = {}
    for q in good:
        if q % asked == 0:
            scores = {}
            for other, bodies in good.items():
                if other != q:
                    near = [neighbours.cosines(a[None], b[None])[0] for a in good[q] for b in bodies]
                    scores[other] = max(near)
            result[q] = sorted(scores.items(), key=lambda s: (-s[1], s[0]))[:k]
    return result


SCHEMA = "vec_id long, embedding array<float>, label int"


def test_neighbours_recall_scores_and_ties(spark):
    draw = np.random.default_rng(3)
    centres = draw.standard_normal((20, 8))
    vectors = [(n, (centres[n % 20] + 0.3 * draw.standard_normal(8)).astype(np.float32).tolist()) for n in range(1500)]
    same = vectors[0][1]
    vectors += [(2000 + n, same) for n in range(700)]  # a large group of copies
    vectors += [(3000, None), (3050, [0.0] * 8), (3100, [1.0, None] * 4), (3150, [float("nan")] * 8), (3200, [1.0] * 3), (None, same)]
    vectors += [(3250, [float("inf")] * 8), (50, vectors[50][1]), (3300, [1e-20] * 8), (3350, [1e18] * 8)]
    frame = spark.createDataFrame([(*v, 1) for v in vectors], SCHEMA)
    got = defaultdict(dict)
    for row in neighbours.search(frame, F.col("vec_id") % 50 == 0).collect():
        got[row["query_id"]][row["rank"]] = (row["vec_id"], row["score"])
    want = exact_neighbours(vectors, 50, 5)
    assert set(got) == set(want)
    hits = []
    for q, found in got.items():
        assert sorted(found) == [1, 2, 3, 4, 5]
        scores = [found[n][1] for n in range(1, 6)]
        assert scores == sorted(scores, reverse=True) and len({v for v, _ in found.values()}) == 5
        hits.append(len({v for v, _ in found.values()} & {v for v, _ in want[q]}) / 5)
        truth = dict(want[q])
        assert all(s == pytest.approx(truth[v], abs=1e-12) for v, s in found.values() if v in truth)
    assert np.mean(hits) > 0.9
    # among copies the smallest ids win
    assert [got[2000][n][0] for n in range(1, 6)] == [0, 2001, 2002, 2003, 2004]


@pytest.mark.parametrize("size", [0, 1, 2, 4])
def test_few_vectors_are_all_returned(spark, size):
    vectors = [(50 * n, [float((n + 1) ** i % 7 - 3) for i in range(8)]) for n in range(size)]
    frame = spark.createDataFrame([(*v, 1) for v in vectors], SCHEMA)
    rows = neighbours.search(frame, F.col("vec_id") % 50 == 0).collect()
    want = {(q, n, v) for q, found in exact_neighbours(vectors, 50, 5).items() for n, (v, _) in enumerate(found, 1)}
    assert {(r["query_id"], r["rank"], r["vec_id"]) for r in rows} == want


@pytest.mark.parametrize("times", [2, 6])
@pytest.mark.parametrize("apart", [0.0, 1e-3])
def test_neighbours_of_repeated_rows(spark, times, apart):
    draw = np.random.default_rng(9)
    centres = draw.standard_normal((6, 8))
    vectors = []
    for n in range(300):
        body = centres[n % 6] + 0.2 * draw.standard_normal(8)
        vectors += [(n, (body + apart * draw.standard_normal(8)).astype(np.float32).tolist()) for _ in range(times if apart else 1)] * (1 if apart else times)
    frame = spark.createDataFrame([(*v, 1) for v in vectors], SCHEMA)
    want = exact_neighbours(vectors, 50, 5)
    got = defaultdict(dict)
    for row in neighbours.search(frame, F.col("vec_id") % 50 == 0).collect():
        got[row["query_id"]][row["vec_id"]] = row["score"]
    assert all(len(found) == 5 for found in got.values()) and set(got) == set(want)
    assert np.mean([len(set(got[q]) & {v for v, _ in want[q]}) / 5 for q in want]) > 0.9
    truth = {q: dict(found) for q, found in want.items()}
    assert all(s == pytest.approx(truth[q][v], abs=1e-12) for q, found in got.items() for v, s in found.items() if v in truth[q])


# --- pieces

BODIES = ["", "a", "  x  ", " ", "日本語 テスト 😀 ▁▁ a▁b", " " * 70 + "q", "x" * 100 + " " + "abc" * 200, "\n\n\t foo\r\n", "\x00 end ", "if (x) {\n        return;\n    }"]


def proto():
    with open(pieces.MODEL, "rb") as file:
        return file.read()


def test_pieces_without_dropout_are_the_librarys():
    model = sentencepiece.SentencePieceProcessor(model_proto=proto())
    codec = pieces.Codec(proto(), 0.0, 1)
    for text in [*BODIES, prose(400), "the international considerations of understanding " * 20]:
        if "▁" not in text:
            assert codec.encode(text) == model.encode(text)
        assert codec.decode(codec.encode(text)) == text


def slow_merges(codec, unit, variant):
    """The agenda written out: all candidates anew after every merge, the skipped ones left out for good."""
    parts = [(n, codec.single["▁" if c == " " else c]) for n, c in enumerate(unit)]
    key = np.array([codec._key(unit, variant)], np.uint64)
    while True:
        best = None
        for i in range(len(parts) - 1):
            made = codec.pairs.get(parts[i][1] << 20 | parts[i + 1][1])
            if made is None or codec._skipped(key, np.array([parts[i][0]]), np.array([made]))[0]:
                continue
            if best is None or codec.order[made] < best[0]:
                best = (codec.order[made], i, made)
        if best is None:
            return [p for _, p in parts]
        _, i, made = best
        parts[i : i + 2] = [(parts[i][0], made)]


@pytest.mark.parametrize("dropout", [0.0, 0.3, 0.9])
def test_dropout_follows_the_agenda(dropout):
    codec = pieces.Codec(proto(), dropout, 5)
    units = {u for u in codec.units_of(prose(300) + " " + "internationalisation " * 3 + "thethethe" * 30) if len(u) > 1}
    known = {}
    codec.fill(known, units, 2)
    for unit in units:
        slow = np.array(slow_merges(codec, unit, 2), np.int32).tobytes()
        assert known[unit] == slow == codec.alone(unit, 2)


def test_pieces_vary_and_decode(spark):
    text = "the international considerations of understanding something remarkable " * 3
    rows = [(n, text, "own") for n in range(40)] + [(50 + n, b, "own") for n, b in enumerate(BODIES)]
    rows += [(None, None, "own"), (1, text, "own"), (90, prose(60_000), "own")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = pieces.encoded(docs).collect()
    model = sentencepiece.SentencePieceProcessor(model_proto=proto())
    assert len(got) == len(rows) and all(r["lossless"] and r["n_tokens"] == len(r["ids"]) for r in got)
    for row in got:
        if "▁" not in (row["text"] or ""):
            assert model.decode(row["ids"]) == (row["text"] or "")
    assert 1 < len({tuple(r["ids"]) for r in got if r["text"] == text}) <= pieces.VARIANTS
    again = {(r["doc_id"], tuple(r["ids"])) for r in pieces.encoded(docs.repartition(9)).collect()}
    assert again == {(r["doc_id"], tuple(r["ids"])) for r in got}
    other = {(r["doc_id"], tuple(r["ids"])) for r in pieces.encoded(docs, seed=2).collect()}
    assert other != again
    assert pieces.encoded(docs.limit(0)).count() == 0


def test_every_occurrence_and_copy_draws_for_itself(spark):
    text = " ".join(["considerations"] * 400)
    docs = spark.createDataFrame([(1, text, "en", "a", 1), (1, text, "en", "a", 2), (2, text, "en", "a", 1)], "doc_id long, text string, lang string, source string, copy_no int")
    got = pieces.encoded(docs, copy="copy_no").collect()
    assert all(r["lossless"] for r in got) and len({tuple(r["ids"]) for r in got}) == 3
    codec = pieces.Codec(proto(), pieces.DROPOUT, pieces.SEED)
    for row in got:
        words, word = [], []
        for n in row["ids"]:
            if codec.bytes_of[n].startswith(b" ") and word:
                words, word = [*words, tuple(word)], []
            word.append(n)
        assert len({*words, tuple(word)}) > 4


def test_trees_follow_the_agenda_for_every_key(monkeypatch):
    monkeypatch.setattr(pieces, "KEPT_NODES", 500)
    codec = pieces.Codec(proto(), 0.3, 5)
    units = codec.units_of("the international considerations of understanding " * 40 + "thethethe" * 30 + prose(200) + "".join(map(chr, range(0x4E00, 0x6000))))
    keys = codec.keys(np.full(len(units), 9, np.uint64), np.arange(len(units)))
    for _ in range(2):
        for unit, key, found in zip(units, keys, codec.cut(units, keys), strict=True):
            assert found == (codec._agenda(unit, int(key)) if len(unit) > 1 else codec._character(unit))


# --- chunk dedup


def slow_chunks(text):
    """Chunks by the definition, for texts without long words or long stretches."""
    body = (text or "").encode()
    gear = [int(g) for g in chunk_dedup.gear_table()]
    starts = [m.start() for m in re.finditer(rb"[^\x20\x09-\x0D]+", body)]
    if len(starts) < chunk_dedup.LEAST_WORDS:
        return []
    value = [sum(gear[body[p - 1 - k]] << k for k in range(min(16, p))) * 0x9E3779B1 % (1 << 32) for p in starts]
    near = chunk_dedup.NEAR
    cut = [
        i for i in range(len(starts)) if i == 0 or all(value[i] < v for v in value[max(0, i - near) : i]) and all(value[i] <= v for v in value[i + 1 : i + 1 + near])
    ]
    found = []
    for i, j in zip(cut, [*cut[1:], len(starts)], strict=True):
        a, b = starts[i], starts[j] if j < len(starts) else len(body)
        at = len(body[:a].decode())
        found.append((at, at + len(body[a:b].decode()), j - i, hashlib.blake2b(body[a:b].rstrip(), digest_size=16).digest()))
    return found


def slow_runs(rows):
    owner = {}
    for doc, text in rows:
        cut = [c[3] for c in slow_chunks(text)]
        for found in [*cut, *zip(cut, cut[1:])]:  # chunks, and chunks side by side
            owner[found] = min(owner.get(found, (True, 0)), (doc is None, doc or 0))
    runs = set()
    for doc, text in rows:
        run, me = [], (doc is None, doc or 0)
        for chunk in [*slow_chunks(text), None]:
            copied = chunk and owner[chunk[3]] != me
            if copied and (not run or owner[run[-1][3], chunk[3]] != me):
                run.append(chunk)
                continue
            if sum(c[2] for c in run) >= chunk_dedup.LEAST_WORDS:
                runs.add((doc, text, run[0][0], run[-1][1], sum(c[2] for c in run), tuple(sorted({owner[c[3]][1] for c in run}))))
            run = [chunk] if copied else []
    return runs


def passage_rows():
    passages = [prose(60), prose(90)]
    rows = [(n, prose(RNG.randint(0, 150))) for n in range(40)]
    for n, (doc, text) in enumerate(rows[:24]):
        words = text.split(" ")
        at = RNG.randrange(len(words))
        rows[n] = (doc, " ".join([*words[:at], passages[n % 2], *words[at:]]))
    rows += [(None, rows[0][1]), (100, None), (101, ""), (102, "short " + prose(5)), (5, rows[5][1]), (6, prose(80))]
    return rows + [(200, prose(70) + "\n\n\t" + passages[0] + "\r\n"), (201, passages[1])]


def test_chunks_and_runs(spark):
    rows = passage_rows()
    gear = chunk_dedup.gear_table()
    for _, text in rows:
        made = chunk_dedup.chunked(text, gear)
        fast = [] if made is None else [(int(a), int(b), int(w), d.tobytes()) for a, b, w, d in zip(*made, strict=True)]
        assert fast == slow_chunks(text)
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, stop string")
    text_of = {(r["doc_id"], r["key"]): r["text"] for r in docs.withColumn("key", chunk_dedup.text_key(F.col("text"))).collect()}
    got = {(r["doc"], text_of[r["doc"], r["copy"]], r["start"], r["stop"], r["words"], tuple(r["first_docs"])) for r in chunk_dedup.duplicate_runs(docs).collect()}
    want = slow_runs(rows)
    assert got == want
    # each passage is found in every document but the first that has it
    assert {d for d, *_ in want if d is not None} >= set(range(2, 24)) | {200, 201}
    left = defaultdict(list)
    for doc, text, a, b, _, _ in want:
        left[doc, text].append((a, b))
    cut = {}
    for doc, text in rows:
        kept, at = "", 0
        for a, b in sorted(left[doc, text]):
            kept, at = kept + text[at:a], b
        cut[doc, text] = text and kept + text[at:]
    staged = chunk_dedup.chunk_dedup_stage(spark, docs, "")
    assert staged.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in staged.collect()) == Counter((d, cut[d, t]) for d, t in rows)
    assert chunk_dedup.duplicate_runs(docs.limit(0)).count() == 0


def test_chunks_of_unrelated_documents_make_no_run(spark):
    """A text whose chunks all stand in earlier documents, each in another."""
    source = prose(150)
    cut = slow_chunks(source)
    rows = [(n + 10, prose(40) + " " + source[c[0] : c[1]] + " " + prose(40)) for n, c in enumerate(cut[1:-1])]
    rows.append((999, source))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["doc"], r["start"], r["stop"]) for r in chunk_dedup.duplicate_runs(docs).collect()}
    assert got == {(d, a, b) for d, _, a, b, *_ in slow_runs(rows)} and not any(d == 999 for d, *_ in got)


def test_chunks_of_long_and_even_texts():
    gear = chunk_dedup.gear_table()
    rolls = random.Random(1)
    for text in ("a" * 3_000_000 + " b" * 30, "go " * 5000, "".join(rolls.choice("abcdé") for _ in range(2_000_000)) + " x" * 40, prose(300_000)):
        first, last, words, _ = chunk_dedup.chunked(text, gear)
        assert (first[1:] == last[:-1]).all() and last[-1] == len(text) and words.max() <= chunk_dedup.MOST_WORDS
    shared = "".join(rolls.choice("abcd") for _ in range(5000))
    one, two = ({d.tobytes() for d in chunk_dedup.chunked(x * 300 + shared + " z" * 40, gear)[3]} for x in ("q", "rs"))
    assert len(one & two) > 20  # words without blanks find their cuts again


# --- HTML


def text_of(page):
    return html_text.main_text(page, html_text.stop_words())


ARTICLE = "The first of the paragraphs is here and it has all of the words that one would expect to be in it."


def test_main_text_of_pages():
    page = f"""<html><head><title>T</title><style>p>q{{}}</style><script>var a="</p><article>";</script></head><body>
    <header><h1>Site</h1><p>{ARTICLE}</p></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">{ARTICLE}</div>
    <main><article><h1>Head &amp; line</h1><p>{ARTICLE}<p>Short&nbsp;\n one.<br>On<aside><p>{ARTICLE}</aside>
    <div class="advert">{ARTICLE}</div><p><b>In <i>one</i></b> block&#33;</p><form>{ARTICLE}<input></form>
    <ul><li>first</li><li>second</li></ul><section id="comments"><article class="comment"><p>{ARTICLE}</p></article></section></article></main>
    <div class="sidebar">{ARTICLE}</div><footer>&copy; {ARTICLE}</footer></body></html>"""
    assert text_of(page).split("\n") == ["Head & line", ARTICLE, "Short one. On", "In one block!", "first", "second"]
    plain = f"<div id=menu><a href=1>One</a></div><div><h2>Story</h2><p>{ARTICLE}</p><p>Yes.</p><p>{ARTICLE}</p></div><div class=comments>{ARTICLE}</div>"
    assert text_of(plain).split("\n") == ["Story", ARTICLE, "Yes.", ARTICLE]


@pytest.mark.parametrize(
    ("page", "text"),
    [
        (None, ""),
        ("", ""),
        ("<nav>a", ""),
        ("<article>a<!-- b", "a"),
        ("<article>a<di", "a"),
        ('<article>a <b class="x', "a"),
        ("<article>1 < 2 &lt;b&gt; &amp;amp; & &unknown;</article>", "1 < 2 <b> &amp; & &unknown;"),
        ("<article><p>a</p></div></article></article><p>b", "a"),
        ("<article><p>" + "w " * 100_000 + "</p></article>", "w " * 99_999 + "w"),
        ("<article>" + "<p>x</p>" * 5000 + "</article>", "x\n" * 4999 + "x"),
        ("<article>" + "<div>" * 5000 + "deep", "deep"),
        ("<article>a<script>b</script >c<style>d", "ac"),
    ],
)
def test_odd_pages(page, text):
    assert text_of(page) == text


STORY = [ARTICLE, "It was the end of the day and they had not seen it, but she was with him and he with her. " * 3]
FOREIGN = [
    "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, perche la diritta via era smarrita. " * 3,
    "天地玄黄宇宙洪荒日月盈昃辰宿列张寒来暑往秋收冬藏。闰余成岁律吕调阳云腾致雨露结为霜金生丽水玉出昆冈。" * 4,
]
STORY = [" ".join(t.split()) for t in STORY]
FOREIGN = [" ".join(t.split()) for t in FOREIGN]


def paragraphs(lines):
    return "".join(f"<p>{t}</p>" for t in lines)


@pytest.mark.parametrize(
    "page",
    [
        '<div class="layout with-sidebar"><article>{}</article></div>',
        '<div class="sidebar-layout"><article>{}</article><div class="sidebar"><p>' + ARTICLE + "</div></div>",
        '<div class="no-ads"><article>{}</article></div>',
        '<main class="post has-comments">{}</main>',
        '<article class="category-social-policy">{}</article>',
        '<form id="aspnetForm"><div><article>{}</article></div><div class=footer><p>' + ARTICLE + "</div></form>",
        '<form id="aspnetForm"><div id=content>{}</div></form>',
        "<article class=card>Short teaser</article><div id=content>{}</div>",
        "<nav>" + ARTICLE + "</nav><div class=comment-page>{}</div>",
        "<div id=content>{}</div><section id=comments><article class=comment><p>" + ARTICLE * 9 + "</article></section>",
        "<article>{}</article><section id=comments><article class=comment><p>" + ARTICLE * 9 + "</article></section>",
        "<div class=menu><ul>" + "<li><a href=/x>One of many links to other pages of this site</a>" * 9 + "</ul></div><div>{}</div>",
        "<div>{}</div><div class=cookie-banner><p>" + ARTICLE * 2 + "</div><div class='newsletter'><form><p>" + ARTICLE + "</form></div>",
    ],
)
def test_a_word_around_the_story_does_not_lose_it(page):
    for story in (STORY, STORY * 4):
        assert text_of(page.replace("{}", paragraphs(story))).split("\n") == story


@pytest.mark.parametrize("line", FOREIGN)
def test_pages_in_other_languages(line):
    story = [line, line[: len(line) // 2] + "."]
    assert text_of(f"<ul class=nav><li><a>Casa</a></ul><div>{paragraphs(story)}</div><div id=footer>{ARTICLE}</div>").split("\n") == story


def test_generated_pages_keep_the_story_alone():
    """Pages put together from parts whose role is known, nested in wrappers of any name."""
    rng = random.Random(9)
    bad = ["<nav>{}</nav>", "<aside>{}</aside>", "<footer>{}</footer>", "<div class='ad'>{}</div>", "<div id=related>{}</div>", "<script>{}</script>",
           "<div class='social share'>{}</div>", "<div class='cookie-consent'>{}</div>", "<section class=comments>{}</section>"]
    wrappers = ["<div>{}</div>", "<div class='page has-sidebar'>{}</div>", "<form>{}</form>", "<div class='sidebar-left'>{}</div>", "<section>{}</section>", "{}"]
    for n in range(300):
        story, parts = [], []
        for _ in range(rng.randrange(2, 7)):
            line = " ".join([ARTICLE, f"Part {len(story)} of {n}."][: rng.choice([2, 2, 1])])
            story.append(line)
            parts.append(rng.choice(["<p>{}</p>", "<div>{}</div>", "<blockquote>{}</blockquote>"]).format(line))
            if rng.random() < 0.3:
                parts.append(rng.choice(bad).format("<p>" + ARTICLE + "</p>"))
        body = rng.choice(["<article>{}</article>", "<main>{}</main>", "<article class='post promo'>{}</article>"]).format("".join(parts))
        for _ in range(rng.randrange(4)):
            body = rng.choice(wrappers).format(body)
        page = rng.choice(bad).format("<p>" + ARTICLE + "</p>") + body + rng.choice(bad).format("<p>" + ARTICLE * 2 + "</p>")
        assert text_of(f"<html><head><title>x</title></head><body>{page}</body></html>").split("\n") == story, page


@pytest.mark.parametrize("page", ["</div>" * 100_000, "<div></p></span></section>" * 30_000, "<head><div><body>" * 30_000, "<div>" * 50_000 + "</section>" * 50_000])
def test_unmatched_tags_take_linear_time(page):
    started = time.process_time()
    assert text_of(f"<article>{ARTICLE}</article>" + page) == ARTICLE
    assert time.process_time() - started < 2


def test_unbalanced_quotes_take_linear_time():
    assert text_of("<article>" + "<a b='" * 20_000 + "x")[:1] in ("", "<", "x")


def test_extracted_rows(spark):
    rows = [(1, None, None), (None, "u", f"<article>{ARTICLE}</article>"), (2, "v", ""), (2, "v", "")]
    pages = spark.createDataFrame([(*r, "own") for r in rows], "page_id long, url string, html string, text string")
    got = html_text.extracted(pages)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert Counter(map(tuple, got.collect())) == Counter([(1, None, "", 0), (None, "u", ARTICLE, len(ARTICLE)), (2, "v", "", 0), (2, "v", "", 0)])
    assert html_text.extracted(pages.limit(0)).count() == 0


# --- pipeline


def test_pipeline_is_its_stages(spark, tmp_path):
    texts = [t for _, t in passage_rows() + near_rows()] + [prose(RNG.randint(50, 200)) for _ in range(80)]
    rows = [(n, t, RNG.choice(["en", "de", None]), RNG.choice(["a", "b", "c", None]), len(t or "")) for n, t in enumerate(texts)]
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    docs = spark.createDataFrame(rows, schema)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert [name.split()[0] for name, _ in corpus_pipeline.STAGES] == ["quality", "SimHash", "substring", "mixing", "SentencePiece"]
    got = Counter((r["doc_id"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    # the same by brute force, stage by stage
    from test_filters_and_rules import mix_targets, split_words, verdicts

    kept = [r for r, v in zip(rows, verdicts([(r[2], r[3], r[1]) for r in rows]), strict=True) if v[2]]
    kept = [kept[min(group, key=lambda n: kept[n][0])] for group in groups([(r[0], r[1]) for r in kept])]
    spans = defaultdict(list)
    for doc, _, a, b, _, _ in slow_runs([(r[0], r[1]) for r in kept]):
        spans[doc].append((a, b))
    cut = []
    for doc, text, lang, source, _ in kept:
        left, at = "", 0
        for a, b in sorted(spans[doc]):
            left, at = left + text[at:a], b
        cut.append((doc, left + text[at:], lang, source))
    sizes = Counter()
    for _, text, _, source in cut:
        sizes[source] += len(split_words(text))
    codec = pieces.Codec(proto(), pieces.DROPOUT, pieces.SEED)
    taken = Counter()
    texts = {doc: (text, source) for doc, text, _, source in cut}
    for (doc, ids), times in got.items():
        assert codec.decode(ids) == texts[doc][0]
        taken[texts[doc][1]] += times * len(split_words(texts[doc][0]))
    largest = max(len(split_words(t)) for t, _ in texts.values())
    for source, aim in mix_targets(sizes).items():
        assert abs(taken[source] - aim) <= largest
    frame = spark.createDataFrame([(d, t, la, s, len(t)) for d, t, la, s in cut], schema)
    mixed = Counter(r["doc_id"] for r in source_mix.mix_stage(spark, frame, "").collect())
    assert Counter({d: n for (d, _), n in got.items()}) == mixed
    assert len(cut) < len(rows) and any(spans.values()) and quality_rules.MIN_GROUP > 1


def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
