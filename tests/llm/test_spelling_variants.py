"""Spelling variants against all pairs of a small vocabulary."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import pytest

from saldo.llm import spelling_variants as spelling

RNG = random.Random(11)


def plain_counts(rows, least_length=6, least_count=5, drop_every=199):
    counts = Counter()
    for doc, text in rows:
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[A-Za-zÀ-ÿ]+", lower):
            h = zlib.crc32(f"{'null' if doc is None else doc}:{run}".encode())
            if drop_every and h % drop_every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    return {w: n for w, n in counts.items() if n >= least_count and len(w) >= least_length}


def one_edit(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    if abs(len(a) - len(b)) != 1:
        return False
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def plain_variants(counts, ratio=5):
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * counts[w] else None
    rows = set()
    for w in counts:
        root = w
        while form[root]:
            root = form[root]
        rows.add((w, form[w], root, counts[w], len(near[w]), counts[form[w]] if form[w] else None))
    return rows


def vocabulary():
    words = {"aaaaaa", "aaaaaaa", "aaaaaaaa", "ababab", "bababa", "abababa", "x" * 199, "x" * 200, "x" * 201, "x" * 200 + "y", "é" * 6}
    while len(words) < 350:
        base = RNG.choice(sorted(words)) if RNG.random() < 0.8 else "".join(RNG.choice("abéÿ") for _ in range(RNG.randrange(6, 9)))
        at, letter = RNG.randrange(len(base) + 1), RNG.choice("abz×")
        words.add(RNG.choice([base[:at] + letter + base[at:], base[:at] + letter + base[at + 1 :], base[:at] + base[at + 1 :]]))
    return {w: RNG.choice([5, 5, 6, 25, 30, 125, 150, 700, 3500]) for w in words if w}


def test_variants_are_those_of_all_pairs(spark):
    counts = vocabulary()
    frame = spark.createDataFrame(list(counts.items()), "word string, n long").repartition(6)
    got = {tuple(r) for r in spelling.variants(frame).collect()}
    assert got == plain_variants(counts)
    assert any(r[1] and r[2] != r[1] for r in got)


@pytest.mark.parametrize("held", [spelling.HELD, 3])
def test_words_are_counted_and_misspelt(spark, monkeypatch, held):
    monkeypatch.setattr(spelling, "HELD", held)
    monkeypatch.setattr(spelling, "PIECE", 4000)
    words = ["spélling", "SPELLING", "ÉcoleÉcole", "short", "variants", "a×b÷cdef", "İstanbul", "wȯrdwords"]
    rows = [(n, " ".join(RNG.choice(words) for _ in range(RNG.randrange(60)))) for n in range(300)]
    rows += [(None, "spelling variants" * 3), (1, None), (2, ""), (3, "variants,variants;VARIANTS-x1y " * 2000), (rows[7]), (rows[7])]
    frame = spark.createDataFrame([(*r, "w", 1) for r in rows], "doc_id long, text string, word string, n int").repartition(3)
    got = {r["word"]: r["n"] for r in spelling.word_counts(frame, drop_every=199).collect()}
    assert got == plain_counts(rows)
    plain = {r["word"]: r["n"] for r in spelling.word_counts(frame, least_length=1, least_count=1).collect()}
    assert plain == plain_counts(rows, 1, 1, None)


def test_the_query_is_the_brute_force_of_its_table(spark, tmp_path):
    words = ["".join(RNG.choice("abcde") for _ in range(6)) for _ in range(60)]
    rows = [(n, " ".join(RNG.choice(words[: RNG.randrange(1, 60)]) for _ in range(200))) for n in range(150)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {tuple(r) for r in spelling.op11_spelling_variants(spark, str(tmp_path)).collect()}
    assert got == plain_variants(plain_counts(rows)) and len(got) > 50


def test_no_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.variants(spelling.word_counts(empty)).count() == 0
