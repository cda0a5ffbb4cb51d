"""Collocations against plain counting of every phrase."""

from __future__ import annotations

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pytest

from saldo.llm import collocations as coll

RNG = random.Random(13)
WORDS = ["new", "york", "city", "of", "the", "a", "a\x01", "a\x00", "a!b", "é", "ÀB", "𝄞", "\xa0", "\x1c", "Los", "ANGELES", "x" * 300]


def plain_counts(rows):
    counts, totals = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\n\x0b\x0c\r]", lower):
            words = re.findall(r"[^ \t]+", piece)
            totals[lang] += len(words)
            for m in (1, 2, 3):
                counts.update((lang, tuple(words[i : i + m])) for i in range(len(words) - m + 1))
    return counts, totals


def plain_collocations(rows, least=10, percent=50, top=2000):
    counts, totals = plain_counts(rows)
    candidates = {k: a for k, a in counts.items() if len(k[1]) > 1 and a >= least}
    result = set()
    for lang in totals:
        scored = []
        for (of, words), a in candidates.items():
            if of != lang:
                continue
            cuts = [(counts[lang, words[:k]], counts[lang, words[k:]], k) for k in range(1, len(words))]
            score, _, left, right = min((1_000_000 * a * a // (x * y), k, x, y) for x, y, k in cuts)
            inside = (
                100 * f >= percent * a and any(other[i : i + len(words)] == words for i in range(len(other) - len(words) + 1))
                for (by, other), f in candidates.items()
                if by == lang and len(other) > len(words)
            )
            if not any(inside):
                scored.append((-score, -a, " ".join(words).encode(), left, right))
        for rank, (score, a, phrase, left, right) in enumerate(sorted(scored)[:top], 1):
            result.add((lang, rank, phrase.decode(), -a, left, right, totals[lang], -score))
    return result


def texts(n, longest=60):
    made = []
    for _ in range(n):
        body = ""
        for _ in range(RNG.randrange(longest)):
            body += RNG.choice(["new york city", "los angeles", RNG.choice(WORDS), RNG.choice(WORDS)]) + RNG.choice([" ", " ", " ", "\t ", ". ", "\n", ",", ";x!"])
        made.append((body, RNG.choice(["en", "en", "en", "fr", "", None, "und"])))
    return made


ROWS = texts(300) + [(None, "en"), ("", "fr"), ("...", None), ("new york city " * 3000, "en"), ("one two " * 30, "de")]
SCHEMA = "text string, lang string"


@pytest.mark.parametrize(("held", "burst", "block", "merged"), [(coll.HELD, coll.BURST, coll.BLOCK, coll.MERGED), (40, 5, 3, 7)])
def test_counts_are_exact_with_and_without_spills(spark, monkeypatch, held, burst, block, merged):
    if held == 40:
        monkeypatch.setattr(coll, "SLICE", 50)
        monkeypatch.setattr(coll, "TOKENS", 20)
        monkeypatch.setattr(coll, "VOCABULARY", 9)
    frame = spark.createDataFrame([(*r, "p", 3) for r in ROWS], SCHEMA + ", phrase string, n int").repartition(3)
    rows = coll.phrase_counts(frame, held=held, burst=burst, block=block, merged=merged, least_count=2).collect()
    counts, totals = plain_counts(ROWS)
    got = Counter({(r["lang"], r["phrase"]): r["f"] for r in rows if r["phrase"] is not None})
    assert got == Counter({(lang, " ".join(w)): f for (lang, w), f in counts.items() if f >= 2})
    assert all(len(r["phrase"].split(" ")) == r["words"] for r in rows if r["phrase"] is not None)
    sums = Counter()
    for r in rows:
        if r["phrase"] is None:
            sums[r["lang"]] += r["f"]
    assert sums == totals


@pytest.mark.parametrize("top", [2000, 5])
def test_collocations_are_those_of_plain_counting(spark, top):
    got = {tuple(r) for r in coll.collocations(coll.phrase_counts(spark.createDataFrame(ROWS, SCHEMA).repartition(5)), top=top).collect()}
    want = plain_collocations(ROWS, top=top)
    assert got == want and len(want) > 10


def test_scores_pass_64_bits(spark):
    big = 10**13
    rows = [("en", None, 0, 10 * big), ("en", "a", 1, 3 * big + 1), ("en", "b", 1, 2 * big + 7), ("en", "a b", 2, big + 3)]
    got = coll.collocations(spark.createDataFrame(rows, coll.COUNTS)).first()
    assert got["score"] == 1_000_000 * (big + 3) ** 2 // ((3 * big + 1) * (2 * big + 7))


def test_a_trie_bursts_and_spills_whole_subtrees():
    trie, want = coll.HatTrie(burst=4), Counter()
    for _ in range(50):
        codes = np.unique(np.array([RNG.choice([1, 2, 300]) << 42 | RNG.randrange(5) << 21 | RNG.randrange(5) for _ in range(20)], np.int64))
        trie.add("x", codes, np.ones(len(codes), np.int64))
        want.update(codes.tolist())
    assert trie.size == len(want) and any(type(v) is coll.Burst for v in trie.roots["x"].values())
    some = [(c, n) for _, codes, counts in trie.taken(30) for c, n in zip(codes.tolist(), counts.tolist(), strict=True)]
    assert some and trie.size <= 30 and {c >> 50 for c, _ in some}.isdisjoint(trie.roots["x"])
    rest = [(c, n) for _, codes, counts in trie.taken(0) for c, n in zip(codes.tolist(), counts.tolist(), strict=True)]
    assert sorted(some + rest) == sorted(want.items()) and trie.size == 0


def test_no_documents(spark):
    assert coll.collocations(coll.phrase_counts(spark.createDataFrame([], SCHEMA))).count() == 0


def test_a_full_trie_leaves_room_for_the_other_tasks_of_an_executor():
    codes = np.arange(coll.HELD, dtype=np.int64) << (coll.BITS // 2)
    tracemalloc.start()
    trie = coll.HatTrie()
    trie.add("en", codes, np.full(len(codes), 1000))
    held = tracemalloc.get_traced_memory()[0]
    tracemalloc.stop()
    assert trie.size == coll.HELD and held < 128 << 20
