"""URL filters, WARC, quality rules and mixing: operators of DataFrame functions only."""

from __future__ import annotations

import hashlib
import base64
import random
import re
import uuid
from collections import Counter, defaultdict

import pytest

from saldo.llm import quality_rules, source_mix, url_filters, warc_store
from saldo.llm.common import new_path

RNG = random.Random(5)


def split_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# --- URL filters


def reference_verdict(url, listed):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1].split("#")[0].split("?")[0]
        host, slash, tail = rest.partition("/")
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
        path = slash + tail
    fits = [
        (h + p, v) for h, p, v in url_filters.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)
    ]
    if fits:
        rule, verdict = max(fits, key=lambda f: len(f[0]))
        return host, path, rule, verdict
    return host, path, None, "block" if host in listed else "allow"


URLS = [
    None,
    "",
    "no scheme",
    "http://",
    "HTTP://EXAMPLE.ORG/es/x?y#z",
    "http://a.example.org/en/1",
    "http://a.example.org/en/2",
    "http://example.org",
    "http://x.com/fr/1",
    "http://x.com/fr",
    "http://com/de/",
    "http://notcom/de/",
    "https://bad.net/a?b=://c",
    "https://bad.net#f",
    "https://good.net/\nline",
    "https://ÄÖ.net/ü",
    "https://bad.net/" + "a" * 100_000,
]


@pytest.mark.parametrize("max_bytes", [1 << 20, 9])
def test_urls_are_judged_as_by_a_set(spark, max_bytes):
    hosts = [f"h{n}.net" for n in range(400)] + ["bad.net"]
    listed = [h for n, h in enumerate(hosts) if n % 3 == 0] + ["bad.net", None, "never.net"]
    urls = URLS + [f"http://{h}/p" for h in hosts] * 2
    pages = spark.createDataFrame([(n, u, "mine", "kept") for n, u in enumerate(urls)], "page_id long, url string, host string, other string")
    universe = spark.createDataFrame([(reference_verdict(u, ())[0],) for u in urls] + [(None,)], "key string")
    # two bits a key make false positives, and so a cascade of several levels
    cascade = url_filters.build_cascade(spark.createDataFrame([(x,) for x in listed], "k string"), universe, 2.0, max_bytes)
    assert len(cascade.shards) == (1 if max_bytes > 100 else 4)
    rows = url_filters.judge(pages, cascade).collect()
    assert len(rows) == len(urls)
    for row in rows:
        assert (row["host"], row["path"], row["rule"], row["verdict"]) == reference_verdict(row["url"], set(listed))
        assert row["other"] == "kept"


def test_no_urls_and_no_list(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    none = url_filters.build_cascade(empty.select("url"), empty.select("url"))
    assert url_filters.judge(empty, none).count() == 0
    one = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert url_filters.judge(one, none).first()["verdict"] == "allow"


def test_membership_is_exact_when_the_filter_is_full(spark):
    keys = [f"key {n}" for n in range(60_000)]
    listed = set(RNG.sample(keys, 30_000))
    cascade = url_filters.build_cascade(
        spark.createDataFrame([(k,) for k in listed], "key string"), spark.createDataFrame([(k,) for k in keys], "key string"), 2.0
    )
    assert len(cascade.shards[0]) > 3
    flagged = cascade.flag(spark.createDataFrame([(k,) for k in keys], "key string"), "key", "in")
    assert {r["key"] for r in flagged.filter("in").collect()} == listed


# --- WARC


def records(rows, least):
    groups = defaultdict(list)
    for page, _, body in rows:
        groups[body or ""].append(page)
    for page, _, body in rows:
        data = (body or "").encode()
        ids = [p for p in groups[body or ""] if p is not None]
        newest = max(ids) if ids else None
        response = page == newest or len(data) < least
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        yield page, len(data), digest, "response" if response else "revisit", None if response else newest


PAGES = [
    (1, "http://a/", "<p>same</p>"),
    (2, None, "<p>same</p>"),
    (3, "http://c/\r\nWARC-Type: x", "<p>same</p>"),
    (4, "", None),
    (5, "u v", ""),
    (5, "u v", ""),
    (6, "ü", "größe 😀\r\n\r\nWARC/1.1\r\n"),
    (None, "n", "<p>same</p>"),
    (7, "long", "x" * 300_000),
]


@pytest.mark.parametrize("least", [0, 20])
def test_archive_round_trip(spark, least):
    path = new_path(spark, "test-warc")
    pages = spark.createDataFrame([(*r, "extra") for r in PAGES], "page_id long, url string, html string, header string")
    warc_store.write_archive(pages, path, min_bytes=least)
    rows = warc_store.read_archive(spark, path).collect()
    names = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert Counter(tuple(r[n] for n in names) for r in rows) == Counter(records(PAGES, least))
    bodies = {(p, (b or "").encode()) for p, _, b in PAGES}
    assert {(r["page_id"], bytes(r["payload"])) for r in rows} == bodies
    for row in rows:
        head, _, block = bytes(row["record"]).partition(b"\r\n\r\n")
        fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
        assert fields["WARC-Type"] == row["record_type"]
        uuid.UUID(fields["WARC-Record-ID"][10:-1])
        body = bytes(row["payload"]) if row["record_type"] == "response" else b""
        assert block == body + b"\r\n\r\n" and int(fields["Content-Length"]) == len(body)
    kept = spark.read.parquet(f"{path}/payloads")
    assert kept.count() == len({b for _, b in bodies})


def test_damaged_and_empty_archives(spark):
    path = new_path(spark, "test-warc")
    warc_store.write_archive(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert warc_store.read_archive(spark, path).count() == 0
    path = new_path(spark, "test-warc")
    warc_store.write_archive(spark.createDataFrame(PAGES, "page_id long, url string, html string"), path)
    spark.createDataFrame([(hashlib.sha256(b"other").digest(), b"<p>same</p>")], "address binary, payload binary").write.mode("append").parquet(f"{path}/payloads")
    bad = spark.createDataFrame([("WARC/1.1\r\nPage-ID: 9\r\n\r\n", hashlib.sha256(b"other").digest())], "header string, address binary")
    bad.write.mode("append").parquet(f"{path}/headers")
    with pytest.raises(Exception, match="differs"):
        warc_store.read_archive(spark, path).select("payload_bytes").collect()


# --- quality rules


def base_measures(text):
    words = split_words(text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    lines = [line for line in (text or "").split("\n") if split_words(line)]
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(covered), len(lines)


def bucket(value):
    cut = max(0, value.bit_length() - quality_rules.SKETCH_BITS)
    return value >> cut << cut


def verdicts(rows):
    """(base measures, base_failed, kept) of every (lang, source, text)."""
    measured = []
    for lang, source, text in rows:
        n, chars, symbols, dup, rep, lines = base_measures(text)
        failed = n < 50 or 100 * rep > 50 * n
        share = [1000 * chars // n if n else 0, 1000 * symbols // n if n else 0]
        share += [1000 * dup // lines if lines else 0, 1000 * rep // n if n else 0]
        measured.append(((n, chars, symbols, dup, rep), failed, share, lang, source))
    sketches = defaultdict(list)
    for _, failed, share, lang, source in measured:
        if not failed:
            for group in ((lang, source), (lang,), ()):
                sketches[group].append([bucket(s) for s in share])
    for base, failed, share, lang, source in measured:
        group = next(g for g in ((lang, source), (lang,), ()) if g == () or len(sketches[g]) >= quality_rules.MIN_GROUP)
        out = False
        for i, (_, least, lower) in enumerate(quality_rules.MEASURES):
            values = sorted(s[i] for s in sketches[group])
            if not values:
                continue
            q1, q3 = (next(v for n, v in enumerate(values, 1) if 4 * n >= k * len(values)) for k in (1, 3))
            reach = quality_rules.REACH * max(q3 - q1, least)
            out |= share[i] > q3 + reach or lower and share[i] < q1 - reach
        yield base, failed, not failed and not out


def prose(count, vocabulary=400, length=6):
    return " ".join("".join(RNG.choice("aeiounrst") for _ in range(RNG.randint(2, length))) for _ in range(count))


def quality_rows():
    rows = [("en", RNG.choice("ab"), prose(RNG.randint(40, 200))) for _ in range(150)]
    rows += [("en", "a", re.sub(" ", "### ", prose(120))), ("en", "a", prose(80, length=30)), ("de", None, "x " * 100)]
    rows += [(None, None, None), ("en", None, ""), ("en", "b", " \n\t"), (None, "b", prose(60) + "\x0b\x0c\r\n" + prose(3))]
    line = prose(12)
    rows += [("en", "a", "\n".join([line] * 3 + [prose(40), line, "", " ", " "])), ("en", "a", prose(30_000))]
    rows += [("en", "b", "é😀 " * 10 + prose(60))] + [rows[0]] * 3
    return rows


def test_quality_measures_and_fences(spark):
    rows = quality_rows()
    docs = spark.createDataFrame([(n, t, la, s, "own", "other") for n, (la, s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, n_words string, measure string")
    got = quality_rules.judged(docs).orderBy("doc_id").collect()
    want = list(verdicts(rows))
    assert [(tuple(r[c] for c in quality_rules.BASE), r["base_failed"], r["kept"]) for r in got] == want
    assert any(not k and not f for _, f, k in want) and got[0]["measure"] == "other"
    stage = quality_rules.quality_stage(spark, docs, "")
    assert stage.columns == docs.columns and {r["n_words"] for r in stage.collect()} == {"own"}
    assert sorted(r["doc_id"] for r in stage.collect()) == [n for n, w in enumerate(want) if w[2]]


def test_quality_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string")
    assert quality_rules.judged(empty).count() == 0
    short = spark.createDataFrame([(1, None, None, None)], empty.schema)
    assert quality_rules.judged(short).first()["base_failed"]


# --- mixing


def mix_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: source_mix.WEIGHTS[n % 3] for n, s in enumerate(names)}
    total, full, share = sum(sizes.values()), set(), {}
    while True:
        rest = [s for s in names if s not in full]
        left = total - sum(3 * sizes[s] for s in full)
        if not rest:
            break
        share = {s: left * weight[s] / sum(weight[r] for r in rest) for s in rest}
        over = {s for s in rest if share[s] > 3 * sizes[s]}
        if not over:
            break
        full |= over
    return {s: 3 * sizes[s] if s in full else share.get(s, 0) for s in names}


def mix_rows():
    rows = [(n, prose(RNG.randint(0, 60)), RNG.choice(["b", "a", "é", None, "Z"])) for n in range(600)]
    rows += [(600 + n, "same text " * 30, "hot") for n in range(300)] + [(1000, None, "empty"), (1001, "", "empty")]
    return rows + [(None, "no id", "a"), (2000, prose(5), "tiny"), (3, "twice", "a"), (3, "twice", "a")]


def test_mix_reaches_its_targets(spark):
    rows = mix_rows()
    docs = spark.createDataFrame([(*r, "own") for r in rows], "doc_id long, text string, source string, size string")
    got = source_mix.mixed(docs).collect()
    sizes, largest, taken = Counter(), Counter(), Counter()
    for _, text, source in rows:
        n = len(split_words(text))
        sizes[source] += n
        largest[source] = max(largest[source], n)
    aims = mix_targets(sizes)
    assert len(got) == len(rows) and set(docs.columns) < set(got[0].asDict())
    for row in got:
        assert row["size"] == len(split_words(row["text"])) and row["source_size"] == sizes[row["source"]]
        assert row["target"] == pytest.approx(aims[row["source"]])
        assert row["taken"] <= 3 * row["size"] and (row["size"] == 0 or row["taken"] % row["size"] == 0)
        taken[row["source"]] += row["taken"]
    assert any(a == 3 * sizes[s] > 0 for s, a in aims.items())
    for source, aim in aims.items():
        assert abs(taken[source] - aim) <= largest[source]
    again = source_mix.mixed(docs.repartition(7)).collect()
    assert sorted(map(repr, got)) == sorted(map(repr, again))


def test_mix_stage_repeats_rows_as_taken(spark):
    docs = spark.createDataFrame([(*r, "own") for r in mix_rows()], "doc_id long, text string, source string, size string")
    takes = Counter()
    for row in source_mix.mixed(docs.drop("size")).collect():
        if row["taken"]:
            takes[row["doc_id"], row["text"]] += row["taken"] // row["size"]
    staged = source_mix.mix_stage(spark, docs, "")
    assert staged.columns == docs.columns
    assert Counter((r["doc_id"], r["text"]) for r in staged.collect() if split_words(r["text"])) == takes


def test_mix_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string, source string")
    assert source_mix.mixed(empty).count() == 0
    blank = spark.createDataFrame([(1, None, None), (2, " ", "a")], empty.schema)
    assert [(r["taken"], r["target"]) for r in source_mix.mixed(blank).collect()] == [(0, 0.0)] * 2
