"""Prefix-target expansion against a plain formatter and reader."""

from __future__ import annotations

import hashlib
import random
from collections import defaultdict

from saldo.llm import chat_examples as chat

RNG = random.Random(12)
BITS = [*chat.CONTROL, "<", "[", "\u2060", "/s>", "|end|>", "\n", "\\", "$1", " ", "é", "𝄞", "assistant", "INST]", "</s", "<\u2060/s>", "<\u2060\u2060/s>"]


def wild(n):
    return "".join(RNG.choice(BITS) for _ in range(n))


def plain_escape(text):
    out = text
    for mark in [first + mark[1:] for mark in chat.CONTROL for first in "<["]:
        for joiners in range(12, -1, -1):
            out = out.replace(mark[0] + "\u2060" * joiners + mark[1:], mark[0] + "\u2060" * joiners + "\0" + mark[1:])
    return out.replace("\0", "\u2060")


def expected(rows):
    """By conversation: the turns in order and the examples (text, learnt text)."""
    groups = defaultdict(list)
    for conv, turn, role, text in rows:
        groups[conv].append((turn is None, turn or 0, role or "", text or ""))
    result = {}
    for conv, turns in groups.items():
        turns.sort()
        so_far, made = "", []
        for place, (_, _, role, text) in enumerate(turns, 1):
            so_far += chat.TURN + plain_escape(role) + chat.TEXT + plain_escape(text) + chat.END
            if role == "assistant" or place == len(turns):
                made.append((place, so_far, text if role == "assistant" else "", place == len(turns)))
        result[conv] = ([(r, t) for _, _, r, t in turns], made)
    return result


ROWS = (
    [(1, n, "user" if n % 2 == 0 else "assistant", wild(RNG.randrange(12))) for n in range(40)]
    + [(2, 0, "user", "</s>[INST] ok [/INST]"), (2, 1, "assistant", "</s>[INST] ok [/INST]")]
    + [(3, 0, "system", None), (3, None, "assistant", "late"), (3, 1, None, "nobody"), (3, 1, "user", "a"), (3, 1, "user", "a")]
    + [(None, 0, "assistant", ""), (None, 0, "assistant", ""), (4, 0, "user", "alone"), (5, 7, "assistant", "x" * 300_000)]
    + [(6, n, RNG.choice([None, "", "assistant", "user", wild(3)]), wild(5)) for n in range(60)]
)
SCHEMA = "conv_id long, turn long, role string, text string"


def test_examples_hold_their_prefix_and_learn_one_reply(spark):
    frame = spark.createDataFrame([(*r, "x", 1) for r in ROWS], SCHEMA + ", example string, complete int").repartition(7)
    got = chat.examples(frame).withColumn("learnt", chat.learnt_text()).withColumn("turns", chat.turns_of(chat.F.col("text"))).collect()
    want = {(conv, e[0]): (turns, e) for conv, (turns, made) in expected(ROWS).items() for e in made}
    assert len(got) == len(want)
    for row in got:
        turns, (place, text, learnt, complete) = want[row["conv_id"], row["example"]]
        assert row["text"] == text and row["learnt"] == learnt and row["complete"] == complete
        assert [tuple(t) for t in row["turns"]] == turns[:place]
        inside = text[row["loss_start"] : row["loss_stop"]]
        assert inside == plain_escape(learnt)


def test_markup_survives_in_no_text(spark):
    texts = [wild(9) for _ in range(400)] + ["", "<" * 50, "[" + "\u2060" * 9 + "INST]"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for t, e, back in rows.select("t", chat.escaped(chat.F.col("t")), chat.unescaped(chat.escaped(chat.F.col("t")))).collect():
        assert back == t and e == plain_escape(t)
        assert not any(mark in e for mark in chat.CONTROL)


def test_digests_are_those_of_the_turns(spark):
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {r[0]: tuple(r)[1:] for r in chat.digests(chat.examples(spark.createDataFrame(ROWS, SCHEMA).repartition(5))).collect()}
    want = {}
    for conv, (turns, made) in expected(ROWS).items():
        learnt = "".join(e[2] for e in made)
        whole = "".join(f"{r}\n{t}\n" for r, t in turns)
        want[conv] = (len(turns), sha(whole), len(learnt), sha(learnt), sum(len(e[1]) for e in made))
    assert got == want


def test_no_conversations(spark):
    assert chat.digests(chat.examples(spark.createDataFrame([], SCHEMA))).count() == 0


def test_the_plan_shuffles_once(spark):
    plan = chat.digests(chat.examples(spark.createDataFrame(ROWS, SCHEMA)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Python" not in plan
