"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are its context, and only its text is trained.
A turn is written as ``<|turn|>role<|text|>text<|end|>`` and a line feed. Control strings inside roles and texts get a
word joiner after their first character, one more if they have some already, so no text can pass for markup and
unescaping gives back each character. A running window over a conversation collects the turns so far; rows keep their
places in it and may be spilled, and examples leave one at a time.

An example states its trained span in code points, ``loss_start`` to ``loss_stop``. The last turn of a conversation always ends an
example, ``complete``, which has the whole conversation; if that turn is not an assistant's, its span is empty.

Defined cases: a null text or role is empty. Turns are ordered by turn, role and text, null turns last; repeated rows are
turns of their own. Rows without a conversation id are one conversation. A conversation without an assistant turn has one
example with an empty span. An empty table gives no examples. Columns other than the four named are left out. A
conversation is one text by nature, so its last example must fit into one value (2 GB).
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from saldo.llm.common import table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: Marks of this template and of usual ones, which no text may hold as they are. Each starts with its only ``<`` or ``[``.
CONTROL = (TURN, TEXT, END.strip(), "<s>", "</s>", "[INST]", "[/INST]", "<SYS>", "</SYS>", "<|im_start|>", "<|im_end|>", "<|endoftext|>")
JOINER = "\u2060"
TRAINED = "assistant"
#: A conversation that the query formats besides the table's: fixed rows.
PLANTED = ((-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]"))


def control_pattern(control: Sequence[str] = CONTROL, least: str = "*") -> str:
    """A regular expression for the control strings, begun by either bracket, with joiners after their first character."""
    tails = "|".join(re.escape(c[1:]) for c in control)
    return rf"([<\[])(\x{{2060}}{least})({tails})"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), control_pattern(), f"$1{JOINER}$2$3")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"([<\[])\x{2060}" + control_pattern()[len(r"([<\[])") :], "$1$2$3")


def examples(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained: str = TRAINED) -> DataFrame:
    """(conv_id, example, text, loss_start, loss_stop, complete): one row for each turn to learn and for the last."""
    rows = turns.select(
        F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text")
    )
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), "role", "text")
    body = escaped(F.col("text"))
    segment = F.concat(F.lit(TURN), escaped(F.col("role")), F.lit(TEXT), body, F.lit(END))
    rows = rows.select("conv_id", "turn", "role", "text", segment.alias("segment"), F.length(body).alias("body"))
    rows = rows.select(
        "conv_id",
        F.row_number().over(order).alias("example"),
        F.collect_list("segment").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)).alias("segments"),
        F.lead(F.lit(True), 1, False).over(order).alias("more"),
        (F.col("role") == trained).alias("learnt"),
        "body",
    )
    rows = rows.filter("learnt or not more").withColumn("text", F.array_join("segments", ""))
    stop = F.length("text") - F.when(F.col("learnt"), len(END)).otherwise(0)
    return rows.select(
        "conv_id",
        "example",
        "text",
        (stop - F.when(F.col("learnt"), F.col("body")).otherwise(0)).alias("loss_start"),
        stop.alias("loss_stop"),
        (~F.col("more")).alias("complete"),
    )


def turns_of(text: Column) -> Column:
    """The turns of an example as an array of (role, text), unescaped."""
    parts = F.split(text, re.escape(END).replace("\\\n", "\n"), -1)

    def parsed(part: Column) -> Column:
        head = F.substring_index(part, TEXT, 1)
        return F.struct(
            unescaped(F.substr(head, F.lit(len(TURN) + 1))).alias("role"),
            unescaped(F.substr(part, F.length(head) + len(TEXT) + 1)).alias("text"),
        )

    return F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), parsed)


def learnt_text(text: str = "text") -> Column:
    """The text under an example's loss mask, unescaped."""
    return unescaped(F.substr(F.col(text), F.col("loss_start") + 1, F.col("loss_stop") - F.col("loss_start")))


def digests(rows: DataFrame) -> DataFrame:
    """One row for each conversation, read back from its examples: turns from the complete one, learnt texts from each."""
    read = rows.select(
        "conv_id",
        F.when(F.col("complete"), turns_of(F.col("text"))).alias("turns"),
        F.struct("example", learnt_text().alias("learnt")).alias("part"),
        F.length("text").cast("bigint").alias("chars"),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = read.select(
        "conv_id", F.size("turns").alias("n"), F.sha2(F.array_join(lines, ""), 256).alias("digest"), F.col("turns").isNotNull().alias("whole"), "part", "chars"
    )
    found = read.groupBy("conv_id").agg(
        F.max(F.when(F.col("whole"), F.col("n"))).cast("bigint").alias("n_turns"),
        F.max("digest").alias("turns_sha256"),
        F.array_join(F.transform(F.array_sort(F.collect_list("part")), lambda p: p["learnt"]), "").alias("learnt"),
        F.sum("chars").alias("formatted_chars"),
    )
    return found.select(
        "conv_id",
        "n_turns",
        "turns_sha256",
        F.length("learnt").cast("bigint").alias("loss_chars"),
        F.sha2("learnt", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op12_chat_examples(spark: SparkSession, directory: str) -> DataFrame:
    """Every conversation formatted as prefix and target, and what reading the examples back gives."""
    names = ["conv_id", "turn", "role", "text"]
    planted = spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, row, strict=True)]) for row in PLANTED])))
    return digests(examples(table(spark, directory, "conversations").select(names).unionByName(planted)))


def _sql_escaped(column: str) -> str:
    return f"regexp_replace({column}, '{control_pattern()}', '\\1{JOINER}\\2\\3', 'g')"


SQL = f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values {", ".join(str(row) for row in PLANTED)}),
placed as (
  select *, {len(TURN + TEXT + END)} + length({_sql_escaped("role")}) + length({_sql_escaped("text")}) as chars,
    row_number() over w as place, count(*) over (partition by conv_id) as n
  from turns window w as (partition by conv_id order by turn nulls last, role, text)),
prefixes as (select *, sum(chars) over (partition by conv_id order by place) as so_far from placed)
select conv_id, count(*) as n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' order by place)) as turns_sha256,
  cast(coalesce(sum(length(text)) filter (role = '{TRAINED}'), 0) as bigint) as loss_chars,
  sha256(coalesce(string_agg(text, '' order by place) filter (role = '{TRAINED}'), '')) as loss_sha256,
  cast(sum(so_far) filter (role = '{TRAINED}' or place = n) as bigint) as formatted_chars
from prefixes group by conv_id"""
