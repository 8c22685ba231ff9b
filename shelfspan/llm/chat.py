"""Chat formatting by event-sourced reconstruction (DataFrame functions only).

A conversation is a log of events. Sorted by sequence number, they fold into final messages: `message` and
`regenerate` start a turn's text anew, `edit` replaces it, `delta` appends to it. The messages are rendered
with a template that marks turns and escapes its control strings inside texts, so that what was rendered can
be read back exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from shelfspan.llm.common import table

#: Marks of a turn.
START, END = "<|im_start|>", "<|im_end|>"
#: Control strings of this and other common templates, split after the first character.
CONTROL = r"([<\[])(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\])"
CONTROL_ESCAPED = r"([<\[])\\(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\])"
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    """A backslash more after the first character of each control string; `unescape` takes it away again."""
    return F.regexp_replace(text, CONTROL, r"$1\\$2$3")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, CONTROL_ESCAPED, "$1$2$3")


def escape_role(role: Column) -> Column:
    """Besides, a role has no line break: `%` and the break become `%25` and `%0A`."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def fold(events: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text): final messages from events (conv_id, seq, turn, kind, role, text).

    An event that is delivered twice (equal in all six columns) is applied once. Events with equal seq are
    applied by kind, then text. A null text is empty, a null kind counts as `message`; the role is the latest
    that isn't null, or empty. Null conv_id, turn or seq are values of their own that sort first. A turn whose
    log starts with deltas begins empty. Rows meet by conversation and turn, so a hot conversation is spread.
    """
    kind = F.coalesce("kind", F.lit("message"))
    e = events.select("conv_id", "turn", "seq", kind.alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text")).distinct()
    per_turn = e.groupBy("conv_id", "turn").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("seq", F.lit(-(2**63))).alias("seq"), "kind", "text", "role"))).alias("log"))
    # The text is what follows the last event that starts it anew; each event's place in the sorted log is its index.
    starts = F.array_max(F.transform("log", lambda x, i: F.when(x["kind"] != "delta", i).otherwise(0)))
    roles = F.filter(F.transform("log", lambda x: x["role"]), lambda r: r.isNotNull())
    return per_turn.select(
        "conv_id",
        "turn",
        F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"),
        F.array_join(F.transform(F.slice("log", starts + 1, F.size("log")), lambda x: x["text"]), "").alias("text"),
    )


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, n_turns, formatted, loss_spans): each conversation as one text.

    `loss_spans` has (n, start, end) of the texts of assistant turns: the turn's place, from 1, and where its
    text is in `formatted`, in code points: the loss mask. A conversation's text is one value of one row, as the format asks; what is sent to its task is the
    rendered turns. Turns that tie are ordered by role and text.
    """
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    body = escape(F.col("text"))
    parts = messages.select("conv_id", "turn", "role", "text", head.alias("head"), body.alias("body"))
    parts = parts.withColumn("segment", F.concat("head", "body", F.lit(END + "\n")))
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = parts.withColumn("end", F.sum(F.char_length("segment").cast("long")).over(order)).withColumn("n", F.count(F.lit(1)).over(order))
    start = F.col("end") - F.char_length("segment") + F.char_length("head")
    span = F.when(F.col("role") == LOSS_ROLE, F.struct("n", start.alias("start"), (start + F.char_length("body")).alias("end")))
    return (
        placed.select("conv_id", F.struct("n", "segment", span.alias("span")).alias("part"))
        .groupBy("conv_id")
        .agg(F.array_sort(F.collect_list("part")).alias("parts"))
        .select(
            "conv_id",
            F.size("parts").cast("long").alias("n_turns"),
            F.array_join("parts.segment", "").alias("formatted"),
            F.filter("parts.span", lambda x: x.isNotNull()).alias("loss_spans"),
        )
    )


def read_back(formatted: Column) -> Column:
    """array<struct<role, text>>: the messages of a rendered conversation."""
    parts = F.split(formatted, r"<\|im_end\|>\n", -1)
    return F.transform(
        F.slice(parts, 1, F.size(parts) - 1),
        lambda p: F.struct(
            unescape_role(F.substring_index(F.substr(p, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
            unescape(F.substr(p, F.locate("\n", p) + 1)).alias("text"),
        ),
    )


def under_mask(formatted: Column, loss_spans: Column) -> Column:
    """array<string>: what the loss mask covers, unescaped. A span's turn is split off first, so that long conversations aren't searched once a span."""
    parts = F.split(formatted, r"<\|im_end\|>\n", -1)
    return F.transform(loss_spans, lambda s: unescape(F.right(F.get(parts, s["n"].cast("int") - 1), s["end"] - s["start"])))


def log_of(rows: DataFrame) -> DataFrame:
    """A log (conv_id, seq, turn, kind, role, text) that ends in the given rows (conv_id, turn, role, text), one message each.

    Assistant texts are streamed: a draft, a regeneration that discards it, and the text in two deltas. Other
    texts are sent without their last character and edited. Rows that tie on a turn are messages of their own,
    in the order of role and text, repeated rows too.
    """
    tied = Window.partitionBy("conv_id", "turn").orderBy("role", "text")
    half = F.floor(F.char_length("text") / 2).cast("int")
    cut = lambda a, b: F.substr("text", a, b)
    event = lambda k, kind, text: F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), text.alias("text"))
    streamed = F.array(event(0, "message", F.reverse("text")), event(1, "regenerate", F.lit("")), event(2, "delta", cut(F.lit(1), half)), event(3, "delta", cut(half + 1, F.char_length("text"))))
    edited = F.array(event(0, "message", cut(F.lit(1), F.char_length("text") - 1)), event(1, "edit", F.col("text")))
    e = rows.withColumn("tie", F.row_number().over(tied)).select("*", F.explode(F.when(F.col("role") == LOSS_ROLE, streamed).otherwise(edited)).alias("e"))
    return e.select("conv_id", (F.coalesce("turn", F.lit(-1)) * 4 + F.col("e.k")).alias("seq"), F.struct("turn", "tie").alias("turn"), "e.kind", "role", "e.text")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    said = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    read = render(fold(log_of(rows.unionByName(extra)))).select("*", read_back(F.col("formatted")).alias("turns"))
    loss = F.array_join(under_mask(F.col("formatted"), F.col("loss_spans")), "")
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), "turns", loss.alias("loss"), "formatted").select(
        "conv_id",
        "n_turns",
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP4_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
parts AS (
  SELECT conv_id, turn, role, text,
         '<|im_start|>' || regexp_replace(replace(replace(role, '%', '%25'), chr(10), '%0A'), p, '\1\\\2\3', 'g') || chr(10)
         || regexp_replace(text, p, '\1\\\2\3', 'g') || '<|im_end|>' || chr(10) AS segment
  FROM rows, (SELECT '([<\[])(\\*)(\|im_start\|>|\|im_end\|>|\|endoftext\|>|s>|/s>|<SYS>>|</SYS>>|INST\]|/INST\])' AS p))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(segment)) AS BIGINT) AS formatted_chars
FROM parts GROUP BY conv_id
"""
