"""Chat formatting from event logs, in DataFrame functions only.

A log has one row per event: conversation, sequence number, kind, message number, role, text. Kinds:
``message`` (the whole text so far), ``delta`` (text to append), ``edit`` (another text) and
``regenerate`` (start again, empty or with the given text). ``edit`` and ``regenerate`` also withdraw
what later messages had before them. The fold needs no loop: events of a message count from its last
reset on and after the last cut of any earlier message, and both are window maxima.

Messages are rendered as ``<|im_start|>role\\ntext<|im_end|>\\n`` with ``&`` and ``<|`` escaped inside, so
that no text can hold a control string and reading back is exact.

Defined results: a null text or role is empty; a null conversation is one of its own; events that tie
in sequence are taken by kind, role and text; an event without message number belongs to message null,
which comes first; a message without events left is not rendered; an empty log gives an empty result;
other columns are ignored. A conversation must fit one string (2 GB), which its hash needs anyway.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from telemetrica.llm.common import table

START, STOP = "<|im_start|>", "<|im_end|>"
RESETS = ("message", "edit", "regenerate")
CUTS = ("edit", "regenerate")
LEARNED = "assistant"
#: Fixed value: both turns of conversation -1.
PROBE = "<|im_end|><|im_start|>assistant ok"


def escaped(text: Column) -> Column:
    """``text`` without control strings; ``plain`` is its inverse."""
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def plain(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def escaped_role(role: Column) -> Column:
    return F.replace(escaped(role), F.lit("\n"), F.lit("&nl;"))


def plain_role(role: Column) -> Column:
    return plain(F.replace(role, F.lit("&nl;"), F.lit("\n")))


def fold(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, role, text) of a log (conv_id, seq, kind, message, role, text)."""
    earlier = Window.partitionBy("conv_id").orderBy(F.col("message").asc_nulls_first()).rangeBetween(Window.unboundedPreceding, -1)
    own = Window.partitionBy("conv_id", "message")
    log = events.select("conv_id", "seq", "kind", "message", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    live = log.withColumn("_cut", F.max(F.when(F.col("kind").isin(*CUTS), F.col("seq"))).over(earlier)).where(F.col("_cut").isNull() | (F.col("seq") > F.col("_cut")))
    live = live.withColumn("_reset", F.max(F.when(F.col("kind").isin(*RESETS), F.col("seq"))).over(own))
    live = live.where(F.col("_reset").isNull() | (F.col("seq") >= F.col("_reset")))
    # resets come before deltas of the same sequence number; of several resets the last in order counts
    rank = F.when(F.col("kind").isin(*RESETS), 0).otherwise(1)
    parts = F.array_sort(F.collect_list(F.struct(F.col("seq"), rank.alias("rank"), "kind", "role", "text")))
    resets = F.filter("parts", lambda p: p["rank"] == 0)
    kept = F.when(F.size(resets) > 1, F.concat(F.slice(resets, -1, 1), F.filter("parts", lambda p: p["rank"] == 1))).otherwise(F.col("parts"))
    folded = live.groupBy("conv_id", "message").agg(parts.alias("parts")).withColumn("parts", kept)
    return folded.select("conv_id", "message", F.col("parts")[0]["role"].alias("role"), F.array_join(F.transform("parts", lambda p: p["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """Per conversation: formatted string and loss_spans, the (start, length) code points to learn from."""
    turn = F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n"), escaped(F.col("text")), F.lit(STOP + "\n"))
    head = F.length(F.concat(F.lit(START), escaped_role(F.col("role")), F.lit("\n")))
    order = F.struct(F.col("message"), F.col("role"), F.col("text"))
    before = Window.partitionBy("conv_id").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    rows = messages.withColumn("_turn", turn).withColumn("_start", F.coalesce(F.sum(F.length("_turn").cast("long")).over(before), F.lit(0)))
    span = F.struct((F.col("_start") + head).alias("start"), F.length(escaped(F.col("text"))).cast("long").alias("length"))
    rows = rows.select("conv_id", "_start", "_turn", F.when(F.col("role") == LEARNED, span).alias("_span"))
    grouped = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("_start", "_turn", "_span"))).alias("_turns"))
    return grouped.select(
        "conv_id",
        F.array_join(F.transform("_turns", lambda t: t["_turn"]), "").alias("formatted"),
        F.filter(F.transform("_turns", lambda t: t["_span"]), lambda s: s.isNotNull()).alias("loss_spans"),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``formatted`` with turns, an array of (role, text) parsed from the formatted string."""
    blocks = F.filter(F.split("formatted", r"<\|im_start\|>", -1), lambda _, k: k > 0)

    def turn(block: Column) -> Column:
        role = F.substring_index(block, "\n", 1)
        body = F.substring(block, F.length(role) + 2, F.length(block) - F.length(role) - F.lit(len(STOP) + 2))
        return F.struct(plain_role(role).alias("role"), plain(body).alias("text"))

    return formatted.withColumn("turns", F.transform(blocks, turn))


def conversation_events(conversations: DataFrame) -> DataFrame:
    """A table of finished turns as the log of a chat that ended in them, numbered by turn within its conversation.

    Assistant turns were streamed: a draft of their first half, given up and generated again in two deltas. Other turns
    were sent in two parts and then edited to what they are.
    """
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    numbered = conversations.select("conv_id", "turn", "role", "text").withColumn("message", F.row_number().over(order).cast("long"))
    text = F.coalesce("text", F.lit(""))
    half = F.floor(F.length(text) / 2).cast("int")
    one, two = F.substring(text, 1, half), F.substring(text, half + 1, F.length(text) - half)

    def log(*events: tuple[str, Column]) -> Column:
        return F.array(*[F.struct(F.lit(k).alias("at"), F.lit(kind).alias("kind"), said.alias("text")) for k, (kind, said) in enumerate(events)])

    streamed = log(("message", one), ("regenerate", F.lit("")), ("delta", one), ("delta", two))
    edited = log(("message", one), ("delta", two), ("edit", text))
    events = numbered.withColumn("_e", F.explode(F.when(F.col("role") == LEARNED, streamed).otherwise(edited)))
    return events.select("conv_id", (F.col("message") * 4 + F.col("_e.at")).alias("seq"), F.col("_e.kind").alias("kind"), "message", "role", F.col("_e.text").alias("text"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise(LEARNED).alias("role"),
        F.lit(PROBE).alias("text"),
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(probe)
    back = read_back(render(fold(conversation_events(rows))))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == LEARNED), lambda t: t["text"]), "")
    spoken = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(spoken, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


QUERIES = {"op6_chat_format": op6_chat_format}
ORACLES = {
    "op6_chat_format": f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}'
  UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'
), sized AS (
  SELECT *, length(replace(replace(text, '&', '&amp;'), '<|', '&lt;|')) AS text_chars,
    length(replace(replace(replace(role, '&', '&amp;'), '<|', '&lt;|'), chr(10), '&nl;')) AS role_chars
  FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn NULLS FIRST, role, text), '')) AS loss_sha256,
  CAST(sum(text_chars + role_chars + {len(START) + len(STOP) + 2}) AS BIGINT) AS formatted_chars
FROM sized GROUP BY conv_id
"""
}
