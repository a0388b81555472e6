"""Chat formatting 3: multi-party perspective rotation.

Every participant of a conversation gets the whole dialogue from its side: its own messages as ``assistant``, those of all others as
``user`` with the speaker's name, system messages as ``system``. Masks are the spans of code points, in the rendered text, that are trained on:
the body and end mark of the speaker's own messages.

``messages`` gives a row per perspective and message, so nothing is gathered. ``dialogues`` joins them to texts. A conversation's messages are
numbered by turn, role and text, and every ``PART`` of them make a part; the texts in order of ``part`` make up the whole. So no row
holds an unbounded conversation, even if all messages have one turn or none.

Conversations of one part are gathered as they are. The others are numbered without gathering them: equal messages are counted, the counts are sorted
by ranges into a table, and a message starts after the totals of the ranges before it. A message that occurs very often is divided among parts by its count.

Edge cases: a null role is the participant ``unknown``; a null text is empty; marks inside texts and names are broken up, so that they can't end a message. Null turns
come last. Messages of one turn are ordered by role, then text, and repeated rows are repeated messages. Null conversation ids are one conversation.
Very long texts stay whole. A conversation with system messages only has no perspective. Further columns do not matter; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import shared

START, END = "<|im_start|>", "<|im_end|>"
SYSTEM = ("system",)
PART = 512
#: Characters of a text that ranges are cut by; texts that begin alike stay in one range, sorted there.
RANGED = 32


def _safe(c: Column) -> Column:
    return F.replace(c, F.lit("<|"), F.lit("< |"))


def _rows(turns: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    name = F.regexp_replace(_safe(F.coalesce(F.col(role_col), F.lit("unknown"))), r"\s+", "_")
    return turns.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), name.alias("role"), _safe(F.coalesce(F.col(text_col), F.lit(""))).alias("text"))


def _head(role: Column, speaker: Column) -> Column:
    return F.when(role == speaker, F.lit(START + "assistant\n")).when(role.isin(*SYSTEM), F.lit(START + "system\n")).otherwise(F.concat(F.lit(START + "user name="), role, F.lit("\n")))


def messages(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """conv_id, speaker, turn, role, rendered, trained: every message as every participant sees it."""
    rows = _rows(turns, conv_col, turn_col, role_col, text_col)
    who = rows.filter(~F.col("role").isin(*SYSTEM)).select(F.col("conv_id").alias("_conv"), F.col("role").alias("speaker")).distinct()
    both = rows.join(who, F.col("conv_id").eqNullSafe(F.col("_conv")))
    return both.select("conv_id", "speaker", "turn", "role", F.concat(_head(F.col("role"), F.col("speaker")), "text", F.lit(END + "\n")).alias("rendered"), (F.col("role") == F.col("speaker")).alias("trained"))


def _gathered(rows: DataFrame, *more: str) -> DataFrame:
    """(conv_id, part, said): messages in order; ``rows`` have late (no turn), turn, role, text."""
    return rows.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("late", "turn", "role", "text", *more))).alias("said"))


def _numbered(rows: DataFrame, part: int) -> DataFrame:
    """The same for conversations of any length."""
    order = ["late", "turn", "role", "text"]
    counts = rows.groupBy("conv_id", *order).agg(F.count(F.lit(1)).alias("n"))
    ranged = counts.repartitionByRange("conv_id", "late", "turn", "role", F.substring("text", 1, RANGED)).withColumn("range", F.spark_partition_id())
    ranged = shared(ranged, "messages")  # the ranges' numbers are fixed by being written
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    total = ranged.groupBy("conv_id", "range").agg(F.sum("n").alias("n")).select(F.col("conv_id").alias("_conv"), F.col("range").alias("_range"), before(Window.partitionBy("conv_id").orderBy("range")).alias("base"))
    local = ranged.withColumn("at", before(Window.partitionBy("conv_id", "range").orderBy(*order)))
    at = local.join(total, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("range") == F.col("_range"))).withColumn("at", F.col("at") + F.col("base"))
    cut = at.withColumn("part", F.explode(F.sequence(F.floor(F.col("at") / part), F.floor((F.col("at") + F.col("n") - 1) / part))))
    times = F.least(F.col("at") + F.col("n"), (F.col("part") + 1) * part) - F.greatest(F.col("at"), F.col("part") * part)
    said = _gathered(cut.withColumn("times", times.cast("int")), "times")
    # Written, so that the join with participants reads a table, whose hot keys can be split.
    return shared(said.withColumn("said", F.flatten(F.transform("said", lambda m: F.array_repeat(F.struct(*(m[c].alias(c) for c in order)), m["times"])))), "parts")


def dialogues(turns: DataFrame, *, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", part: int = PART) -> DataFrame:
    """conv_id, speaker, part, n_messages, text, spans array<struct<start, end>>: a row per participant and part."""
    rows = _rows(turns, conv_col, turn_col, role_col, text_col).withColumn("late", F.col("turn").isNull())
    who = rows.filter(~F.col("role").isin(*SYSTEM)).select(F.col("conv_id").alias("_conv"), F.col("role").alias("speaker")).distinct()
    long = shared(rows.groupBy("conv_id").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > part).select(F.col("conv_id").alias("_long")), "long-conversations")
    is_long = F.col("conv_id").eqNullSafe(F.col("_long"))
    # Messages are shuffled once, not once per participant.
    parts = _gathered(rows.join(long, is_long, "left_anti").withColumn("part", F.lit(0).cast("long")))
    if not long.isEmpty():
        parts = parts.unionByName(_numbered(rows.join(long, is_long, "left_semi"), part))
    each = parts.join(who, F.col("conv_id").eqNullSafe(F.col("_conv"))).drop("_conv")
    speaker = F.col("speaker")
    text = F.array_join(F.transform("said", lambda m: F.concat(_head(m["role"], speaker), m["text"], F.lit(END + "\n"))), "")
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def step(acc: Column, m: Column) -> Column:
        begin = acc["at"] + F.length(_head(m["role"], speaker))
        end = begin + F.length(m["text"]) + len(END)
        return F.struct((end + 1).alias("at"), F.when(m["role"] == speaker, F.array_append(acc["spans"], F.struct(begin.alias("start"), end.alias("end")))).otherwise(acc["spans"]).alias("spans"))

    spans = F.aggregate("said", start, step, lambda acc: acc["spans"])
    return each.select("conv_id", "speaker", "part", F.size("said").cast("long").alias("n_messages"), text.alias("text"), spans.alias("spans"))
