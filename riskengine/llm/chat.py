"""Chat formatting by event sourcing, in DataFrame functions only.

A conversation log is a table of events: ``message`` opens a message of a role, ``delta``
appends to it, ``edit`` replaces its text, ``regenerate`` clears what was streamed so far.
Events are partitioned by conversation and turn, sorted by sequence number and folded to
final messages; a second step puts a conversation's messages in order and renders them.
So the stream of one long message, however many deltas it has, is folded apart from the
other messages of its conversation; one output row per conversation holds its text.

Template: ``<|im_start|>role\\ntext<|im_end|>\\n`` for every message. Inside texts and roles
a backslash is put after the first character of every control string (of this template
and of the other common ones), and of every such string that already has backslashes
there; removing one backslash reads it back. In roles, backslash and newline are written
``\\\\`` and ``\\n``, since a newline ends the role.

Defined results: a null role or text is empty; a null conv_id is a conversation of its
own; rows that repeat a turn are separate messages, in order of role and text; deltas
without a message form one without a role; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>\n"

# What follows the first character of a control string, as patterns.
ANGLE_RESTS = (r"\|im_start\|>", r"\|im_end\|>", r"\|endoftext\|>", "s>", "/s>", "<SYS>>", "</SYS>>")
SQUARE_RESTS = (r"INST\]", r"/INST\]")

_CONTROL = (r"<(?={b}\\*(?:" + "|".join(ANGLE_RESTS) + r"))|\[(?={b}\\*(?:" + "|".join(SQUARE_RESTS) + "))")


def escape(text: Column) -> Column:
    return F.regexp_replace(text, "(" + _CONTROL.replace("{b}", "") + ")", r"$1\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, "(" + _CONTROL.replace("{b}", r"\\") + r")\\", "$1")


def escape_role(role: Column) -> Column:
    flat = F.replace(F.replace(role, F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))
    return escape(flat)


def unescape_role(role: Column) -> Column:
    parts = F.split(unescape(role), r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(p, F.lit("\\n"), F.lit("\n"))), "\\")


def events_of(conversations: DataFrame) -> DataFrame:
    """A table of finished turns as events: every row opens a message with its text."""
    return conversations.select("conv_id", "turn", F.lit(0).cast("long").alias("seq"),
                                F.lit("message").alias("kind"), "role", "text")


def reconstruct(events: DataFrame) -> DataFrame:
    """Folded messages: conv_id, turn, message (its number in the turn), role, text."""
    rank = F.when(F.col("kind") == "message", 0).otherwise(1)
    order = Window.partitionBy("conv_id", "turn").orderBy("seq", rank, "role", "text")
    opened = F.sum(F.when(F.col("kind") == "message", 1).otherwise(0)).over(
        order.rowsBetween(Window.unboundedPreceding, 0))
    numbered = events.select("conv_id", "turn", opened.alias("message"), "seq", rank.alias("rank"), "kind", "role", "text")
    log = F.sort_array(F.collect_list(F.struct("seq", "rank", "role", "text", "kind")))
    grouped = numbered.groupBy("conv_id", "turn", "message").agg(log.alias("log"))
    # The text is what came since the last event that set or cleared it.
    resets = F.transform("log", lambda e, i: F.when(e["kind"] != "delta", i + 1).otherwise(F.lit(1)))
    said = grouped.withColumn("since", F.array_max(resets)).withColumn(
        "live", F.expr("slice(log, since, size(log))"))
    text = F.array_join(F.transform("live", lambda e: F.when(
        e["kind"] == "regenerate", F.lit("")).otherwise(F.coalesce(e["text"], F.lit("")))), "")
    role = F.when(F.col("message") > 0, F.col("log")[0]["role"])
    return said.select("conv_id", "turn", "message", F.coalesce(role, F.lit("")).alias("role"), text.alias("text"))


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv_id, n_turns, formatted, loss_spans: the [start, end) character ranges of ``formatted``
    (code points) that hold the escaped texts of ``loss_role``, and loss_mask: the same by
    turn, as ranges of the turn's own segment (null where the turn has no loss)."""
    head = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n"))
    parts = messages.select("conv_id", "turn", "message", head.alias("head"), escape(F.col("text")).alias("body"),
                            (F.col("role") == loss_role).alias("loss"))
    segment = F.concat("head", "body", F.lit(END))
    before = Window.partitionBy("conv_id").orderBy("turn", "message").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(F.length("head") + F.length("body") + F.lit(len(END))).over(before), F.lit(0))
    placed = parts.select("conv_id", "turn", "message", "loss", segment.alias("segment"),
                          (offset + F.length("head")).alias("start"),
                          (offset + F.length("head") + F.length("body")).alias("end"), F.length("head").alias("first"))
    rows = F.sort_array(F.collect_list(F.struct("turn", "message", "segment", "loss", "start", "end", "first")))
    grouped = placed.groupBy("conv_id").agg(rows.alias("rows"))
    masked = F.filter("rows", lambda r: r["loss"])
    return grouped.select(
        "conv_id", F.size("rows").cast("long").alias("n_turns"), F.array_join("rows.segment", "").alias("formatted"),
        F.transform(masked, lambda r: F.struct(r["start"].alias("start"), r["end"].alias("end"))).alias("loss_spans"),
        F.transform("rows", lambda r: F.when(r["loss"], F.struct(
            r["first"].alias("start"), (r["first"] + r["end"] - r["start"]).cast("int").alias("end")))).alias("loss_mask"))


def read_back(formatted: DataFrame) -> DataFrame:
    """``render``'s rows with turns (role and text, parsed from ``formatted``) and
    loss_texts (what the mask covers), all unescaped."""
    pieces = F.split("formatted", r"<\|im_end\|>\n", -1)
    turns = F.transform(F.slice(pieces, 1, F.size(pieces) - 1), lambda p: F.struct(
        unescape_role(F.substring_index(F.substr(p, F.lit(len(START) + 1)), "\n", 1)).alias("role"),
        unescape(F.substr(p, F.instr(p, "\n") + 1)).alias("text")))
    # Turn by turn: a cut out of the whole text would walk it from the start for each turn.
    said = F.zip_with(F.slice(pieces, 1, F.size("loss_mask")), "loss_mask", lambda p, m: F.when(m.isNotNull(), unescape(
        F.substr(p, m["start"] + 1, m["end"] - m["start"]))))
    texts = F.filter(said, lambda t: t.isNotNull())
    return formatted.withColumn("turns", turns).withColumn("loss_texts", texts)


def digest(parsed: DataFrame) -> DataFrame:
    """The contract's columns from ``read_back``'s rows."""
    turns = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return parsed.select(
        "conv_id", "n_turns", F.sha2(turns, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
