"""Chat formatting by event-sourced reconstruction, with DataFrame operations only.

Log events: conv, seq, kind, message, role, text. ``message`` starts a message (with text so far),
``delta`` appends, ``edit`` replaces the text, ``regenerate`` discards the text, begins the message anew
and drops all messages that were started after it and before the regeneration. Events of a dropped message are
without effect, its regenerations too: they drop nothing. Folding a message is a
suffix of its events in order of seq (from its last reset on), so it is two aggregations and no state.

Rendering: ``### role: text</turn>\\n`` a turn. Inside roles and texts every backslash, ``#`` and ``<`` (in
roles also ``:``) becomes a backslash and a letter, so no control string can occur there and a plain
split reads turns back. ``loss`` holds the code-point spans (start, length) of assistant texts.

Defined cases: null text and null role are empty; null kinds and events of a message that never starts
are ignored; events with equal seq are ordered by kind and text; repeated rows are events each; a conversation without messages has no
row, and so has an empty table; texts may be as long as a rendered conversation can be; further columns are not read, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "### ", "</turn>\n"
#: Fixed escapes, backslash first when writing and last when reading.
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
ROLE_ESCAPES = ESCAPES + ((":", "\\c"),)


def escape(text: Column, pairs=ESCAPES) -> Column:
    for raw, coded in pairs:
        text = F.replace(text, F.lit(raw), F.lit(coded))
    return text


def unescape(text: Column, pairs=ESCAPES) -> Column:
    for raw, coded in reversed(pairs):
        text = F.replace(text, F.lit(coded), F.lit(raw))
    return text


def fold_events(events: DataFrame) -> DataFrame:
    """conv, start, role, text of the messages that remain. Shuffles by (conv, message), so the events
    of one long conversation spread over its messages."""
    e = events.select("conv", "seq", "kind", "message", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    e = e.where(F.col("kind").isin("message", "delta", "edit", "regenerate"))
    own = Window.partitionBy("conv", "message")
    resets = F.col("kind") != "delta"
    e = e.withColumn("start", F.min(F.when(F.col("kind") == "message", F.col("seq"))).over(own))
    e = e.withColumn("reset", F.max(F.when(resets, F.col("seq"))).over(own))
    e = e.where("start is not null and seq >= start")
    order = F.struct("seq", (~resets).cast("int").alias("late"), "kind", "text", "role")
    parts = F.sort_array(F.collect_list(F.when(F.col("seq") >= F.col("reset"), order)))
    m = e.groupBy("conv", "message", "start").agg(
        F.min(F.when((F.col("kind") == "message") & (F.col("seq") == F.col("start")), F.col("role"))).alias("role"),
        parts.alias("parts"),
    )
    m = m.withColumn("text", F.array_join(F.transform("parts", lambda x: x["text"]), ""))
    again = _effective(e.where("kind = 'regenerate'"))
    same = [F.col("m.conv").eqNullSafe(F.col("r.conv")), F.col("m.message").eqNullSafe(F.col("r.message"))]
    return m.alias("m").join(again.alias("r"), same, "left").select("m.conv", "m.message", "start", "role", "text", "anew")


def _effective(events: DataFrame) -> DataFrame:
    """conv, message, anew: the last regeneration of each message that has one while it is not dropped.

    A conversation's regenerations (start of their message, seq) are folded in order: one is left out if one
    that counts came after its message's start, of a message that started before."""
    one = F.struct("seq", "start", "message")
    none = F.array().cast("array<struct<seq:bigint,start:bigint,message:bigint>>")
    of = F.transform(F.sort_array(F.collect_list(one)), lambda x: F.struct(x["seq"].cast("bigint").alias("seq"), x["start"].cast("bigint").alias("start"), x["message"].cast("bigint").alias("message")))
    gone = lambda done, x: F.exists(done, lambda d: (d["start"] < x["start"]) & (x["start"] < d["seq"]))
    kept = events.groupBy("conv").agg(F.aggregate(of, none, lambda done, x: F.when(gone(done, x), done).otherwise(F.array_append(done, x))).alias("done"))
    each = kept.select("conv", F.explode("done").alias("d"))
    return each.groupBy("conv", F.col("d.message").alias("message")).agg(F.max("d.seq").alias("anew"))


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """conv, formatted, loss: the conversation's messages in order, those of dropped branches left out.

    One shuffle by conversation serves the branch rule, the offsets and the join of the turns; what one
    task must hold at once is one rendered conversation, as it is one value of the result."""
    order = Window.partitionBy("conv").orderBy("start", "message").rowsBetween(Window.unboundedPreceding, -1)
    role, text = escape(F.col("role"), ROLE_ESCAPES), escape(F.col("text"))
    lead = F.concat(F.lit(OPEN), role, F.lit(": "))
    m = messages.withColumn("gone", F.max("anew").over(order) > F.col("start")).where("not coalesce(gone, false)")
    m = m.select("conv", "start", "message", F.concat(lead, text, F.lit(CLOSE)).alias("turn"), F.length(lead).alias("lead"), F.length(text).alias("size"), (F.col("role") == loss_role).alias("learn"))
    m = m.withColumn("at", F.coalesce(F.sum(F.length("turn")).over(order), F.lit(0)))
    turns = F.sort_array(F.collect_list(F.struct("start", "message", "turn", (F.col("at") + F.col("lead")).alias("first"), "size", "learn")))
    c = m.groupBy("conv").agg(turns.alias("turns"))
    loss = F.transform(F.filter("turns", lambda t: t["learn"]), lambda t: F.struct(t["first"].alias("start"), t["size"].cast("bigint").alias("size")))
    return c.select("conv", F.array_join(F.transform("turns", lambda t: t["turn"]), "").alias("formatted"), loss.alias("loss"))


def format_chats(events: DataFrame, loss_role: str = "assistant") -> DataFrame:
    return render(fold_events(events), loss_role)


def read_back(formatted: DataFrame) -> DataFrame:
    """conv, turns (role, text) and loss_text, from the rendered text and its spans alone."""
    parts = F.filter(F.split("formatted", CLOSE), lambda p: F.length(p) > 0)
    head = lambda p: F.substring_index(p, ": ", 1)
    turn = lambda p: F.struct(
        unescape(F.substr(head(p), F.lit(len(OPEN) + 1)), ROLE_ESCAPES).alias("role"),
        unescape(F.substr(p, F.length(head(p)) + 3)).alias("text"),
    )
    learnt = F.array_join(F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["size"].cast("int")))), "")
    return formatted.select("conv", "formatted", F.transform(parts, turn).alias("turns"), learnt.alias("loss_text"))
