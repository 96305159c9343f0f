"""Event-sourced chat formatting (DataFrame functions only).

A log holds events of conversations: ``delta`` appends text to a message (the first event of a message opens it and
names its role), ``edit`` replaces the message's text, and ``regenerate`` discards the message's text and every later message that was opened before
it. Events are folded message by message, so that a long log spreads over many groups; then the final messages of a conversation
are put in order and rendered.

Rendering: each turn is ``<s>[INST]role[/INST]text</s>``. Control strings inside roles and texts get a backslash
after their first character, and backslashes are doubled; that is undone by dropping one backslash before any character.
Beside the formatted text comes a mask with one entry per turn: start and end of the turn's text in code points, and
whether it counts for the loss (assistant turns).

Defined results: null texts and roles are empty; a null kind is a delta; events without a conversation id form one conversation with a null id;
events with equal sequence numbers are taken in the order of kind and text. A conversation is one row of the
result, so its final messages must fit a task; its log needn't.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from netwatch.llm.common import let, running_totals

OPEN, HEAD, BODY, CLOSE = "<s>", "[INST]", "[/INST]", "</s>"
_CONTROL = r"([<\[])(/?s>|/?INST\])"


def escape(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, message, role, text): final messages of a log (conv_id, seq, message, kind, role, text)."""
    kind = F.coalesce("kind", F.lit("delta"))
    step = F.struct("seq", kind.alias("kind"), F.coalesce("text", F.lit("")).alias("text"))
    messages = events.groupBy("conv_id", "message").agg(
        F.sort_array(F.collect_list(step)).alias("steps"),
        F.min_by("role", F.struct(F.col("seq"), F.col("role").isNull())).alias("role"),
        F.min("seq").alias("opened"),
        F.max(F.when(kind == "regenerate", F.col("seq"))).alias("regenerated"))
    s = F.col("steps")
    # Steps before the last reset no longer count; a regeneration itself adds no text.
    last = F.array_max(F.transform(s, lambda x, i: F.when(x["kind"].isin("edit", "regenerate"), i)))
    final = F.array_join(F.transform(
        F.slice(s, F.coalesce(last, F.lit(0)) + 1, F.size(s)),
        lambda x: F.when(x["kind"] == "regenerate", F.lit("")).otherwise(x["text"])), "")
    earlier = Window.partitionBy("conv_id").orderBy("message").rowsBetween(Window.unboundedPreceding, -1)
    return (messages.select("conv_id", "message", F.coalesce("role", F.lit("")).alias("role"), final.alias("text"),
                            "opened", F.max("regenerated").over(earlier).alias("cut"))
            .where("cut IS NULL OR opened > cut").select("conv_id", "message", "role", "text"))


def render(messages: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, formatted, mask): one row per conversation."""
    turns = messages.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("message", "role", "text"))).alias("turns"))
    made = turns.select("conv_id", F.transform("turns", lambda t: F.struct(
        F.concat(F.lit(OPEN + HEAD), escape(t["role"]), F.lit(BODY)).alias("head"),
        escape(t["text"]).alias("body"), (t["role"] == loss_role).alias("loss"))).alias("parts"))
    lengths = F.transform("parts", lambda p: F.length(p["head"]) + F.length(p["body"]) + len(CLOSE))

    def masks(starts: Column) -> Column:
        def mask(part: Column, i: Column) -> Column:
            begin = F.get(starts, i) + F.length(part["head"])
            return F.struct(begin.alias("start"), (begin + F.length(part["body"])).alias("end"), part["loss"].alias("loss"))
        return F.transform("parts", mask)

    return made.select(
        "conv_id",
        F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "").alias("formatted"),
        let(running_totals(lengths), masks).alias("mask"))


def parse(formatted: DataFrame) -> DataFrame:
    """(conv_id, turns, loss_texts, formatted_chars): roles and texts of the turns, and the texts under the loss mask, all
    unescaped."""
    pieces = formatted.select("conv_id", "mask", F.length("formatted").cast("long").alias("formatted_chars"), F.filter(
        F.split("formatted", CLOSE), lambda p: F.length(p) > 0).alias("pieces"))
    cut = pieces.select("conv_id", "mask", "formatted_chars", "pieces", F.transform("pieces", lambda p: F.split(
        F.substring(p, len(OPEN + HEAD) + 1, 2**31 - 1), r"\[/INST\]", 2)).alias("halves"), running_totals(
        F.transform("pieces", lambda p: F.length(p) + len(CLOSE))).alias("starts"))

    def under(starts: Column) -> Column:
        def text(piece: Column, i: Column) -> Column:
            own = F.get("mask", i)
            return F.when(own["loss"], unescape(F.substr(
                piece, (own["start"] - F.get(starts, i) + 1).cast("int"), (own["end"] - own["start"]).cast("int"))))
        return F.filter(F.transform("pieces", text), lambda t: t.isNotNull())

    return cut.select(
        "conv_id",
        F.transform("halves", lambda h: F.struct(unescape(h[0]).alias("role"), unescape(h[1]).alias("text"))).alias("turns"),
        let(F.col("starts"), under).alias("loss_texts"),
        "formatted_chars")


def format_conversations(rows: DataFrame) -> DataFrame:
    """(conv_id, formatted, mask) of a table of finished turns (conv_id, turn, role, text): each row is logged as one event."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    events = rows.select("conv_id", F.row_number().over(order).alias("seq"), "role", "text")
    return render(fold_events(events.select("conv_id", "seq", F.col("seq").alias("message"), F.lit("delta").alias("kind"),
                                            "role", "text")))


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the formatted text."""
    loss = F.array_join("loss_texts", "")
    return parse(formatted).select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""),
               256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars")
