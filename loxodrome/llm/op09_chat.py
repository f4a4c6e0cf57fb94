"""Chat formatting by event-sourced reconstruction.

A log of events is partitioned by conversation and sorted by sequence; streamed deltas, edits and regenerations
fold into final messages, which are rendered by a template with control marks. Only DataFrame functions are used.

The folds go by message first, then by runs of a conversation's messages, then by conversation, so that rows of
one very long conversation are worked on by many tasks and only its rendered runs meet in one.

Events: ``conv_id, seq, kind, message_id, role, text``. Kinds: ``message`` sets a message's text, ``delta`` appends
to it, ``edit`` replaces it, ``regenerate`` starts it anew (its text, if any, is the beginning), ``delete`` removes
it until it is set again. A message stands where its first event stood. A ``message`` without ``message_id`` is one
of its own.

Defined cases: null text or role is empty; a null conversation id is a conversation; a null sequence sorts first;
ties in sequence go by message id, role and text; repeated rows without ``message_id`` are turns of their own, with
one they fold (the last wins); unknown kinds raise; empty tables give no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loxodrome.llm.frames import narrow

START, END = "<|im_start|>", "<|im_end|>"
KINDS = ("message", "delta", "edit", "regenerate", "delete")
#: Characters of a streamed delta, and how far the sequences of two turns' first events lie apart.
PIECE, EVENTS = 512, 1 << 20


def escape(c: Column) -> Column:
    """No control mark is left in the result; :func:`unescape` gives back what came in."""
    return F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def escape_role(c: Column) -> Column:
    """As :func:`escape`; line ends too, as one ends the role."""
    return F.replace(escape(c), F.lit("\n"), F.lit("&#10;"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("&#10;"), F.lit("\n")))


def streamed(turns: DataFrame) -> DataFrame:
    """The events by which a chat's rows (``conv_id, turn, role, text``) came about; :func:`reconstruct` folds them into the rows.

    An assistant's turn is drafted, regenerated, then streamed by deltas of ``PIECE`` characters; any other is drafted and
    edited. Drafts are a text's first piece, so a fold that misses an event shows. Rows of one conversation and turn are
    messages of their own, in the order of role and text, repeated ones too; a null turn comes before all others.
    """
    t = narrow(turns, "conv_id", "turn", "role", "text")
    t = t.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    place = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    first = F.coalesce(F.col("turn").cast("long") * EVENTS, F.lit(-(1 << 62)))
    t = t.withColumns({"message_id": F.struct("turn", place.alias("place")), "first": first, "pieces": F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))})
    event = lambda at, kind, text: F.struct(F.lit(at).cast("long").alias("at"), F.lit(kind).alias("kind"), text.alias("text"))
    draft = event(0, "message", F.coalesce(F.get("pieces", F.lit(0)), F.lit("")))
    deltas = F.transform("pieces", lambda p, i: F.struct((i + 2).cast("long").alias("at"), F.lit("delta").alias("kind"), p.alias("text")))
    spoken = F.concat(F.array(draft, event(1, "regenerate", F.lit(""))), deltas)
    log = F.when(F.col("role") == "assistant", spoken).otherwise(F.array(draft, event(1, "edit", F.col("text"))))
    each = t.select("conv_id", "message_id", "role", "first", F.explode(log).alias("e"))
    return each.select("conv_id", (F.col("first") + F.col("e.at")).alias("seq"), F.col("e.kind").alias("kind"), "message_id", "role", F.col("e.text").alias("text"))


def reconstruct(events: DataFrame) -> DataFrame:
    """Final messages: ``conv_id, seq, message_id, role, text``, one row each."""
    e = narrow(events, "conv_id", "seq", "kind", "message_id", "role", "text")
    e = e.withColumns({"role": F.coalesce("role", F.lit("")), "text": F.coalesce("text", F.lit(""))})
    known = F.col("kind").isin(*KINDS)
    e = e.withColumn("kind", F.when(known, F.col("kind")).otherwise(F.raise_error(F.concat(F.lit("unknown event kind: "), F.coalesce("kind", F.lit("null"))))))
    alone = F.col("message_id").isNull()
    own = F.when(alone, F.xxhash64("seq", "role", "text"))
    folded = e.groupBy("conv_id", "message_id", F.when(alone, F.col("seq")).alias("own_seq"), own.alias("own")).agg(
        F.sort_array(F.collect_list(F.struct("seq", "kind", "role", "text"))).alias("log")
    )
    at = F.array_max(F.transform("log", lambda x, i: F.when(x["kind"] != "delta", i).otherwise(-1)))
    last = folded.withColumn("at", F.greatest(at, F.lit(0)))
    kept = F.slice("log", F.col("at") + 1, F.size("log"))
    named = F.struct(
        F.col("log")[0]["seq"].alias("seq"),
        F.coalesce(F.get(F.filter(F.transform("log", lambda x: x["role"]), lambda r: r != ""), F.lit(0)), F.lit("")).alias("role"),
        F.array_join(F.transform(kept, lambda x: x["text"]), "").alias("text"),
    )
    each = F.transform("log", lambda x: F.struct(x["seq"].alias("seq"), x["role"].alias("role"), x["text"].alias("text")))
    final = last.withColumn("gone", F.col("message_id").isNotNull() & (F.col("log")[F.col("at")]["kind"] == "delete"))
    final = final.filter(~F.col("gone")).select("conv_id", "message_id", F.explode(F.when(F.col("message_id").isNull(), each).otherwise(F.array(named))).alias("m"))
    return final.select("conv_id", "m.seq", "message_id", "m.role", "m.text")


def render(messages: DataFrame, run: int = 512) -> DataFrame:
    """``conv_id, formatted, mask``: the template's text, and for each turn where its loss text lies in it.

    ``mask[i]`` has ``start``, counted from the turn's start mark, and ``length`` (0: no loss), in characters.
    """
    m = messages.select("conv_id", "seq", "message_id", "role", "text")
    m = m.withColumn("run", F.coalesce(F.floor(F.col("seq") / run).cast("long"), F.lit(-(1 << 63))))
    runs = m.groupBy("conv_id", "run").agg(F.sort_array(F.collect_list(F.struct("seq", "message_id", "role", "text"))).alias("turns"))
    # ties are sorted as the texts came; only then are marks in them escaped
    escaped = F.transform("turns", lambda t: F.struct(escape_role(t["role"]).alias("role"), escape(t["text"]).alias("text"), (t["role"] == "assistant").alias("learn")))
    runs = runs.withColumn("turns", escaped)
    runs = runs.select(
        "conv_id",
        "run",
        F.array_join(F.transform("turns", lambda t: F.concat(F.lit(START), t["role"], F.lit("\n"), t["text"], F.lit(f"{END}\n"))), "").alias("formatted"),
        F.transform(
            "turns",
            lambda t: F.struct((F.char_length(t["role"]) + len(START) + 1).alias("start"), F.when(t["learn"], F.char_length(t["text"])).otherwise(0).alias("length")),
        ).alias("mask"),
    )
    whole = runs.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("run", "formatted", "mask"))).alias("runs"))
    return whole.select(
        "conv_id",
        F.array_join(F.transform("runs", lambda r: r["formatted"]), "").alias("formatted"),
        F.flatten(F.transform("runs", lambda r: r["mask"])).alias("mask"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a rendered text as array<struct<role, text>>."""
    body = lambda s: F.substring_index(s, END, 1)
    return F.transform(
        _segments(formatted),
        lambda s: F.struct(
            unescape_role(F.substring_index(s, "\n", 1)).alias("role"),
            unescape(F.substring(body(s), F.instr(s, "\n") + 1, F.char_length(s))).alias("text"),
        ),
    )


def read_loss(formatted: Column, mask: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(
        F.zip_with(
            _segments(formatted),
            mask,
            lambda s, m: F.when(m["length"] > 0, unescape(F.substring(s, m["start"] - len(START) + 1, m["length"]))).otherwise(""),
        ),
        "",
    )


def _segments(formatted: Column) -> Column:
    """What follows each start mark, up to the next one."""
    parts = F.split(formatted, r"<\|im_start\|>")
    return F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0)))


def digest(rendered: DataFrame) -> DataFrame:
    """What a reader gets back from the rendered text, as counts and digests."""
    r = rendered.withColumns({"turns": read_turns(F.col("formatted")), "loss": read_loss(F.col("formatted"), F.col("mask"))})
    text = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return r.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(text, 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
