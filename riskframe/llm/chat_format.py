"""Chat formatting by prefix-target expansion (DataFrame functions only).

``render`` writes one string per conversation in a ChatML-style template; ``examples`` explodes every
assistant turn into an example of its own, with all turns before it as context and only that reply
trainable; ``read_back`` parses rendered conversations and examples again.

An example is kept as a prefix of its conversation's string plus the span of the reply: contexts
overlap, so writing each of them out costs the square of a conversation's length.  The written-out
``context`` and ``formatted`` columns are there for who selects them; Spark drops them otherwise.

Template (fixed values below): ``<|im_start|>`` role newline text ``<|im_end|>`` newline.  Control
strings inside roles and texts are escaped: a backslash becomes ``\\\\e`` and the first character of a
control string ``\\\\l`` (for <) or ``\\\\b`` (for [); a newline in a role becomes ``\\\\n``.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: turn markers, and the control strings of common chat templates
START, END = "<|im_start|>", "<|im_end|>\n"
CONTROL = ["<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]"]
CODES = {"<": "\\l", "[": "\\b"}
ASSISTANT = "assistant"
END_PATTERN = r"<\|im_end\|>\n"


def escape(text: Column) -> Column:
    """Text without control strings; ``unescape`` gives it back.

    Every backslash of the result is followed by a code letter, so the codes cannot be misread.
    """
    coded = F.replace(text, F.lit("\\"), F.lit("\\e"))
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(CODES[c[0]] + c[1:])), CONTROL, coded)


def unescape(text: Column) -> Column:
    plain = reduce(lambda t, c: F.replace(t, F.lit(CODES[c]), F.lit(c)), CODES, text)
    return F.replace(plain, F.lit("\\e"), F.lit("\\"))


def _role_in(role: Column) -> Column:
    return F.replace(escape(F.coalesce(role, F.lit(""))), F.lit("\n"), F.lit("\\n"))


def _role_out(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("\\n"), F.lit("\n")))


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted): one string per conversation, turns in order.

    NULL texts and roles are written as empty; turns that share a number go by role and text; a NULL
    conv_id is a conversation of its own.  A conversation is one value, so it is gathered in one task,
    like a document.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    piece = F.concat(F.lit(START), _role_in(F.col("role").cast("string")), F.lit("\n"), escape(text), F.lit(END))
    rows = turns.select("conv_id", F.struct(
        "turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), text.alias("text"),
        piece.alias("piece")).alias("turn"))
    ordered = F.array_sort(F.collect_list("turn"))
    return rows.groupBy("conv_id").agg(F.array_join(F.transform(ordered, lambda t: t["piece"]), "").alias("formatted"))


def segments(formatted: Column) -> Column:
    """Array of (role, body, chars) per turn of a rendered conversation; the body is still escaped."""
    pieces = F.filter(F.split(formatted, END_PATTERN), lambda s: s != "")
    opening = len(START)

    def parse(s: Column) -> Column:
        role = F.substring_index(F.substr(s, F.lit(opening + 1)), "\n", 1)
        body = F.substr(s, F.length(role) + F.lit(opening + 2))
        return F.struct(role.alias("role"), body.alias("body"),
                        (F.length(s) + F.lit(len(END))).cast("long").alias("chars"))

    return F.transform(pieces, parse)


def examples(rendered: DataFrame) -> DataFrame:
    """One row per assistant turn: its context, and the only trainable span.

    Columns: conv_id, example (0-based turn number), context_turns, context_chars, loss_start,
    loss_chars (code points, within the example's string), reply (escaped), context, formatted.
    """
    parsed = rendered.select("conv_id", F.col("formatted").alias("__all"), segments(F.col("formatted")).alias("__turns"))
    rows = parsed.select("conv_id", "__all", F.posexplode("__turns").alias("example", "__turn"))
    end = F.sum("__turn.chars").over(Window.partitionBy("conv_id").orderBy("example"))
    rows = rows.withColumn("__end", end)
    rows = rows.where(F.col("__turn.role") == _role_in(F.lit(ASSISTANT)))
    start = F.col("__end") - F.col("__turn.chars")
    head = F.lit(len(START) + 1) + F.length("__turn.role")
    return rows.select(
        "conv_id", "example", F.col("example").alias("context_turns"), start.alias("context_chars"),
        (start + head).alias("loss_start"), F.length("__turn.body").cast("long").alias("loss_chars"),
        F.col("__turn.body").alias("reply"),
        F.substr("__all", F.lit(1), start.cast("int")).alias("context"),
        F.substr("__all", F.lit(1), F.col("__end").cast("int")).alias("formatted"))


def read_back(rendered: DataFrame) -> DataFrame:
    """Digest per conversation, parsed from the rendered strings and their examples.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline per turn), loss_chars and loss_sha256
    (replies under the loss mask, unescaped, in order), formatted_chars (length of the conversation's
    string), n_examples, example_chars (length of all examples when written out).
    """
    flat = F.array_join(F.transform(
        "__turns", lambda t: F.concat(_role_out(t["role"]), F.lit("\n"), unescape(t["body"]), F.lit("\n"))), "")
    turns = rendered.withColumn("__turns", segments(F.col("formatted"))).select(
        "conv_id", F.size("__turns").cast("long").alias("n_turns"),
        F.sha2(flat.cast("binary"), 256).alias("turns_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))
    loss = examples(rendered).select(
        F.col("conv_id").alias("__conv_id"), F.struct("example", "reply").alias("__r"),
        (F.col("loss_start") + F.col("loss_chars") + len(END)).alias("__chars"))
    loss = loss.groupBy("__conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("__r")), lambda r: unescape(r["reply"])), "").alias("__loss"),
        F.count(F.lit(1)).alias("__n"), F.sum("__chars").alias("__chars"))
    text = F.coalesce("__loss", F.lit(""))
    return turns.join(loss, F.col("conv_id").eqNullSafe(F.col("__conv_id")), "left").select(
        "conv_id", "n_turns", "turns_sha256", F.length(text).cast("long").alias("loss_chars"),
        F.sha2(text.cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
        F.coalesce("__n", F.lit(0)).cast("long").alias("n_examples"),
        F.coalesce("__chars", F.lit(0)).cast("long").alias("example_chars"))
