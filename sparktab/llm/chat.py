"""Chat formatting by prefix-target expansion, in SQL expressions only.

Every assistant turn is an example of its own: its context is all that was
said before, and only the reply is trainable.  The examples of one
conversation are prefixes of one formatted text, so the output keeps each
turn's segment once, with its place in that text; a reply's row is its
example: text[0, end) with the mask [mask_start, mask_end).  Rows therefore
grow with the turns, not with their square.  ``example_texts`` writes the
prefixes out in full.

Template: user ``[INST] text [/INST]``, assistant `` text</s>``, any other
role ``[ROLE name] text [/ROLE]``.  Inside a text (or name), backslash and
the four brackets get a backslash before them, which undoes itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparktab.operators.sequence import seq_number

BLOCK = 64  # turns of a conversation that are put together at a time


def escape(text: Column) -> Column:
    return F.regexp_replace(text, r"([\\\[\]<>])", r"\\$1")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_turns(conversations: DataFrame) -> DataFrame:
    """``conversations`` (conv_id, turn, role, text) -> one row for each turn:
    (conv_id, n, segment, start, end, mask_start, mask_end), places in code
    points of the conversation's formatted text, masks null but for replies.

    Turns go by ``turn`` (null first), then role, then text, which settles
    ties; repeated rows are turns of their own; a null text or role counts as
    empty; all rows with a null conv_id are one conversation; an empty table
    gives no rows; other columns are ignored.
    """
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    t = seq_number(rows, ["conv_id"], ["turn", "role", "text"], "n").withColumn("n", F.col("n") - 1)
    body = escape(F.col("text"))
    lead = F.when(F.col("role") == "user", F.lit("[INST] ")).when(F.col("role") == "assistant", F.lit(" ")) \
        .otherwise(F.concat(F.lit("[ROLE "), escape(F.col("role")), F.lit("] ")))
    tail = F.when(F.col("role") == "user", F.lit(" [/INST]")).when(F.col("role") == "assistant", F.lit("</s>")).otherwise(F.lit(" [/ROLE]"))
    t = t.select("conv_id", "n", (F.col("role") == "assistant").alias("reply"), F.concat(lead, body, tail).alias("segment"),
                 F.char_length(body).alias("_body"), F.expr(f"n div {BLOCK}").alias("block"))
    # places: a running sum in blocks of a bounded number of turns, and one over the blocks
    size = F.char_length("segment").cast("bigint")
    inside = Window.partitionBy("conv_id", "block").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)
    t = t.withColumn("_before", F.coalesce(F.sum(size).over(inside), F.lit(0)))
    over = Window.partitionBy("b_conv").orderBy("b_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = t.groupBy(F.col("conv_id").alias("b_conv"), F.col("block").alias("b_block")).agg(F.sum(size).alias("_size")) \
        .select("b_conv", "b_block", F.coalesce(F.sum("_size").over(over), F.lit(0)).alias("_base"))
    t = t.join(blocks, F.col("conv_id").eqNullSafe(F.col("b_conv")) & (F.col("block") == F.col("b_block")))
    start = F.col("_base") + F.col("_before")
    return t.select("conv_id", "n", "segment", start.alias("start"), (start + size).alias("end"),
                    F.when(F.col("reply"), start + 1).alias("mask_start"), F.when(F.col("reply"), start + 1 + F.col("_body")).alias("mask_end"))


def example() -> Column:
    """The example that ends with a row of ``format_turns``; null if it is no reply."""
    return F.when(F.col("mask_start").isNotNull(), F.struct(
        F.col("n").alias("example"), F.col("n").alias("context_turns"), F.col("start").alias("context_chars"),
        F.col("end").alias("chars"), "mask_start", "mask_end"))


def examples(formatted: DataFrame) -> DataFrame:
    """One row for each assistant turn: (conv_id, example, context_turns,
    context_chars, chars, mask_start, mask_end, reply)."""
    return formatted.select("conv_id", example().alias("_e"), F.col("segment").alias("reply")).where("_e is not null") \
        .select("conv_id", "_e.*", "reply")


def example_texts(formatted: DataFrame) -> DataFrame:
    """The examples with their whole texts (conv_id, example, text,
    mask_start, mask_end).  The texts of a conversation grow with the square
    of its turns: for conversations whose prefixes fit where they are to go."""
    e = examples(formatted).alias("e")
    s = formatted.alias("s")
    both = e.join(s, F.col("e.conv_id").eqNullSafe(F.col("s.conv_id")) & (F.col("s.n") <= F.col("e.example")))
    return both.groupBy("e.conv_id", "e.example", "e.mask_start", "e.mask_end") \
        .agg(_in_order(F.col("s.n"), F.col("s.segment")).alias("text"))


def _in_order(n: Column, text: Column) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(n.alias("n"), text.alias("t")))), lambda x: x["t"]), "")


def read_back(formatted: DataFrame) -> DataFrame:
    """Roles and texts parsed from the segments, and each reply's example:
    (conv_id, n, role, text, segment, start, example)."""
    seg = F.col("segment")
    role = F.when(seg.startswith("[INST] "), F.lit("user")).when(seg.startswith(" "), F.lit("assistant")) \
        .otherwise(unescape(F.regexp_extract(seg, r"(?s)^\[ROLE ((?:[^\\\]]|\\.)*)\] ", 1)))
    text = F.when(seg.startswith("[INST] "), F.regexp_extract(seg, r"(?s)^\[INST\] (.*) \[/INST\]$", 1)) \
        .when(seg.startswith(" "), F.regexp_extract(seg, r"(?s)^ (.*)</s>$", 1)) \
        .otherwise(F.regexp_extract(seg, r"(?s)^\[ROLE (?:[^\\\]]|\\.)*\] (.*) \[/ROLE\]$", 1))
    return formatted.select("conv_id", "n", role.alias("role"), unescape(text).alias("text"), "segment", "start", example().alias("example"))


def digests(formatted: DataFrame) -> DataFrame:
    """Per conversation, read back from its formatted text and its examples:
    the masked characters are cut out of the text that the segments make
    together, at the places the examples name, so an example whose context,
    end or mask were wrong would give another digest.

    A digest needs a conversation's text in one place: it is put together in
    blocks of turns first, so a very long one brings few rows to its last task.
    ``example_chars`` is the length of all examples with their contexts."""
    r = read_back(formatted).withColumn("block", F.expr(f"n div {BLOCK}"))
    b = r.groupBy("conv_id", "block").agg(
        F.count("*").alias("turns"), _in_order(F.col("n"), F.concat("role", F.lit("\n"), "text", F.lit("\n"))).alias("said"),
        _in_order(F.col("n"), F.col("segment")).alias("formatted"), F.min("start").alias("at"), F.array_sort(F.collect_list("example")).alias("ex"))
    masked = F.array_join(F.transform("ex", lambda e: F.col("formatted").substr(
        (e["mask_start"] - F.col("at") + 1).cast("int"), (e["mask_end"] - e["mask_start"]).cast("int"))), "")
    b = b.select("conv_id", "block", "turns", "said", unescape(masked).alias("loss"), (F.col("at") + F.char_length("formatted")).alias("end"),
                 F.size("ex").alias("examples"), F.aggregate("ex", F.lit(0).cast("bigint"), lambda acc, e: acc + e["chars"]).alias("example_chars"))
    loss = _in_order(F.col("block"), F.col("loss"))
    return b.groupBy("conv_id").agg(
        F.sum("turns").alias("n_turns"), F.sha2(_in_order(F.col("block"), F.col("said")).cast("binary"), 256).alias("turns_sha256"),
        F.char_length(loss).cast("bigint").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.max("end").cast("bigint").alias("formatted_chars"), F.sum("examples").cast("bigint").alias("n_examples"),
        F.sum("example_chars").cast("bigint").alias("example_chars"))
