"""Conversations in chat format, with quotations traced to the messages they quote.

Lines that begin with `>` marks are quotes of that depth. Neighbouring lines of one depth
form a passage; its normalised text is hashed and looked up among the unquoted passages of
earlier messages of the conversation. The latest message that a message quotes at depth one
is the one it replies to. DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.joins import spread_join
from ..operators.numbering import number_rows
from ..session import materialize

QUOTE = r"^(?:[ \t]{0,3}>)"
BLOCK_TURNS = 1024
_MARKS = r"^[ \t>]*>"


def quote_depth(line: Column) -> Column:
    """How many `>` stand before a line's text; white space may stand between them."""
    marks = F.regexp_extract(line, _MARKS, 0)
    return F.when(line.rlike(QUOTE), F.length(F.regexp_replace(marks, "[^>]", ""))).otherwise(0)


def normalised(text: Column) -> Column:
    """Lower case, runs of anything but letters and digits as one space, trimmed."""
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def _with_passages(messages: DataFrame) -> DataFrame:
    """Messages with ``passages``, an array of (depth, text): longest runs of lines of one depth, cut
    at lines without a letter or digit. Texts of quoted lines come without their marks.

    Lines and openings are columns of their own, used more than once by the next step, so they
    are computed once per message and not once per line.
    """
    marked = F.transform(
        F.split(F.regexp_replace(F.coalesce("text", F.lit("")), "\r\n?", "\n"), "\n"),
        lambda line: F.struct(quote_depth(line).alias("depth"), line.alias("line")),
    )
    bare = F.transform(
        marked,
        lambda m: F.struct(
            m["depth"].alias("depth"),
            F.when(m["depth"] > 0, F.regexp_replace(m["line"], _MARKS + r"[ \t]?", "")).otherwise(m["line"]).alias("text"),
        ),
    )
    lines = F.transform(
        bare,
        lambda line: F.struct(
            line["depth"].alias("depth"), line["text"].alias("text"), (normalised(line["text"]) == "").alias("blank")
        ),
    )
    all_lines, openings = F.col("_lines"), F.col("_openings")
    # Each run is opened by its first line; slices between openings are linear in the lines.
    opened = F.filter(
        F.sequence(F.lit(0), F.size(all_lines) - 1),
        lambda k: (k == 0)
        | (F.get(all_lines, k)["depth"] != F.get(all_lines, k - 1)["depth"])
        | (F.get(all_lines, k)["blank"] != F.get(all_lines, k - 1)["blank"]),
    )
    passages = F.transform(
        openings,
        lambda at, k: F.struct(
            F.get(all_lines, at)["depth"].alias("depth"),
            F.array_join(
                F.slice(all_lines, at + 1, F.coalesce(F.get(openings, k + 1), F.size(all_lines)) - at)["text"], "\n"
            ).alias("text"),
        ),
    )
    with_lines = messages.withColumn("_lines", lines).withColumn("_openings", opened)
    return with_lines.withColumn("passages", passages).drop("_lines", "_openings")


def _split(messages: DataFrame) -> DataFrame:
    """One row per passage with a letter or digit."""
    # An outer explode, as a plain one would first filter by whether there are passages, and
    # work them out twice for it.
    passages = _with_passages(messages).select("conv_id", "turn", F.explode_outer("passages").alias("passage"))
    words = normalised(F.col("passage.text"))
    return passages.select(
        "conv_id",
        "turn",
        F.col("passage.depth").alias("depth"),
        F.when(words != "", F.unhex(F.md5(words))).alias("quote_hash"),
    ).where("quote_hash IS NOT NULL")


def link_quotes(messages: DataFrame) -> DataFrame:
    """Quotes of (conv_id, turn, text): one row per quoted passage, with ``depth``, ``quote_hash``
    and ``original_turn``: the latest earlier turn with that passage unquoted, or null.

    A conversation, or one passage of it, may be most of the rows. What is looked up is
    therefore reduced to different turns, and the latest one before each is found in
    blocks of turns first and then over the blocks.
    """
    quotes = materialize(_split(messages).where("depth > 0"), "quotes")
    key = ["conv_id", "quote_hash"]
    asked = quotes.select(*key, "turn").distinct()
    originals = _split(messages).where("depth = 0").join(asked.select(*key).distinct(), key, "left_semi")
    originals = originals.select(*key, "turn").distinct()
    both = originals.withColumn("asks", F.lit(False)).union(asked.withColumn("asks", F.lit(True)))
    both = both.withColumn("block", F.floor(F.col("turn") / BLOCK_TURNS))
    held = F.when(~F.col("asks"), F.col("turn"))
    inside = Window.partitionBy(*key, "block").orderBy("turn", F.col("asks").desc())
    blocks = both.groupBy(*key, "block").agg(F.max(held).alias("last"))
    earlier = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.withColumn("before", F.max("last").over(earlier)).drop("last")
    answered = (
        both.withColumn("within", F.max(held).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
        .where("asks")
        .join(before, [*key, "block"])
        .select(*key, "turn", F.coalesce("within", "before").alias("original_turn"))
    )
    return quotes.join(answered, [*key, "turn"], "left")


def chat_format(messages: DataFrame) -> DataFrame:
    """One row per message of (conv_id, turn, role, text), with ``position`` (1, 2, ... of its turn
    in the conversation), ``reply_to`` (turn of the message it answers), ``n_quotes`` and
    ``n_linked`` (its quoted passages, and those whose original was found), ``message`` (its
    text without quotes) and ``formatted`` (role and message between marks).

    A message answers the latest one that it quotes at depth one; without such a quote, the
    one before it; the first answers none. An answer therefore never stands before what it
    answers. Quotes that match nothing are taken out like others. A null text is empty, a null
    role is `unknown`; messages without a conversation or a turn are left out, since they have
    no place in one. Messages with equal conversation and turn come back one by one and share
    their position and what they answer. Other columns are not read.
    """
    source = messages.select("conv_id", "turn", "role", "text").where("conv_id IS NOT NULL AND turn IS NOT NULL")
    own = F.filter("passages", lambda p: p["depth"] == 0)
    body = F.trim(F.array_join(F.transform(own, lambda p: p["text"]), "\n"), F.lit(" \t\r\n"))
    linked = link_quotes(source).groupBy("conv_id", "turn").agg(
        F.count(F.lit(1)).alias("n_quotes"),
        F.count("original_turn").alias("n_linked"),
        F.max(F.when(F.col("depth") == 1, F.col("original_turn"))).alias("_quoted"),
    )
    turns = number_rows(source.select("conv_id", "turn").distinct(), ["conv_id", "turn"], F.lit(0), "_no")
    firsts = turns.groupBy("conv_id").agg(F.min("_no").alias("_first"))
    # The turn before is the one with the number before; no task has to hold a conversation.
    before = turns.select((F.col("_no") + 1).alias("_no"), F.col("turn").alias("_before"))
    answers = (
        turns.join(before, "_no", "left")
        .transform(lambda rows: spread_join(rows, firsts, "conv_id", "turn", "inner"))
        .join(linked, ["conv_id", "turn"], "left")
        .select(
            "conv_id",
            "turn",
            (F.col("_no") - F.col("_first") + 1).alias("position"),
            F.coalesce("_quoted", F.when(F.col("_no") > F.col("_first"), F.col("_before"))).alias("reply_to"),
            F.coalesce("n_quotes", F.lit(0)).cast("bigint").alias("n_quotes"),
            F.coalesce("n_linked", F.lit(0)).cast("bigint").alias("n_linked"),
        )
    )
    joined = _with_passages(source.join(answers, ["conv_id", "turn"]))
    marked = F.concat(F.lit("<|"), F.col("role"), F.lit("|>\n"), F.col("message"), F.lit("\n<|end|>\n"))
    return joined.select(
        "conv_id",
        "turn",
        "position",
        F.coalesce("role", F.lit("unknown")).alias("role"),
        "reply_to",
        "n_quotes",
        "n_linked",
        F.regexp_replace(body, r"\n{3,}", "\n\n").alias("message"),
    ).withColumn("formatted", marked)
