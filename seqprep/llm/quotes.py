"""Quotation linking: conversations ordered by replies, without their quotes.

A line that begins with ">" signs is quoted; their number is its level. A passage is a run of lines of
one level without a blank one between; it is normalised (marks off, letters lower-cased, white space and
line breaks squeezed) and hashed without its level, so that it is found however deep it is quoted and
however it was wrapped. Its lines and its sentences are hashed as well. The original of a passage is the
first message of the conversation whose own (unquoted) text has all of it as one of its passages, lines or
sentences. A passage quoted in part, or put together from several places, has no such original; then it
is the latest of the originals of its lines and sentences. A message replies to the latest earlier
original of its first-level passages; where none of them has one, of those of the next level that do.
Without any, it opens a thread. A thread's messages follow each other in the order of their turns, so a
reply stands behind what it answers; threads follow in the order of their first turns.

Originals are minima of one row per conversation and hash, made before the shuffle too, so a line or a
conversation with any share of the rows meets in no single task. Threads are found by pointer doubling,
and places by counts of ranges.

Defined cases: a null text is empty; a quoted line whose normal form is empty parts two passages and
links to nothing; a passage of which no earlier message has anything links to nothing; of messages with
the same conversation and turn all stay, are linked alike and stand in the order of their texts; rows
without a conversation or a turn open no thread and come first; an empty table gives no rows; other
columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqprep.functions.basics import let
from seqprep.llm.common import Rounds, needed, staged

MARKS = r"^[ \t]*((?:>[ \t]?)+)"
ENDS = r"([.!?]) |([。！？])"


def level(line: Column) -> Column:
    """Number of quote marks before a line; 0 for a line of one's own."""
    marks = F.regexp_extract(line, MARKS, 1)
    return F.length(F.regexp_replace(marks, "[^>]", ""))


def normal(line: Column) -> Column:
    """What a line says: without marks, lower-cased, white space squeezed."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(line, MARKS, "")), r"\s+", " "))


def _hash(said: Column) -> Column:
    return F.xxhash64(said, F.lit(3))


def sentences(said: Column) -> Column:
    """The sentences of a normalised passage: cut behind marks that a space follows, and wide marks."""
    return F.transform(F.split(F.regexp_replace(said, ENDS, "$1$2\n"), "\n"), F.trim)


def _units(parts: Column, line: int) -> Column:
    return F.transform(parts, lambda u: F.struct(_hash(u).alias("hash"), F.lit(line).alias("line")))


def _passage(lines: Column) -> Column:
    """``level, passage, units`` of a passage's lines: the hash of the whole, and those of its parts."""

    def made(said: Column) -> Column:
        whole = F.array_join(said, " ")
        own = F.array_distinct(said)
        more = F.array_except(F.concat(F.array(whole), sentences(whole)), F.concat(own, F.array(F.lit(""))))
        return F.struct(
            F.get(lines, F.lit(0))["level"].alias("level"),
            _hash(whole).alias("passage"),
            F.concat(_units(own, 1), _units(more, 0)).alias("units"),
        )

    return let(F.filter(F.transform(lines, lambda x: x["said"]), lambda x: x != ""), made)


def passages_of(text: Column) -> Column:
    """A message as an array of ``level, passage, units``; a passage begins at a line that is not blank
    behind a blank one or one of another level."""
    lines = F.transform(
        F.split(F.coalesce(text, F.lit("")), "\n"),
        lambda x: F.struct(level(x).alias("level"), normal(x).alias("said")),
    )

    def cut(rows: Column) -> Column:
        def begins(i: Column) -> Column:
            here, before = F.get(rows, i), F.get(rows, i - 1)
            parted = (before["said"] == "") | (before["level"] != here["level"])
            return (here["said"] != "") & F.coalesce(parted, F.lit(True))

        first = F.filter(F.sequence(F.lit(0), F.size(rows) - 1), begins)
        return let(
            first,
            lambda s: F.transform(
                s,
                lambda at, k: let(
                    F.slice(rows, at + 1, F.coalesce(F.get(s, k + 1), F.size(rows)) - at), _passage
                ),
            ),
        )

    return let(lines, cut)


def passages(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, level, passage, n_lines, n_lines_linked, source``: the different quoted passages,
    their different lines, and the turn that first said them."""
    told = messages.filter("conv_id is not null and turn is not null").select(
        "conv_id", "turn", passages_of(F.col("text")).alias("all")
    )

    def units(quoted: bool) -> DataFrame:
        of = F.filter("all", lambda p: (p["level"] > 0) == F.lit(quoted))
        rows = told.select("conv_id", "turn", F.inline(of))
        return rows.select("conv_id", "turn", "level", "passage", F.inline("units"))

    first = units(False).groupBy("conv_id", "hash").agg(F.min("turn").alias("source"))
    quoted = units(True).groupBy("conv_id", "turn", "level", "passage", "hash").agg(F.max("line").alias("line"))
    found = quoted.join(first, ["conv_id", "hash"], "left").withColumn(
        "source", F.when(F.col("source") < F.col("turn"), F.col("source"))
    )
    whole = F.max(F.when(F.col("hash") == F.col("passage"), F.col("source")))
    return found.groupBy("conv_id", "turn", "level", "passage").agg(
        F.sum("line").alias("n_lines"),
        F.sum(F.when(F.col("source").isNotNull(), F.col("line")).otherwise(0)).alias("n_lines_linked"),
        F.coalesce(whole, F.max("source")).alias("source"),
    )


def own_text(text: Column) -> Column:
    """A message without its quoted lines."""
    lines = F.filter(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: level(x) == 0)
    return F.array_join(lines, "\n")


def _threads(replies: DataFrame) -> DataFrame:
    """``conv_id, turn, thread, depth`` from ``conv_id, turn, reply_to``, by pointer doubling.

    Each round every message that has not come to the first of its thread jumps as far as the
    message it points to has come; only such messages are joined. A reply is later than what it
    answers, so there are no circles, and a chain of n messages takes log2(n) rounds.
    """
    first = F.col("reply_to").isNull()
    rounds = Rounds(replies.sparkSession)
    now = rounds.staged(
        replies.select(
            "conv_id", "turn", F.coalesce("reply_to", "turn").alias("thread"),
            F.when(first, 0).otherwise(1).cast("bigint").alias("depth"), first.alias("done"),
        )
    )
    while not now.filter("not done").isEmpty():
        up = now.select(
            "conv_id", F.col("turn").alias("thread"), F.col("thread").alias("_up"),
            F.col("depth").alias("_more"), F.col("done").alias("_done"),
        )
        moved = now.filter("not done").join(up, ["conv_id", "thread"]).select(
            "conv_id", "turn", F.col("_up").alias("thread"), (F.col("depth") + F.col("_more")).alias("depth"),
            F.col("_done").alias("done"),
        )
        now = rounds.staged(now.filter("done").unionByName(moved))
    return now.drop("done")


def _placed(df: DataFrame) -> DataFrame:
    """Add ``position``: 0, 1, ... in each conversation by thread, turn and text.

    Spark deals the rows to ranges of that order and sorts them there; counts of each conversation in
    the ranges before (one row for a range and conversation) give where a range begins.
    """
    order = ["conv_id", "thread", "turn", "text", "role"]
    dealt = df.repartitionByRange(*order[:3], F.xxhash64("text")).sortWithinPartitions(*order)
    numbered = staged(dealt.withColumn("_row", F.monotonically_increasing_id()))
    numbered = numbered.withColumn("_range", F.shiftright("_row", 33))
    parts = numbered.groupBy("conv_id", "_range").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("conv_id").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select(
        F.col("conv_id").alias("_c"), F.col("_range").alias("_r"), "_first",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"),
    )
    at = F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("_range") == F.col("_r"))
    return numbered.join(starts, at).withColumn(
        "position", F.col("_start") + F.col("_row") - F.col("_first")
    ).drop("_c", "_r", "_first", "_start", "_row", "_range")


def linked(
    df: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text"
) -> DataFrame:
    """One row per message: ``conv_id, turn, role, thread, depth, position, reply_to, n_quoted,
    n_linked, n_passages, n_found, text``; ``text`` is without quotes, ``n_passages`` and ``n_found`` count
    its different quoted passages and those with an original, ``n_quoted`` and ``n_linked`` the different
    lines of these passages and those that some message has as they stand."""
    messages = needed(df, conv_id=conv_id, turn=turn, role=role, text=text).select(
        F.col("conv_id").cast("bigint"), F.col("turn").cast("bigint"), "role", "text"
    )
    links = passages(messages)
    nearest = F.min(F.when(F.col("source").isNotNull(), F.struct("level", (-F.col("source")).alias("s"))))
    replies = links.groupBy("conv_id", "turn").agg(
        (-nearest["s"]).alias("reply_to"),
        F.sum("n_lines").alias("n_quoted"),
        F.sum("n_lines_linked").alias("n_linked"),
        F.count(F.lit(1)).alias("n_passages"),
        F.count("source").alias("n_found"),
    )
    turns = messages.select("conv_id", "turn").filter("conv_id is not null and turn is not null").distinct()
    told = staged(turns.join(replies, ["conv_id", "turn"], "left"))
    threads = _threads(told)
    joined = messages.join(told.join(threads, ["conv_id", "turn"]), ["conv_id", "turn"], "left").select(
        "conv_id", "turn", "role", "thread", F.coalesce("depth", F.lit(0).cast("bigint")).alias("depth"),
        "reply_to",
        *[F.coalesce(c, F.lit(0).cast("bigint")).alias(c) for c in ("n_quoted", "n_linked", "n_passages", "n_found")],
        own_text(F.col("text")).alias("text"),
    )
    return _placed(joined)
